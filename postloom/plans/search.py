"""Hybrid search: a lexical and a vector hit list of the candidate budget, deduplicated, fused, boosted and cut to k.

Both lists come out of top-k scans, so that everything after them handles at most two budgets of rows, whatever the
size of the tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.operators import lexical, ranking, vector


@dataclass(frozen=True)
class SearchSettings:
    k: int = 50
    multiplier: int = 3
    rrf_k: int = ranking.RRF_K
    fusion: str = "rrf"  # or "weighted"
    alpha: float = 0.5
    summary_boost: float = ranking.SUMMARY_BOOST
    exclude: list[str] = field(default_factory=list)

    @property
    def budget(self) -> int:
        return self.k * self.multiplier


def lexical_hits(docs: DataFrame, terms: list[str], limit: int, exclude: list[str] = ()) -> DataFrame:  # type: ignore[assignment]
    """Rows (doc_id, score, content_hash, source) of the documents that hold most of the terms, ties by doc_id."""
    rows = docs
    for term in exclude:
        rows = rows.where(~F.contains(F.lower("text"), F.lit(term.lower())))
    scored = rows.select("doc_id", "source", "text", lexical.match_count(F.col("text"), terms).alias("score")).where("score > 0")
    top = scored.orderBy(F.desc("score"), "doc_id").limit(limit)
    return top.select("doc_id", "score", F.sha2("text", 256).alias("content_hash"), "source")


def hybrid(docs: DataFrame, vectors: DataFrame, terms: list[str], query: list[float], settings: SearchSettings = SearchSettings()) -> DataFrame:
    """Rows (doc_id, fusion, lexical_score, vector_score, boosted) of the k best documents; vectors belong to the document
    of the same id."""
    words = lexical_hits(docs, terms, settings.budget, list(settings.exclude))
    near = vector.nearest(vectors, query, settings.budget).select(F.col("vec_id").alias("doc_id"), F.col("similarity").alias("score"))
    texts = docs.join(F.broadcast(near), "doc_id").select("doc_id", "score", F.sha2("text", 256).alias("content_hash"), "source")  # at most a budget of rows
    lists = [ranking.best_of_each(x, "content_hash", "score", ["doc_id"]) for x in (words, texts)]
    if settings.fusion == "weighted":
        top = words.agg(F.max("score").alias("m"))
        share = lists[0].crossJoin(F.broadcast(top)).select("doc_id", (F.col("score") / F.col("m")).alias("score"))  # one row
        fused = ranking.weighted(share, lists[1], "doc_id", settings.alpha).select("doc_id", "fusion")
    else:
        fused = ranking.reciprocal_rank([ranking.ranked(x, "score", ["doc_id"]) for x in lists], "doc_id", settings.rrf_k)
    fields = ranking.merge_fields(
        lists[0].select("doc_id", "source", F.col("score").cast("double").alias("lexical_score"), F.lit(None).cast("double").alias("vector_score")),
        lists[1].select("doc_id", "source", F.lit(None).cast("double").alias("lexical_score"), F.col("score").alias("vector_score")),
        "doc_id",
        ["source"],
        best=["lexical_score", "vector_score"],
    )
    leading = words.orderBy(F.desc("score"), "doc_id").limit(5).select("source")
    hits = ranking.boosted(fused.join(fields, "doc_id"), "fusion", "source", leading, settings.summary_boost)
    out = hits.withColumn("fusion", F.round("fusion", 9)).orderBy(F.desc("fusion"), "doc_id").limit(settings.k)
    return out.select("doc_id", "fusion", "lexical_score", "vector_score", "boosted")
