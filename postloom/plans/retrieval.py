"""Retrieval over a mail corpus, whole: filters, full-text and vector hits, fusion, boosts, rerank, recency, quoted weight
and diversity.

The scans (lexical, vector, conversations, graph) end in top-k lists of the candidate budget; all that follows handles at
most two budgets of rows, whatever the corpus holds. A filter's conversations are a semi join, never a list in the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.functions.text import entity_mentions
from postloom.operators import filters, graph, lexical, ranking, vector
from postloom.sources.tables import stored


@dataclass(frozen=True)
class Corpus:
    """chunks (chunk_id, conversation_id, text, chunk_type, is_attachment, file_type, position), vectors (chunk_id,
    embedding), conversations (conversation_id, subject, summary, latest_date, participants), nodes and edges of the
    entity graph."""

    chunks: DataFrame
    vectors: DataFrame
    conversations: DataFrame
    nodes: DataFrame | None = None
    edges: DataFrame | None = None


@dataclass(frozen=True)
class Settings:
    k: int = 50
    multiplier: int = 3
    rrf_k: int = ranking.RRF_K
    fusion: str = "rrf"  # or "weighted"
    alpha: float = ranking.RERANK_ALPHA
    half_life: float = 30.0
    strength: float = 1.0
    mmr: float = ranking.MMR_LAMBDA
    summaries: int = 5  # conversations found by subject and summary that are boosted
    hops: int = 2
    synonyms: dict[str, list[str]] = field(default_factory=dict)
    scorer: Callable[[str, list[str]], Sequence[float]] | None = None  # in place of the light rerank
    now: datetime = datetime(2025, 1, 1, tzinfo=UTC)

    @property
    def budget(self) -> int:
        return self.k * self.multiplier


def graph_conversations(corpus: Corpus, query: str, settings: Settings) -> DataFrame | None:
    """The conversations around the entities that a query mentions: named ones, else similar ones, and what is within
    some hops of them."""
    if corpus.nodes is None or corpus.edges is None:
        return None
    spark = corpus.nodes.sparkSession
    names = spark.range(1).select(entity_mentions(F.lit(query)).alias("n")).first()["n"] or []
    found = None
    for name in names[:10]:
        hits = graph.find_entities(corpus.nodes, [name]).select("node_id", "pagerank")
        if not hits.take(1):
            hits = graph.similar_entities(corpus.nodes, name).select("node_id", "pagerank")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return None
    start = stored(found.select("node_id").distinct())
    # edges may be a join: it runs once for all hops
    edges = stored(corpus.edges.select("edge_id", "source_id", "target_id", "weight", "conversation_id"))
    near = graph.expand(edges, start, settings.hops)
    entities = stored(near.select(F.explode(F.array("source_id", "target_id")).alias("node_id")).union(start).distinct())
    return stored(graph.conversations_of(edges, entities, settings.k * 2).select("conversation_id"))


def candidates(corpus: Corpus, query: str, vector_query: Sequence[float] | None, settings: Settings) -> tuple[DataFrame, str]:
    """Fused hits with their fields before any boost, and the query without its filters."""
    f, rest = filters.parse(query)
    asked = rest if rest.strip() else query
    ids = filters.resolve(f, corpus.conversations)
    chunks = corpus.chunks.where(filters.chunk_filter(f, F.col("text"), F.col("is_attachment"), F.col("file_type")))
    chunks = filters.narrowed(chunks, ids, "conversation_id")
    groups = lexical.expanded(asked, settings.synonyms)
    words = lexical.ranked_search(chunks.select("chunk_id", "text"), "chunk_id", {"text": "B"}, groups, settings.budget)
    fields = ["conversation_id", "text", "chunk_type"]
    hashed = F.when(F.coalesce("text", F.lit("")) != "", F.sha2("text", 256)).alias("content_hash")

    def filled(hits: DataFrame) -> DataFrame:  # a budget of rows finds its chunks
        return chunks.join(F.broadcast(hits), "chunk_id").select("chunk_id", "score", hashed, *fields)

    lists = [filled(words.select("chunk_id", F.col("rank").alias("score")))]
    if vector_query:
        rows = corpus.vectors
        if ids is not None or not f.is_empty():
            rows = rows.join(chunks.select("chunk_id"), "chunk_id", "left_semi")
        near = vector.nearest(rows, list(vector_query), settings.budget, id_col="chunk_id")
        lists.append(filled(near.select("chunk_id", F.col("similarity").alias("score"))))
    else:
        lists.append(lists[0].where("false"))
    a, b = (ranking.best_of_each(x, "content_hash", "score", ["chunk_id"]) for x in lists)
    if settings.fusion == "weighted":
        fused = ranking.weighted(a, b, "chunk_id", settings.alpha).select("chunk_id", "fusion")
    else:
        fused = ranking.reciprocal_rank([ranking.ranked(x, "score", ["chunk_id"]) for x in (a, b)], "chunk_id", settings.rrf_k)
    none = F.lit(None).cast("double")
    merged = ranking.merge_fields(
        a.select("chunk_id", *fields, F.col("score").alias("lexical_score"), none.alias("vector_score")),
        b.select("chunk_id", *fields, none.alias("lexical_score"), F.col("score").alias("vector_score")),
        "chunk_id",
        fields,
        best=["lexical_score", "vector_score"],
    )
    return fused.join(merged, "chunk_id").withColumnRenamed("fusion", "score"), asked


def scored(hits: DataFrame, corpus: Corpus, query: str, by_summary: DataFrame, by_graph: DataFrame | None, settings: Settings) -> DataFrame:
    """hits with score after the boosts, the rerank, recency and the quoted weight: chunk_id, conversation_id, text, score,
    lexical_score, vector_score, summary_boosted, graph_boosted."""
    out = ranking.boosted(hits, "score", "conversation_id", by_summary.select("conversation_id"), ranking.SUMMARY_BOOST, "summary_boosted")
    if by_graph is None:
        out = out.withColumn("graph_boosted", F.lit(False))
    else:
        out = ranking.boosted(out, "score", "conversation_id", by_graph, ranking.GRAPH_BOOST, "graph_boosted")
    out = ranking.rescored(out, settings.scorer, query, "chunk_id", F.col("text"), "score") if settings.scorer else ranking.light_rerank(out, settings.alpha)
    dated = corpus.conversations.select("conversation_id", "latest_date")
    ids = out.select("conversation_id").distinct()  # at most two budgets of rows
    out = out.join(dated.join(F.broadcast(ids), "conversation_id"), "conversation_id", "left")
    days = (F.lit(settings.now.timestamp()) - F.unix_micros(F.col("latest_date").cast("timestamp")) / 1_000_000) / 86_400
    recent = F.when(F.col("latest_date").isNull(), F.col("score")).otherwise(ranking.recency(F.col("score"), days, settings.half_life, settings.strength))
    out = out.withColumn("score", F.round(ranking.quoted_factor(recent, F.coalesce("chunk_type", F.lit(""))), 9))
    return out.select("chunk_id", "conversation_id", "text", "score", "lexical_score", "vector_score", "summary_boosted", "graph_boosted")


def retrieve(corpus: Corpus, query: str, vector_query: Sequence[float] | None, settings: Settings = Settings()) -> DataFrame:
    """Rows (place, chunk_id, conversation_id, score, lexical_score, vector_score, summary_boosted, graph_boosted) of the k
    best chunks for a query with filters in it."""
    hits, asked = candidates(corpus, query, vector_query, settings)
    by_summary = lexical.conversation_search(corpus.conversations, asked, settings.synonyms, settings.summaries)
    # at most two budgets of rows, asked for several times
    ranked = stored(scored(hits, corpus, asked, by_summary, graph_conversations(corpus, asked, settings), settings))
    one = ranked.withColumn("asked", F.lit(0))
    places = ranking.diverse(one, "asked", "chunk_id", "score", "text", settings.mmr).where(F.col("place") <= settings.k)
    return places.select("chunk_id", "place").join(ranked.drop("text"), "chunk_id").select("place", "chunk_id", "conversation_id", "score", "lexical_score", "vector_score", "summary_boosted", "graph_boosted")
