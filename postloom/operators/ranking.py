"""Fusion and ranking of hit lists. A hit list has an id, a score and a position; equal scores keep the position's order.

Hit lists hold the candidate budget (some hundred rows a query), so that windows over one list are small; windows are
always partitioned by `query` columns where there are several queries.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.operators.writes import first_of
from postloom.sources.tables import spare, stored

RRF_K = 60
SUMMARY_BOOST, GRAPH_BOOST, QUOTED_FACTOR = 1.2, 1.15, 0.7
RERANK_MOST = 50
RERANK_ALPHA, MMR_LAMBDA, MMR_MOST, MMR_CHARS = 0.35, 0.5, 200, 4096


def clamp_weight(value: object) -> float:
    """A weight in [0, 1]; what is no number is 0.5."""
    try:
        v = float(value)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return 0.5
    return 0.5 if v != v else min(1.0, max(0.0, v))


def best_of_each(hits: DataFrame, key: str, score: str, order: Sequence[str], query: Sequence[str] = ()) -> DataFrame:
    """One row for each key, the highest score, the earlier of equal ones. Rows without a key all stay."""
    own = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("\0row:"), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in order)))
    return first_of(hits, [*query, own], [F.desc(score), *order])


def ranked(hits: DataFrame, score: str, order: Sequence[str], query: Sequence[str] = ()) -> DataFrame:
    """hits with rank, from 1."""
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy(*(query or [F.lit(0)])).orderBy(F.desc(score), *order)))


def reciprocal_rank(lists: Sequence[DataFrame], key: str, k: int = RRF_K, query: Sequence[str] = ()) -> DataFrame:
    """Rows (query, key, fusion) of ranked lists: the sum of 1 / (k + rank)."""
    parts = [x.select(*query, key, (F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("part")) for x in lists]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*query, key).agg(F.round(F.sum("part"), 9).alias("fusion"))


def weighted(lexical: DataFrame, vector: DataFrame, key: str, alpha: float) -> DataFrame:
    """Rows (key, lexical_score, vector_score, fusion): alpha of the vector score and the rest of the lexical one."""
    a = clamp_weight(alpha)
    both = lexical.select(key, F.col("score").alias("lexical_score")).join(vector.select(key, F.col("score").alias("vector_score")), key, "full_outer")
    fusion = F.coalesce("vector_score", F.lit(0.0)) * a + F.coalesce("lexical_score", F.lit(0.0)) * (1 - a)
    return both.withColumn("fusion", F.round(fusion, 9))


def merge_fields(a: DataFrame, b: DataFrame, key: str, plain: Sequence[str], lists: Sequence[str] = (), best: Sequence[str] = ()) -> DataFrame:
    """Rows of both: plain columns from the first that has one, list columns united, best columns the larger."""
    left, right = (x.select(key, *(F.col(c).alias(f"{c}_{s}") for c in (*plain, *lists, *best))) for x, s in ((a, "a"), (b, "b")))
    none = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    return left.join(right, key, "full_outer").select(
        key,
        *(F.coalesce(f"{c}_a", f"{c}_b").alias(c) for c in plain),
        *(F.array_union(none(F.col(f"{c}_a")), none(F.col(f"{c}_b"))).alias(c) for c in lists),
        *(F.greatest(f"{c}_a", f"{c}_b").alias(c) for c in best),
    )


def boosted(hits: DataFrame, score: str, group: str, chosen: DataFrame, factor: float, flag: str = "boosted") -> DataFrame:
    """hits whose group is among the chosen with the score times factor, and a flag."""
    marked = hits.join(chosen.select(F.col(group), F.lit(True).alias(flag)).distinct(), group, "left")
    hit = F.coalesce(F.col(flag), F.lit(False))
    return marked.withColumn(flag, hit).withColumn(score, F.when(hit, F.col(score) * factor).otherwise(F.col(score)))


def light_rerank(hits: DataFrame, alpha: float = RERANK_ALPHA) -> DataFrame:
    """hits (lexical_score, vector_score, score) with rerank_score, both scores over their maxima and blended, and the
    score half of each."""
    a = clamp_weight(alpha)
    top = hits.agg(F.max("lexical_score").alias("_l"), F.max("vector_score").alias("_v"), F.max("score").alias("_s"))
    share = lambda c, m: F.when(F.col(m) > 0, F.coalesce(F.col(c), F.lit(0.0)) / F.col(m)).otherwise(0.0)
    out = hits.crossJoin(F.broadcast(top))  # one row
    out = out.withColumn("rerank_score", F.round(share("vector_score", "_v") * a + share("lexical_score", "_l") * (1 - a), 9))
    return out.withColumn("score", F.round(F.lit(0.5) * F.col("score") + F.lit(0.5) * F.col("rerank_score"), 9)).drop("_l", "_v", "_s")


def recency(score: Column, days: Column, half_life: float = 30.0, strength: float = 1.0) -> Column:
    """A score raised by up to `strength` times itself for what is new."""
    return score * (1 + F.lit(strength) * F.exp(-F.log(F.lit(2.0)) / F.lit(half_life) * F.greatest(days, F.lit(0.0))))


def half_power_recency(score: Column, days: Column, half_life: float = 30.0) -> Column:
    """The older variant: whole days, halved each half life, and nothing for the future."""
    return F.when(days < 0, score).otherwise(score * F.pow(F.lit(0.5), F.floor(days) / F.lit(half_life)))


def quoted_factor(score: Column, kind: Column, factor: float = QUOTED_FACTOR) -> Column:
    return F.when(kind == "quoted_history", score * factor).otherwise(score)


def token_set(text: Column) -> Column:
    """The distinct lower-cased white-space tokens of a text's first characters."""
    return F.array_distinct(F.filter(F.split(F.lower(F.left(text, F.lit(MMR_CHARS))), r"[ \t\n\x0B\f\r]+"), lambda x: x != ""))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def diverse(hits: DataFrame, query: str, id_col: str, score: str, text_col: str, weight: float = MMR_LAMBDA, most: int = MMR_MOST) -> DataFrame:
    """hits with place: maximal marginal relevance among each query's `most` highest, the rest after them by score. Picks
    depend on each other, so each query's bounded list is one group in one task."""
    lam = clamp_weight(weight)
    fields = hits.select(query, id_col, score, text_col)

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([score, id_col], ascending=[False, True], kind="stable").reset_index(drop=True)
        sets = [set((t or "")[:MMR_CHARS].lower().split()) for t in pdf[text_col]]
        left, taken, closest = list(range(len(pdf))), [], [0.0] * len(pdf)
        while left:
            best = max(left, key=lambda i: (lam * pdf[score][i] - (1 - lam) * closest[i], -i))
            taken.append(best)
            left.remove(best)
            for i in left:
                both = len(sets[i] | sets[best])
                closest[i] = max(closest[i], len(sets[i] & sets[best]) / both if both else 0.0)
        out = pdf.loc[taken, [query, id_col, score]].reset_index(drop=True)
        out["place"] = range(1, len(out) + 1)
        return out

    by = Window.partitionBy(query).orderBy(F.desc(score), id_col)
    n = spare("_n", fields)
    placed = fields.withColumn(n, F.row_number().over(by))
    kinds = ", ".join(f"`{c}` {fields.schema[c].dataType.simpleString()}" for c in (query, id_col, score))
    first = placed.where(F.col(n) <= most).drop(n).groupBy(query).applyInPandas(pick, f"{kinds}, place long")
    rest = places(fields.drop(text_col), query, [F.desc(score), F.col(id_col)], n).where(F.col(n) > most)  # ranked without their texts
    return first.unionByName(rest.select(query, id_col, score, F.col(n).cast("long").alias("place")))


def places(rows: DataFrame, group: str, order: Sequence[Column], name: str) -> DataFrame:
    """rows with each one's place in its group, from 1, in a column `name`. Rows are dealt out by ranges of the order and
    placed within their range; the ranges' sizes, of which a group has as many as there are ranges, shift them. A group of
    any share is so spread over tasks."""
    part, before = spare("part_", rows), spare("before_", rows)
    ranged = stored(rows.repartitionByRange(F.col(group), *order).withColumn(part, F.spark_partition_id()))
    sizes = ranged.groupBy(group, part).agg(F.count("*").alias(before))
    earlier = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(F.col(group).alias("group_of"), F.col(part).alias("part_of"), F.coalesce(F.sum(before).over(earlier), F.lit(0)).alias(before))
    inside = ranged.withColumn(name, F.row_number().over(Window.partitionBy(group, part).orderBy(*order)))
    met = inside.join(shifts, F.col(group).eqNullSafe(F.col("group_of")) & (F.col(part) == F.col("part_of")))
    return met.select(*rows.columns, (F.col(name) + F.col(before)).alias(name))


def rescored(hits: DataFrame, scorer: Callable[[str, list[str]], Sequence[float]], asked: str, id_col: str, text: Column, order: str, most: int = RERANK_MOST) -> DataFrame:
    """The `most` highest hits with score from a scorer of (query, texts), such as a cross-encoder; the others are left
    out, as they were not scored. The scorer runs over Arrow batches in tasks."""
    top = hits.orderBy(F.desc(order), id_col).limit(most)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(list(scorer(asked, texts.fillna("").tolist())), dtype=float)

    return top.withColumn("score", scored(F.left(text, F.lit(MMR_CHARS))))


def over_threshold(hits: DataFrame, key: str, score: str, order: Sequence[str], least: float = 0.0) -> DataFrame:
    """The best row of each key (rows without one are left out), if its score reaches the least."""
    return best_of_each(hits.where(F.coalesce(F.col(key).cast("string"), F.lit("")) != ""), key, score, order).where(F.col(score) >= least)


def diverse_vectors(hits: DataFrame, query: str, id_col: str, score: str, vector_col: str, k: int, weight: float = 0.7, most: int = MMR_MOST) -> DataFrame:
    """Rows (query, id, score, place) of each query's k picks among its `most` highest: maximal marginal relevance by inner
    products of embeddings, where a product under 0 counts as none."""
    import numpy as np

    lam = clamp_weight(weight)
    by = Window.partitionBy(query).orderBy(F.desc(score), id_col)
    n = spare("_n", hits)
    fields = hits.where(F.col(vector_col).isNotNull()).select(query, id_col, score, vector_col).withColumn(n, F.row_number().over(by)).where(F.col(n) <= most).drop(n)

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([score, id_col], ascending=[False, True], kind="stable").reset_index(drop=True)
        m = np.array(pdf[vector_col].tolist(), float)
        closest, taken = np.zeros(len(pdf)), []
        value = pdf[score].to_numpy(float)
        while len(taken) < min(k, len(pdf)):
            rank = lam * value - (1 - lam) * closest if taken else value.copy()
            rank[taken] = -np.inf
            taken.append(int(rank.argmax()))
            closest = np.maximum(closest, m @ m[taken[-1]])
        out = pdf.loc[taken, [query, id_col, score]].reset_index(drop=True)
        out["place"] = range(1, len(out) + 1)
        return out

    kinds = ", ".join(f"`{c}` {fields.schema[c].dataType.simpleString()}" for c in (query, id_col, score))
    return fields.groupBy(query).applyInPandas(pick, f"{kinds}, place long")


def within_budget(rows: DataFrame, size: Column, budget: int, order: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """rows with room, the characters each still gets of its group's budget in the order given; those with none are left
    out."""
    by = Window.partitionBy(*(group or [F.lit(0)])).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(size).over(by), F.lit(0))
    return rows.withColumn("room", F.least(size, F.greatest(F.lit(budget) - before, F.lit(0)))).where("room > 0")
