"""Mixing sources to target weights: systematic sampling along prefix sums of expected copies.

Sources, by code point and a null one last, weigh as `weights` repeats. They share all words by weight; a target stops at
`most` times its source's words, and the excess is shared anew by weight among the others until none is above: the level
at which min(most * words, weight * level) adds up to all words, found from prefix sums over the sources.

Within a source every document expects target / words copies. Documents stand in the order of (size, doc_id); with one
random offset for the source, a document is taken once for each whole number that the prefix sum of expected copies plus
the offset crosses. As neighbours are of like size, the words taken come near the target. The offset is drawn from a hash
of seed and source, so that reruns agree.

All of it is DataFrame code. Prefix sums are taken over ranges of rows that Spark deals out by size, and over the ranges'
totals, so that a source of any share is spread over tasks; rows that are equal are counted before that.

Edge cases: a null or blank text has size 0 and takes no words; a source of no words has target 0. Rows that repeat a
doc_id, or have none, are rows of their own. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.llm.common import stored

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK = 10_000


def n_words(text: Column) -> Column:
    """The number of [^\\x20\\x09-\\x0D]+ in a text; 0 for null. No array of the words is made."""
    marks = F.regexp_replace(text, r"[^\x20\x09-\x0D]++", "w")
    return F.coalesce(F.length(F.translate(marks, " \t\n\x0b\f\r", "")), F.lit(0)).cast("long")


def prefix_sums(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, str]) -> DataFrame:
    """df with, for each entry new: column of sums, the sum of column over the rows before a row among those of its keys.
    Rows are dealt out by range; a row's sum is that of the ranges before plus that within its range. Rows of equal keys and
    order should not be many. The number of ranges, not of rows, bounds what one task adds up across ranges."""
    ranged = stored(df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("range_", F.spark_partition_id()))
    totals = ranged.groupBy(*keys, "range_").agg(*[F.sum(c).alias(f"{new}_before") for new, c in sums.items()])
    earlier = Window.partitionBy(*keys).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*[F.col(k).alias(f"{k}_of") for k in keys], F.col("range_").alias("range_of"), *[F.coalesce(F.sum(f"{new}_before").over(earlier), F.lit(0)).alias(f"{new}_before") for new in sums])
    inside = Window.partitionBy(*keys, "range_").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(new) for new, c in sums.items()])
    on = F.col("range_") == F.col("range_of")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"{k}_of"))
    return out.join(totals, on).select(*df.columns, *[(F.col(new) + F.col(f"{new}_before")).alias(new) for new in sums])


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """totals (source, source_size) with each source's target, a double."""
    placed = prefix_sums(totals.withColumn("one", F.lit(1)), [], [F.col("source").asc_nulls_last()], {"place": "one"})
    at = F.pmod("place", F.lit(len(weights))).cast("int")
    placed = placed.select("source", "source_size", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), at + 1).cast("decimal(38,0)").alias("w"))
    exact = F.col("source_size").cast("decimal(38,0)")
    scale = math.lcm(*map(int, weights))
    placed = stored(placed.withColumn("fills", exact * scale / F.col("w")).withColumn("cap", exact * most))  # whole numbers
    everything = placed.agg(F.sum("source_size"), F.sum("w")).first()
    if everything[0] is None:
        return placed.select("source", "source_size", F.lit(0.0).alias("target"))
    words, weight = int(everything[0]), int(everything[1])
    runs = prefix_sums(placed, [], [F.col("fills"), F.col("source").asc_nulls_last()], {"capped": "cap", "done": "w"})
    left, among = F.lit(words) - F.col("capped"), F.lit(weight) - F.col("done")
    level = runs.where(left * F.col("w") <= F.col("cap") * among).agg(F.min_by(F.struct(left.cast("decimal(38,0)").alias("a"), among.cast("decimal(38,0)").alias("b")), "fills")).first()[0]
    share = F.lit(level["a"]).cast("decimal(38,0)") * F.col("w")
    below = share <= F.col("cap") * F.lit(level["b"]).cast("decimal(38,0)")
    target = F.when(below, share.cast("double") / F.lit(float(level["b"]))).otherwise(F.col("cap").cast("double"))
    return placed.select("source", "source_size", target.alias("target"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 0) -> DataFrame:
    """One row for each of docs: doc_id, size, source_size, target and taken, the words that the mix takes of it (its size
    times the number of its copies, which is at most `most`)."""
    sizes = stored(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")).groupBy("source", "doc_id", "size").agg(F.count("*").alias("rows")))
    totals = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    goals = targets(totals, weights, most)
    goals = goals.select(
        F.col("source").alias("source_of"),
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("copies"),
        (F.conv(F.substring(F.md5(F.concat(F.lit(f"{int(seed)}:"), F.coalesce("source", F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))).alias("offset"),
    )
    placed = prefix_sums(sizes, ["source"], [F.col("size"), F.col("doc_id")], {"before": "rows"})
    placed = placed.join(goals, F.col("source").eqNullSafe(F.col("source_of")))
    placed = placed.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, F.lit(BLOCK).cast("long"))))
    placed = placed.withColumn("nth", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + BLOCK, F.col("rows")) - 1))).withColumn("at", F.col("before") + F.col("nth"))
    upto = F.floor((F.col("at") + 1) * F.col("copies") + F.col("offset")) - F.floor(F.col("at") * F.col("copies") + F.col("offset"))
    return placed.select("doc_id", "size", "source_size", "target", (F.col("size") * upto).cast("long").alias("taken"))
