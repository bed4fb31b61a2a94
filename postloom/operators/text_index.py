"""A full-text index kept as Parquet: postings with places in blocks, and search that skips blocks by their bounds.

A text belongs to one of many ranges (by a hash of its key); a block holds the postings of one lexeme in one range, some
RANGE_ROWS at most: each with its key, the gaps between its places and its weights. Beside them stand the largest number of
places of a posting and the largest weight. Blocks are partitioned by a bucket of the lexeme and sorted by lexeme and
range, so that a query's scan opens its lexemes' buckets and, within these, the row groups of its lexemes.

A query needs one lexeme of each group. The columns of bounds alone tell in which ranges all groups occur, and what rank a
text there can have at most: every cover ends at another place and weighs no more than the largest weight. The best FIRST
ranges are ranked; of the others only those are read whose bound reaches the rank of the last text found.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.operators import lexical
from postloom.sources.tables import stored

RANGE_ROWS, BUCKETS, FIRST, LISTED = 256, 64, 16, 1000


def build(rows: DataFrame, key: str, fields: dict[str, str], path: str, range_rows: int = RANGE_ROWS, buckets: int = BUCKETS) -> None:
    """Writes the index of rows below path; fields as in lexical.token_table. Rows that share a key are one text."""
    ranges = max(1, -(-rows.count() // range_rows))
    twice = stored(rows.groupBy(F.col(key).alias("key")).count().where("count > 1").select("key"))
    some = not twice.isEmpty()
    same = F.col(key).eqNullSafe(twice["key"])
    found = lexical.postings(rows.join(twice, same, "left_anti") if some else rows, key, fields)
    if some:
        found = found.unionByName(_merged_postings(rows.join(twice, same, "left_semi"), key, fields))
    posting = F.struct("key", "gaps", "weights")
    found = found.select("lexeme", F.pmod(F.xxhash64("key"), F.lit(ranges)).cast("int").alias("range"), posting.alias("posting"), "n", "top")
    blocks = found.groupBy("lexeme", "range").agg(F.array_sort(F.collect_list("posting")).alias("postings"), F.max("n").alias("most"), F.max("top").alias("top"))
    blocks = blocks.withColumn("bucket", F.pmod(F.xxhash64("lexeme"), F.lit(buckets)).cast("int"))
    dealt = blocks.repartitionByRange("bucket", "lexeme", "range").sortWithinPartitions("bucket", "lexeme", "range")
    dealt.write.partitionBy("bucket").parquet(f"{path}/blocks")
    rows.sparkSession.createDataFrame([(buckets, rows.schema[key].dataType.simpleString())], "buckets int, kind string").coalesce(1).write.parquet(f"{path}/shape")


def _merged_postings(rows: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """lexical.postings() of rows that share keys: one of a key and a lexeme."""
    hits = lexical.token_table(rows, key, fields).withColumnRenamed(key, "key")
    found = hits.groupBy("lexeme", "key").agg(F.array_sort(F.collect_list(F.struct("at", "weight"))).alias("p"))
    gaps = F.transform(F.col("p"), lambda x, i: x["at"] - F.when(i > 0, F.get(F.col("p.at"), i - 1)).otherwise(0))
    return found.select("key", "lexeme", gaps.alias("gaps"), F.col("p.weight").alias("weights"), F.size("p").alias("n"), F.array_max("p.weight").alias("top"))


def _blocks(spark: SparkSession, path: str, lexemes: list[str]) -> DataFrame:
    """The blocks of some lexemes: their buckets by partition, their rows by pushed filters."""
    shape = spark.read.parquet(f"{path}/shape").first()
    at = spark.createDataFrame([(w,) for w in lexemes], "w string").select(F.pmod(F.xxhash64("w"), F.lit(shape["buckets"])).cast("int").alias("b"))
    own = sorted({r["b"] for r in at.collect()})
    schema = f"lexeme string, range int, postings array<struct<key: {shape['kind']}, gaps: array<int>, weights: array<double>>>, most int, top double, bucket int"
    return spark.read.schema(schema).parquet(f"{path}/blocks").where(F.col("bucket").isin(own) & F.col("lexeme").isin(lexemes))


def bounds(spark: SparkSession, path: str, groups: list[list[str]]) -> DataFrame:
    """Rows (range, bound): the ranges that have a lexeme of every group, with what a text's rank there is at most. Only
    the columns of bounds are read."""
    group_of = {w: k for k, g in enumerate(groups) for w in g}
    number = F.element_at(F.create_map(*[F.lit(x) for w, k in group_of.items() for x in (w, k)]), F.col("lexeme"))
    held = _blocks(spark, path, list(group_of)).select("range", number.alias("g"), "most", "top")
    total = F.sum("most") * F.max("top")
    found = held.groupBy("range").agg(F.count_distinct("g").alias("groups"), total.alias("total"))
    return found.where(F.col("groups") == len(groups)).select("range", F.round(F.col("total") / (F.col("total") + 1) + 1e-9, 9).alias("bound"))


def _ranked(blocks: DataFrame, groups: list[list[str]]) -> DataFrame:
    """Rows (key, rank) of the texts of some blocks that have a lexeme of every group."""
    group_of = {w: k for k, g in enumerate(groups) for w in g}
    posting = blocks.select("lexeme", F.explode("postings").alias("p")).select("p.key", F.struct("lexeme", "p.gaps", "p.weights").alias("x"))
    listed = posting.groupBy("key").agg(F.collect_list("x").alias("w"))

    @F.pandas_udf("double")
    def rank(texts: pd.Series) -> pd.Series:
        def of(row):
            hits = []
            for x in row:
                at = 0
                for gap, weight in zip(x["gaps"], x["weights"], strict=True):
                    at += gap
                    hits.append((at, group_of[x["lexeme"]], weight))
            return lexical.density_of(sorted(hits), len(groups))

        return texts.map(of)

    return listed.select("key", F.round(rank("w"), 9).alias("rank")).where("rank > 0")


def _of_ranges(blocks: DataFrame, ranges: DataFrame) -> DataFrame:
    """The blocks of some ranges: by a pushed filter where these are few, else by a join."""
    few = [r["range"] for r in ranges.select("range").limit(LISTED + 1).collect()]
    return blocks.where(F.col("range").isin(few)) if len(few) <= LISTED else blocks.join(ranges.select("range"), "range", "left_semi")


def search(spark: SparkSession, path: str, key: str, groups: list[list[str]], limit: int) -> DataFrame:
    """Rows (key, rank), as lexical.ranked_search gives them for the rows that were indexed."""
    first, rest = candidates(spark, path, groups, limit)
    if first is None:
        kind = spark.read.parquet(f"{path}/shape").first()["kind"]
        return spark.createDataFrame([], f"key {kind}, rank double").withColumnRenamed("key", key)
    found = first.unionByName(_ranked(rest, lexical.stemmed(groups)))
    return found.withColumnRenamed("key", key).orderBy(F.desc("rank"), key).limit(limit)


def candidates(spark: SparkSession, path: str, groups: list[list[str]], limit: int) -> tuple[DataFrame | None, DataFrame | None]:
    """The best texts of the FIRST ranges by bound, ranked, and the further blocks that may hold one as good as the last
    of them (all others that may hold any, if there are fewer than limit)."""
    wanted = lexical.stemmed(groups)
    if not wanted:
        return None, None
    may = stored(bounds(spark, path, wanted))
    blocks = _blocks(spark, path, sorted({w for g in wanted for w in g}))
    best = stored(may.orderBy(F.desc("bound"), "range").limit(FIRST))
    first = stored(_ranked(_of_ranges(blocks, best), wanted).orderBy(F.desc("rank"), "key").limit(limit))
    last = first.agg(F.count("*"), F.min("rank")).first()
    enough: Column = F.col("bound") >= (last[1] if last[0] >= limit else 0.0)
    further = may.where(enough).join(F.broadcast(best.select("range")), "range", "left_anti")  # FIRST rows
    return first, _of_ranges(blocks, further)
