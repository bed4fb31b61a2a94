"""A trigram index of names, kept as Parquet: names meet only those candidates that may be similar enough.

The similarity of names of a and b distinct trigrams that share c is c / (a + b - c). Where it is over `least`, c is at
least the whole number t above least * (a + b) / (1 + least), which for the fewest b that can do is above least * a. Of a
name's trigrams, rarest first, all but t - 1 must then hold a shared one, so that only these are looked up, and of their
postings only those of names with a fitting number of trigrams. Candidates are compared by their trigrams themselves.
Equal names are indexed, asked for and compared once; of each, only the first few members can be among a query's best.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postloom.operators.graph import TRIGRAM_LEAST, trigrams
from postloom.sources.tables import stored

BUCKETS = 64


def _bucket(column: str):
    return F.pmod(F.xxhash64(column), F.lit(BUCKETS)).cast("int")


def build(names: DataFrame, key: str, name: str, path: str, keep: tuple[str, ...] = ()) -> None:
    """Writes below path: `members` (name, id and the columns to keep), `names` (id, name, grams; each name once, by the
    smallest id of its members), `postings` (gram, n, id) by bucket of the trigram and sorted by trigram and n, and
    `counts` (gram, names)."""
    names.select(F.col(name).alias("name"), F.col(key).alias("id"), *keep).write.parquet(f"{path}/members")
    rows = names.groupBy(F.col(name).alias("name")).agg(F.min(key).alias("id"))
    rows = rows.select("id", "name", F.coalesce(trigrams(F.col("name")), F.array().cast("array<string>")).alias("grams"))
    rows.write.parquet(f"{path}/names")
    stored = names.sparkSession.read.schema(rows.schema).parquet(f"{path}/names")
    postings = stored.select(F.explode("grams").alias("gram"), F.size("grams").alias("n"), "id").withColumn("bucket", _bucket("gram"))
    postings.repartitionByRange("bucket", "gram", "n", "id").sortWithinPartitions("bucket", "gram", "n").write.partitionBy("bucket").parquet(f"{path}/postings")
    stored.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("names")).write.parquet(f"{path}/counts")


def candidates(spark: SparkSession, path: str, asked: DataFrame, least: float = TRIGRAM_LEAST) -> DataFrame:
    """Rows (query_id, grams, id): the names, by the smallest id of each, that each of asked (query_id, name) meets."""
    own = asked.select("query_id", trigrams(F.col("name")).alias("grams")).where(F.size("grams") > 0)
    each = own.select("query_id", F.size("grams").alias("a"), F.explode("grams").alias("gram"))
    ranked = each.join(spark.read.parquet(f"{path}/counts"), "gram", "left")
    rarest = Window.partitionBy("query_id").orderBy(F.coalesce("names", F.lit(0)), "gram")  # a name's trigrams
    looked_up = F.col("place") <= F.col("a") - F.floor(F.col("a") * least)
    ranked = ranked.withColumn("place", F.row_number().over(rarest)).where(looked_up & F.col("names").isNotNull()).withColumn("bucket", _bucket("gram"))
    postings = spark.read.parquet(f"{path}/postings")
    fits = (F.col("n") > F.col("a") * least) & (F.col("n") * least < F.col("a"))
    enough = F.floor((F.col("a") + F.col("n")) * least / (1 + least)) + 1  # shared ones of names of these sizes
    met = ranked.join(postings, ["bucket", "gram"]).where(fits & (F.col("place") <= F.col("a") - enough + 1))
    return met.select("query_id", "id").distinct().join(own, "query_id")


def similar(spark: SparkSession, path: str, asked: DataFrame, limit: int, order: tuple[str, ...] = (), least: float = TRIGRAM_LEAST) -> DataFrame:
    """Rows (query_id, rank, id, name, similarity): for each of asked (query_id, name), the most similar names over least,
    ties by the columns of order (each descending), then by id."""
    names = spark.read.parquet(f"{path}/names").withColumnRenamed("grams", "theirs")
    once = asked.select(F.col("name").alias("query_id"), "name").distinct()
    met = candidates(spark, path, once, least).join(names, "id")
    shared, either = F.size(F.array_intersect("grams", "theirs")), F.size(F.array_union("grams", "theirs"))
    met = stored(met.select(F.col("query_id").alias("asked"), "name", F.round(shared / either, 6).alias("similarity")).where(F.col("similarity") > least))
    by = [*[F.desc(c) for c in order], "id"]
    members = spark.read.parquet(f"{path}/members").join(met.select("name").distinct(), "name", "left_semi")
    members = members.withColumn("rank", F.row_number().over(Window.partitionBy("name").orderBy(*by))).where(F.col("rank") <= limit).drop("rank")
    best = Window.partitionBy("asked").orderBy(F.desc("similarity"), *by)
    found = met.join(members, "name").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)
    queries = asked.select("query_id", F.col("name").alias("asked"))
    return queries.join(found, "asked").select("query_id", "rank", "id", "name", "similarity")
