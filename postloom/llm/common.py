"""What the operators share: tables in the shared folder, bitmaps, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm.kernels import mix


BATCH_BYTES = 4 << 20
_DEFAULT_BATCH = "67108864b"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see, as spark.checkpoint.dir names it. Where it is unset, a session whose tasks run in
    this process gets a folder of its own; any other session is refused, as executors would not see that."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not base and sc._jsc.sc().getCheckpointDir().isDefined():
        base = sc._jsc.sc().getCheckpointDir().get()
    if not base:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        base = tempfile.mkdtemp(prefix="postloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def small_batches(spark: SparkSession) -> None:
    """Has the session hand texts to Python in batches of about BATCH_BYTES: rows may be long, and an executor holds
    several batches for each of its tasks. The setting is read when a plan runs, which for a result is after the operator
    returned; so it stays, and is only touched where the session has the default."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == _DEFAULT_BATCH:
        spark.conf.set(key, str(BATCH_BYTES))


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Has the executions that begin here give back the disk of their shuffle files as they end, not when the driver next
    happens to collect its garbage. Only for plans that run once; a second run would shuffle anew."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stored(df: DataFrame) -> DataFrame:
    """df cut from its lineage: written as Parquet to a new path in the shared folder and read again, so that a
    lost executor costs no earlier work. Like checkpoints, these tables stay until the folder's owner clears it."""
    path = work_path(df.sparkSession, "stage")
    with shuffles_dropped(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def bits_for(keys: int, most: int = 26) -> int:
    """The size, as a power of two, of a bitmap that lets some 6 % of other keys through; at most 2**most bits."""
    return min(most, max(10, (16 * max(1, keys)).bit_length()))


def bitmap_of(hashes: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bitmap of 2**bits bits with the top bits of each 64-bit hash of a column set. It is only a filter before an
    exact step: where it fills up, it lets more through and loses nothing."""
    slot = f"shiftrightunsigned({column}, {64 - bits})"
    with shuffles_dropped(hashes.sparkSession):
        rows = (
            hashes.selectExpr(f"shiftright({slot}, 6) AS word", f"shiftleft(1L, cast({slot} % 64 AS int)) AS one")
            .groupBy("word")
            .agg(F.expr("bit_or(one)").alias("set"))
            .toArrow()
        )
    out = np.zeros(max(1, 1 << (bits - 6)), np.uint64)
    out[rows["word"].to_numpy()] = rows["set"].to_numpy().astype(np.int64).view(np.uint64)
    del rows
    pa.default_memory_pool().release_unused()
    return out


def id_hash(ids: np.ndarray) -> np.ndarray:
    """The hash by which id_bitmap() knows an id."""
    return mix(ids.astype(np.int64).view(np.uint64), 77)


def hashed_ids(ids: DataFrame) -> DataFrame:
    """Rows (h) with the hashes of ids (one column of longs), by which id bitmaps know them."""

    def hashed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(id_hash(np.asarray(batch.column(0))).view(np.int64))], ["h"])

    return ids.mapInArrow(hashed, "h long")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b), long: rows (node, component), component the smallest node reached.
    Alternating large-star and small-star steps (Kiveris et al. 2014), each one aggregate and one join, until the edges
    are stars and stay so. Nodes of no edge have no row."""
    e = stored(edges.where("a <> b").select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).distinct())
    before, now = None, _state(e)
    while now != before:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stored(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        before, now = now, _state(e)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
