"""Tables in the shared folder that the session names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

BATCH_BYTES = 4 << 20
_DEFAULT_BATCH = "67108864b"


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors see. Where it is unset, a session whose tasks run in this
    process gets a folder of its own; any other is refused, as its executors would not see that."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        base = tempfile.mkdtemp(prefix="postloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def small_batches(df: DataFrame) -> DataFrame:
    """df, with its session set to hand texts to Python in batches of some BATCH_BYTES, as rows may be long and an executor
    holds batches for each of its tasks. A plan reads the setting when it runs, so that it stays; a session that has its
    own keeps it."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key) == _DEFAULT_BATCH:
        conf.set(key, str(BATCH_BYTES))
    return df


def small_batches(df: DataFrame) -> DataFrame:
    """df, with its session set to hand texts to Python in batches of some BATCH_BYTES, as rows may be long and an executor
    holds batches for each of its tasks. A plan reads the setting when it runs, so that it stays; a session that has its
    own keeps it."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key) == _DEFAULT_BATCH:
        conf.set(key, str(BATCH_BYTES))
    return df


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet to a new path in the shared folder and read again: its lineage ends there."""
    path = new_path(df.sparkSession, "table")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spare(name: str, *frames: DataFrame) -> str:
    """The name, with as many `_` behind it as keep it apart from the frames' columns (but for case)."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name
