"""Event time in streams: windows with a watermark into a keyed table, late rows counted, and joins of two streams."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from postloom.sources.sink import KeyedTable


def windows_into(table: KeyedTable, stream: DataFrame, time_col: str, key: str, value: str, delay: str, width: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Counts and sums by window and key into table (start, key, n, total; keyed by start and key, with n as version). Rows
    whose window ended before the watermark are late and left out; ended windows leave the state, while their rows stay
    in the table. How many rows came is observed, so that late_rows() can tell how many were late."""
    timed = stream.observe("came", F.count(F.lit(1)).alias("rows")).withWatermark(time_col, delay)
    out = timed.groupBy(F.window(time_col, width).alias("w"), F.col(key).alias("key")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    out = out.select(F.col("w.start").alias("start"), "key", "n", "total")

    def put(batch: DataFrame, number: int) -> None:
        table.upsert(batch, "windows", number)

    return out.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def progress(query: StreamingQuery) -> list[dict]:
    """What each trigger of a query reported."""
    return [p if isinstance(p, dict) else json.loads(p.json) for p in query.recentProgress]


def late_rows(query: StreamingQuery, table: KeyedTable) -> int:
    """Rows that came to windows_into() less those that its windows count."""
    came = sum(p["observedMetrics"]["came"]["rows"] for p in progress(query) if "came" in (p.get("observedMetrics") or {}))
    return came - (table.rows().agg(F.sum("n")).first()[0] or 0)


def evicted_rows(query: StreamingQuery) -> int:
    """Rows of state that the watermark removed."""
    return sum(s.get("numRowsRemoved", 0) for p in progress(query) for s in p.get("stateOperators", []))


def joined_within(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, within: str, delay: str) -> DataFrame:
    """Rows of right with the rows of left of the same key that came at most `within` before. Both streams' watermarks and
    the bound let Spark drop what no later row can meet. Columns of the two must differ but for the key."""
    a = left.withWatermark(left_time, delay).withColumnRenamed(key, "left_key")
    b = right.withWatermark(right_time, delay)
    near = (F.col("left_key") == F.col(key)) & (F.col(left_time) <= F.col(right_time)) & (F.col(left_time) >= F.col(right_time) - F.expr(f"INTERVAL {within}"))
    return b.join(a, near).drop("left_key")
