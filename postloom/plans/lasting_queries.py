"""Queries whose writes last: keyed tables fed by streams (S-18, W-02), incremental indexing (W-12, Y-23, Z-07), the queue
(Z-02) and event time (Z-11). The given tables are written to the shared folder as the files of a stream, in an order of
arrival that the queries state, and read a file a trigger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.operators import incremental
from postloom.plans.registry import query, table
from postloom.sources.sink import KeyedTable
from postloom.sources.tables import new_path
from postloom.streaming import event_time, queue

_PARTS = 6


def _arriving(spark: SparkSession, rows: DataFrame, part: F.Column, parts: int = _PARTS) -> DataFrame:
    """rows as a stream of `parts` triggers, in the order of a number from 0."""
    folder = new_path(spark, "arriving")
    for k in range(parts):
        rows.where(part == k).coalesce(1).write.parquet(f"{folder}/{k}")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


@query("SELECT user_id, event_id, event_type, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def s18_upsert_stream(spark, sf_dir):
    """The newest event of each user in a keyed table that a stream is merged into, batch by batch."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    path = new_path(spark, "sink")
    newest = KeyedTable(spark, f"{path}/table", e.schema, ["user_id"], version="event_id", buckets=16)
    part = F.pmod(F.col("event_id") * 7, F.lit(_PARTS))  # so that old events come after new ones
    newest.follow(_arriving(spark, e, part), "events", f"{path}/state").awaitTermination()
    return newest.rows().select("user_id", "event_id", "event_type", F.round("value", 6).alias("value"))


@query(
    """WITH n AS (SELECT doc_id, text, doc_id % 5 <> 0 AS was, CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END AS old, doc_id % 11 <> 0 AS stays FROM documents)
SELECT doc_id, CASE WHEN NOT was THEN 'insert' WHEN NOT stays THEN 'delete' WHEN coalesce(old, '') <> coalesce(text, '') THEN 'update' END AS change,
  CASE WHEN stays THEN CAST(ceil(coalesce(length(text), 0) / 600.0) AS BIGINT) ELSE 0 END AS chunks FROM n WHERE was OR stays"""
)
def y23_incremental_index(spark, sf_dir):
    """What a second run over a changed tree finds (insert, update, delete, or null for what it leaves alone), and the
    chunks that each document then has in the index."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text", F.lit("2024-01-01").cast("timestamp").alias("modified"))
    index = incremental.IncrementalIndex(spark, new_path(spark, "index"))
    before = d.where("key % 5 <> 0").withColumn("text", F.when(F.col("key") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    index.run(before, 0)
    feed = index.run(d.where("key % 11 <> 0"), 1)
    chunks = index.chunks.rows().groupBy("key").agg(F.count("*").alias("chunks"))
    held = index.documents.rows().select("key").union(feed.select("key")).distinct()
    out = held.join(feed, "key", "left").join(chunks, "key", "left")
    return out.select(F.col("key").alias("doc_id"), "change", F.coalesce("chunks", F.lit(0)).cast("long").alias("chunks"))


@query()
def z02_queue_stream(spark, sf_dir):
    """Each user's events as actions on a job (signup submits, view takes, purchase acknowledges, error hands back) through
    the queue's stream, by event time. No SQL, as a state depends on the one before and on timers; tests hold the queue
    against a plain replay."""
    names = {"signup": "submit", "view": "take", "purchase": "ack", "error": "nack"}
    action = F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("event_type"))
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin(list(names)))
    rows = e.select(F.col("user_id").cast("string").alias("job_id"), F.col("user_id").cast("string").alias("conversation"), F.lit(0).alias("priority"), action.alias("action"), F.col("ts").cast("timestamp").alias("at"))
    part = F.pmod(F.floor(F.unix_timestamp("at") / (5 * 86400)), F.lit(_PARTS))
    q = queue.Queue(spark, new_path(spark, "queue"))
    q.follow(_arriving(spark, rows, part), by_event=True).awaitTermination()
    return q.jobs.rows().select("job_id", "status", "attempts", "why")


_ARRIVED = """p AS (SELECT *, CAST(least(5, greatest(0, floor((epoch(ts) - 1704067200) / 432000))) AS INTEGER) + CASE WHEN event_id % 10 = 0 THEN 2 ELSE 0 END AS part FROM events),
m AS (SELECT part, max(ts) AS top FROM p GROUP BY part)"""


def _delayed(e: DataFrame) -> DataFrame:
    """events with the trigger that each arrives at: every tenth comes two triggers late."""
    part = F.least(F.lit(_PARTS - 1), F.greatest(F.lit(0), F.floor((F.unix_timestamp("ts") - 1704067200) / 432000)))  # five days each
    return e.withColumn("part", part + F.when(F.col("event_id") % 10 == 0, 2).otherwise(0))


@query(
    f"""WITH {_ARRIVED}, r AS (SELECT p.*, (SELECT max(top) FROM m WHERE m.part <= p.part - 2) - INTERVAL 1 DAY AS mark FROM p)
SELECT date_trunc('day', ts) AS start, event_type AS key, count(*) AS n, round(sum(value), 4) AS total FROM r WHERE mark IS NULL OR date_trunc('day', ts) + INTERVAL 1 DAY > mark GROUP BY 1, 2"""
)
def z11_stream_windows(spark, sf_dir):
    """Daily counts over a stream in which every tenth row comes two triggers late, with a watermark of one day: the same
    as SQL over the rows whose day had not ended before the watermark that their trigger began with."""
    e = _delayed(table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value"))
    path = new_path(spark, "windows")
    days = KeyedTable(spark, f"{path}/table", "start timestamp, key string, n long, total double", ["start", "key"], version="n", buckets=8)
    event_time.windows_into(days, _arriving(spark, e, F.col("part"), _PARTS + 2), "ts", "event_type", "value", "1 day", "1 day", f"{path}/state").awaitTermination()
    return days.rows().select(F.col("start").cast("timestamp_ntz").alias("start"), "key", "n", F.round("total", 4).alias("total"))


@query(
    """SELECT p.event_id, v.event_id AS view_id FROM events p JOIN events v ON v.user_id = p.user_id AND v.event_type = 'view' AND v.ts <= p.ts AND v.ts >= p.ts - INTERVAL 6 HOUR
WHERE p.event_type = 'purchase'"""
)
def z11_stream_join(spark, sf_dir):
    """Purchases with the views of the same user in the six hours before, joined as two streams."""
    e = _delayed(table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type"))
    views = _arriving(spark, e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), F.col("ts").alias("seen"), "part"), F.col("part"), _PARTS + 2).drop("part")
    bought = _arriving(spark, e.where("event_type = 'purchase'").select("user_id", "event_id", "ts", "part"), F.col("part"), _PARTS + 2).drop("part")
    path = new_path(spark, "joined")
    out = event_time.joined_within(views, bought, "user_id", "seen", "ts", "6 HOURS", "20 days").select("event_id", "view_id")
    out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/out")
