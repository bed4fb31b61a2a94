"""Queries of the job log (Z) and of streams over events; streams run over the table as one bounded batch."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from postloom.plans.registry import query, table
from postloom.sources.tables import shared_folder
from postloom.streaming import jobs


def _actions(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    action = F.element_at(F.array(*map(F.lit, ["submit", "take", "nack", "take", "ack"])), (F.floor(F.col("event_id") / 700) % 5 + 1).cast("int"))
    return e.select((F.col("event_id") % 700).cast("string").alias("job_id"), action.alias("action"), F.col("event_id").cast("double").alias("at"))


@query(
    """SELECT event_id, CASE WHEN p > 5 THEN 'high' WHEN p < -5 THEN 'low' ELSE 'normal' END AS lane FROM (SELECT event_id, ts, event_id % 21 - 10 AS p FROM events)
ORDER BY CASE WHEN p > 5 THEN 0 WHEN p < -5 THEN 2 ELSE 1 END, ts, event_id LIMIT 500"""
)
def z01_queue_order(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("job_id"), (F.col("event_id") % 21 - 10).alias("priority"), F.col("ts").alias("created"))
    return jobs.queue_order(e, 500).select(F.col("job_id").alias("event_id"), "lane")


@query()
def z02_job_states(spark, sf_dir):
    """Each job's state after its actions; no SQL, as a state depends on the one before it."""
    return jobs.batch_states(_actions(spark, sf_dir))


@query("SELECT event_type AS status, count(*) AS n FROM events GROUP BY event_type")
def z03_status_counts(spark, sf_dir):
    """Counts by status over a stream of the events table, read to its end."""
    folder = f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events")
    events.select("event_type").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(events.select("event_type").schema).parquet(f"{folder}/in")
    name = f"status_{uuid.uuid4().hex}"
    counts = jobs.status_counts(stream.withColumnRenamed("event_type", "status"))
    counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).select("status", F.col("count").alias("n"))


@query("SELECT event_id FROM events WHERE event_type = 'purchase' AND TIMESTAMP '2024-02-01' - ts > INTERVAL 1 DAY")
def z04_expired(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "purchase", "completed").otherwise("pending").alias("status"), F.col("ts").alias("completed_at"))
    return jobs.expired(e, F.lit("2024-02-01").cast("timestamp")).select("event_id")


@query("SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY event_id) = 1")
def z05_in_flight_dedup(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.concat_ws(":", F.col("user_id").cast("string"), F.date_trunc("hour", "ts").cast("string")).alias("k"))
    return jobs.first_by_key(e, "k", "event_id").select("event_id", "user_id")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def z11_windowed_counts(spark, sf_dir):
    return jobs.windowed_counts(table(spark, sf_dir, "events"), "ts")


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k"""
)
def z11_sessions(spark, sf_dir):
    return jobs.sessions(table(spark, sf_dir, "events"))
