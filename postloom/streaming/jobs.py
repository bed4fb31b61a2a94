"""A job log as a stream: jobs are submitted, taken, acknowledged or handed back, and the state of each is kept by key.

A job's events go to one key's state (its id), so that state is spread over all tasks. Priority orders jobs within a
micro-batch; between batches a stream has no total order. Delivery is at least once: a job that was taken and neither
acknowledged nor handed back within STALE_S seconds may be taken again, and one that failed MOST_ATTEMPTS times is dead.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from postloom.operators.writes import first_of

MOST_ATTEMPTS, STALE_S, KEEP_S = 3, 300, 86_400
HIGH, LOW = 5, -5
STATUSES = ("pending", "processing", "completed", "dead_letter")
_STATE = "status string, attempts int, since double"
_OUT = "job_id string, status string, attempts int"


def lane(priority: Column) -> Column:
    """high, normal or low."""
    return F.when(priority > HIGH, "high").when(priority < LOW, "low").otherwise("normal")


def step(status: str | None, attempts: int, action: str, late: bool) -> tuple[str, int]:
    """The status and attempts of a job after an action: submit, take, ack or nack; late: it was taken too long ago."""
    if status in ("completed", "dead_letter"):
        return status, attempts
    if action == "submit" and status is None:
        return "pending", attempts
    if action == "take" and (status == "pending" or (status == "processing" and late)):
        return ("processing", attempts + 1) if attempts < MOST_ATTEMPTS else ("dead_letter", attempts)
    if action == "ack" and status == "processing":
        return "completed", attempts
    if action == "nack" and status == "processing":
        return ("dead_letter" if attempts >= MOST_ATTEMPTS else "pending"), attempts
    return status or "pending", attempts


def job_states(actions: DataFrame) -> DataFrame:
    """The changing states (job_id, status, attempts) of a stream of actions (job_id, action, at); `at` in seconds. State
    of a job that ended is dropped after KEEP_S seconds without an action."""

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        status, attempts, since = state.get if state.exists else (None, 0, 0.0)
        for row in pd.concat(list(batches)).sort_values("at").itertuples():
            new, attempts = step(status, attempts, row.action, row.at - since >= STALE_S)
            if new == "processing":
                since = float(row.at)
            status = new
        state.update((status, attempts, since))
        state.setTimeoutDuration(KEEP_S * 1000)
        yield pd.DataFrame({"job_id": [key[0]], "status": [status], "attempts": [attempts]})

    return actions.groupBy("job_id").applyInPandasWithState(run, _OUT, _STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)


def batch_states(actions: DataFrame) -> DataFrame:
    """The states after all actions of a finished log: the same rules without a stream."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        status, attempts, since = None, 0, 0.0
        for row in pdf.sort_values("at").itertuples():
            new, attempts = step(status, attempts, row.action, row.at - since >= STALE_S)
            if new == "processing":
                since = float(row.at)
            status = new
        return pd.DataFrame({"job_id": [key[0]], "status": [status], "attempts": [attempts]})

    return actions.groupBy("job_id").applyInPandas(run, _OUT)


def queue_order(jobs: DataFrame, limit: int) -> DataFrame:
    """The next jobs (job_id, priority, created): by lane, then first in first out."""
    rank = F.when(lane(F.col("priority")) == "high", 0).when(lane(F.col("priority")) == "normal", 1).otherwise(2)
    return jobs.withColumn("lane", lane(F.col("priority"))).orderBy(rank, "created", "job_id").limit(limit)


def status_counts(states: DataFrame) -> DataFrame:
    return states.groupBy("status").count()


def expired(states: DataFrame, now: Column) -> DataFrame:
    """Completed jobs (completed_at) to clear."""
    return states.where((F.col("status") == "completed") & (F.unix_timestamp(now) - F.unix_timestamp("completed_at") > KEEP_S))


def windowed_counts(events: DataFrame, time_col: str, delay: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Event-time counts and sums by type, with late events let in up to a delay; the same for streams and tables."""
    timed = events.withWatermark(time_col, delay)
    out = timed.groupBy(F.window(time_col, width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of each user between gaps."""
    out = events.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_by_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key: what a stream's dropDuplicatesWithinWatermark keeps, for a table."""
    return first_of(rows, [key], [order])
