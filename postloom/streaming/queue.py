"""A job queue over streams: the state of each job by key, with timers that give back what a worker has kept too long.

Actions (job_id, conversation, priority, action, at) are submit, take, ack and nack. A job's state lives with its key, so
that jobs are spread over all tasks. A job that was taken and neither acknowledged nor handed back within `hold` seconds is
pending again; one that was taken `attempts` times and came back once more is a dead letter, with a row of its own. Timers
run by processing time, or by event time where a log is read again: then the watermark moves them.

Changes of states go to a keyed table (sources/sink.py), a batch at a time and each once; next_jobs() deals out of it, with
a bound on what is in flight and one job a conversation.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from postloom.sources.sink import KeyedTable
from postloom.streaming.jobs import MOST_ATTEMPTS, STALE_S, lane

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "status string, attempts int, conversation string, priority int, created long, step long, timer long"
CHANGES = "job_id string, status string, attempts int, conversation string, priority int, created long, step long, why string"
ACTIONS = "job_id string, conversation string, priority int, action string, at timestamp"
_ENDED = ("completed", "dead_letter")


class JobState(StatefulProcessor):
    """One job: its actions in order of time, and the timer of the worker that has it."""

    def __init__(self, hold: int, attempts: int, by_event: bool):
        self.hold, self.attempts, self.by_event = hold, attempts, by_event

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", STATE)

    def _held(self) -> dict | None:
        names = [f.split()[0] for f in STATE.split(", ")]
        return dict(zip(names, self.job.get(), strict=True)) if self.job.exists() else None

    def _keep(self, job: dict) -> None:
        self.job.update(tuple(job.values()))

    def _row(self, key, job: dict, why: str) -> dict:
        return {"job_id": key[0], **{k: v for k, v in job.items() if k != "timer"}, "why": why}

    def _back(self, job: dict) -> None:
        job["status"] = "dead_letter" if job["attempts"] >= self.attempts else "pending"

    def _move(self, job: dict | None, row, now: int) -> dict | None:
        """The job after an action, or None where the action has no effect."""
        if row.action == "submit":
            if job is not None:
                return None
            return {"status": "pending", "attempts": 0, "conversation": row.conversation, "priority": int(row.priority), "created": int(row.at.timestamp() * 1000), "step": 1, "timer": 0}
        if job is None or job["status"] in _ENDED or (row.action == "take") != (job["status"] == "pending"):
            return None
        if job["timer"]:
            self.handle.deleteTimer(job["timer"])
        job |= {"step": job["step"] + 1, "timer": 0}
        if row.action == "take":
            job |= {"status": "processing", "attempts": job["attempts"] + 1, "timer": now + self.hold * 1000}
            self.handle.registerTimer(job["timer"])
        elif row.action == "ack":
            job["status"] = "completed"
        else:
            self._back(job)
        return job

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        job, out = self._held(), []
        for row in pd.concat(list(rows)).sort_values(["at", "action"], kind="stable").itertuples():
            now = int(row.at.timestamp() * 1000) if self.by_event else timerValues.getCurrentProcessingTimeInMs()
            moved = self._move(job, row, now)
            if moved is not None:
                job = moved
                out.append(self._row(key, job, row.action))
        if out:
            self._keep(job)
        yield pd.DataFrame(out, columns=[f.split()[0] for f in CHANGES.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        job, out = self._held(), []
        if job is not None and job["status"] == "processing" and job["timer"] == expiredTimerInfo.getExpiryTimeInMs():
            job |= {"step": job["step"] + 1, "timer": 0}
            self._back(job)
            self._keep(job)
            out.append(self._row(key, job, "timer"))
        yield pd.DataFrame(out, columns=[f.split()[0] for f in CHANGES.split(", ")])

    def close(self) -> None:
        pass


def changes(actions: DataFrame, hold: int = STALE_S, attempts: int = MOST_ATTEMPTS, by_event: bool = False, delay: str = "0 seconds") -> DataFrame:
    """The changes of jobs that a stream of actions makes: rows (job_id, status, attempts, conversation, priority, created,
    step, why), step counting a job's changes."""
    actions.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    timed = actions.withWatermark("at", delay) if by_event else actions
    return timed.groupBy("job_id").transformWithStateInPandas(statefulProcessor=JobState(hold, attempts, by_event), outputStructType=CHANGES, outputMode="Update", timeMode="EventTime" if by_event else "ProcessingTime")


class Queue:
    """The tables of a queue below a path: the jobs' last states, and the dead letters."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.path = path.rstrip("/")
        self.jobs = KeyedTable(spark, f"{self.path}/jobs", CHANGES, ["job_id"], version="step", buckets=buckets)
        self.dead = KeyedTable(spark, f"{self.path}/dead", CHANGES, ["job_id"], version="step", buckets=buckets)

    def follow(self, actions: DataFrame, hold: int = STALE_S, attempts: int = MOST_ATTEMPTS, by_event: bool = False, **trigger) -> StreamingQuery:
        """Runs the stream into the tables; started again on the same path it goes on where it was."""

        def put(batch: DataFrame, number: int) -> None:
            batch = batch.persist()
            self.dead.upsert(batch.where("status = 'dead_letter'"), "queue", number)
            self.jobs.upsert(batch, "queue", number)
            batch.unpersist()

        out = changes(actions, hold, attempts, by_event)
        return out.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", f"{self.path}/state").trigger(**(trigger or {"availableNow": True})).start()


def next_jobs(states: DataFrame, bound: int) -> DataFrame:
    """The jobs to deal out next: pending ones by lane and age, one a conversation and none of a conversation that is in
    flight, as many as the bound leaves beside what is in flight (0 if that is more)."""
    flying = states.where("status = 'processing'")
    free = max(0, bound - flying.count())
    waiting = states.where("status = 'pending'").join(flying.select("conversation").distinct(), "conversation", "left_anti")
    rank = F.when(lane(F.col("priority")) == "high", 0).when(lane(F.col("priority")) == "normal", 1).otherwise(2)
    first = waiting.groupBy("conversation").agg(F.min(F.struct(rank.alias("lane"), "created", "job_id")).alias("j"))
    return first.select(F.col("j.job_id").alias("job_id"), "conversation", F.col("j.lane").alias("lane"), F.col("j.created").alias("created")).orderBy("lane", "created", "job_id").limit(free)
