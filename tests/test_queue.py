"""The queue as a stream over several triggers and a restart, against a plain replay; timers, dead letters, the bound."""

import datetime
import random
import time

from postloom.streaming import queue

DAY = datetime.datetime(2024, 5, 1, tzinfo=datetime.timezone.utc)


def _write(spark, folder, batches):
    for k, rows in enumerate(batches):
        spark.createDataFrame([(j, f"c{int(j) % 7}", int(j) % 15 - 7, a, DAY + datetime.timedelta(seconds=s)) for j, a, s in rows], queue.ACTIONS).coalesce(1).write.parquet(f"{folder}/{k}")
        time.sleep(0.05)


def _stream(spark, folder):
    return spark.readStream.schema(queue.ACTIONS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def _replay(batches, hold, attempts):
    """States and dead letters: actions in order of time, timers fired by the largest time of the batches before."""
    jobs, dead, mark = {}, set(), None

    def back(j):
        jobs[j][0] = "dead_letter" if jobs[j][1] >= attempts else "pending"
        if jobs[j][0] == "dead_letter":
            dead.add(j)

    def fire():
        for j, x in jobs.items():
            if x[0] == "processing" and x[2] + hold <= mark:
                back(j)

    for batch in batches:
        for j, a, s in sorted(batch, key=lambda r: (r[2], r[1])):
            x = jobs.get(j)
            if mark is not None and s < mark:
                continue  # behind the watermark
            if a == "submit" and x is None:
                jobs[j] = ["pending", 0, 0]
            elif x and a == "take" and x[0] == "pending":
                jobs[j] = ["processing", x[1] + 1, s]
            elif x and a == "ack" and x[0] == "processing":
                x[0] = "completed"
            elif x and a == "nack" and x[0] == "processing":
                back(j)
        if mark is not None:
            fire()
        mark = max([mark or 0, *(s for _, _, s in batch)])
    fire()
    return {j: (x[0], x[1]) for j, x in jobs.items()}, dead


def test_stream_with_a_restart_equals_a_replay(spark, tmp_path):
    r = random.Random(6)
    batches = []
    for k in range(6):
        rows = [(str(r.randrange(40)), "submit", k * 200 + r.randrange(20)) for _ in range(15)]
        rows += [(str(r.randrange(40)), r.choice(["take", "take", "ack", "nack"]), k * 200 + 30 + r.randrange(170)) for _ in range(60)]
        batches.append(rows)
    _write(spark, f"{tmp_path}/in", batches[:3])
    q = queue.Queue(spark, f"{tmp_path}/q", buckets=4)
    q.follow(_stream(spark, f"{tmp_path}/in"), hold=300, by_event=True).awaitTermination()
    _write(spark, f"{tmp_path}/more", batches[3:])
    for k in range(3):
        (tmp_path / "more" / str(k)).rename(tmp_path / "in" / str(3 + k))
    q.follow(_stream(spark, f"{tmp_path}/in"), hold=300, by_event=True).awaitTermination()
    states, dead = _replay(batches, 300, 3)
    assert {x["job_id"]: (x["status"], x["attempts"]) for x in q.jobs.rows().collect()} == states
    assert {x["job_id"] for x in q.dead.rows().collect()} == dead and dead
    assert {s for s, _ in states.values()} >= {"pending", "processing", "completed", "dead_letter"}


def test_processing_time_gives_a_job_back(spark, tmp_path):
    _write(spark, f"{tmp_path}/in", [[("1", "submit", 0), ("1", "take", 1), ("2", "submit", 1), ("2", "take", 2), ("2", "ack", 3)]])
    q = queue.Queue(spark, f"{tmp_path}/q", buckets=2)
    running = q.follow(_stream(spark, f"{tmp_path}/in"), hold=1, processingTime="500 milliseconds")
    try:
        for _ in range(120):
            rows = {x["job_id"]: (x["status"], x["attempts"], x["why"]) for x in q.jobs.rows().collect()}
            if rows.get("1", ("",))[0] == "pending":
                break
            time.sleep(0.5)
    finally:
        running.stop()
    assert rows == {"1": ("pending", 1, "timer"), "2": ("completed", 1, "ack")}


def test_next_jobs_keep_to_the_bound_and_to_conversations(spark):
    rows = [("a", "processing", "c1", 0, 1), ("b", "pending", "c1", 9, 1), ("c", "pending", "c2", 0, 5), ("d", "pending", "c2", 0, 4), ("e", "pending", "c3", 9, 9), ("f", "pending", "c4", -9, 1), ("g", "completed", "c5", 9, 1)]
    states = spark.createDataFrame(rows, "job_id string, status string, conversation string, priority int, created long")
    for bound, want in ((1, []), (2, ["e"]), (3, ["e", "d"]), (9, ["e", "d", "f"])):
        assert [x["job_id"] for x in queue.next_jobs(states, bound).collect()] == want
