"""Streams by event time over input out of order: late rows are counted, state is evicted, joins meet."""

import datetime
import time

from postloom.sources.sink import KeyedTable
from postloom.streaming import event_time

DAY = datetime.datetime(2024, 5, 1, tzinfo=datetime.timezone.utc)


def _stream(spark, folder, batches, schema):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{k}")
        time.sleep(0.05)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def _at(minutes):
    return DAY + datetime.timedelta(minutes=minutes)


def test_windows_leave_out_late_rows_and_count_them(spark, tmp_path):
    batches = [[("a", float(m), _at(m)) for m in range(k * 60, k * 60 + 60, 5)] for k in range(6)]
    batches[2].append(("a", 100.0, _at(50)))  # its window may still be open
    batches[5] += [("a", 1000.0, _at(3)), ("b", 1000.0, _at(61)), ("b", 7.0, _at(340))]
    t = KeyedTable(spark, f"{tmp_path}/t", "start timestamp, key string, n long, total double", ["start", "key"], version="n", buckets=2)
    q = event_time.windows_into(t, _stream(spark, f"{tmp_path}/in", batches, "k string, v double, ts timestamp"), "ts", "k", "v", "60 minutes", "30 minutes", f"{tmp_path}/state")
    q.awaitTermination()
    want = {}
    for k, rows in enumerate(batches):
        mark = max((r[2] for b in batches[: max(0, k - 1)] for r in b), default=_at(-9999)) - datetime.timedelta(minutes=60)
        for key, v, ts in rows:
            start = _at(int((ts - DAY).total_seconds() // 1800) * 30)
            if start + datetime.timedelta(minutes=30) > mark:
                n, total = want.get((start, key), (0, 0.0))
                want[start, key] = (n + 1, total + v)
    got = {(r["start"].replace(tzinfo=None), r["key"]): (r["n"], r["total"]) for r in t.rows().collect()}
    local = {(datetime.datetime.fromtimestamp(s.timestamp()), k): v for (s, k), v in want.items()}
    assert got == local and sum(n for n, _ in want.values()) == sum(map(len, batches)) - 2
    assert event_time.late_rows(q, t) == 2 and event_time.evicted_rows(q) > 0


def test_streams_join_within_a_span_and_forget(spark, tmp_path):
    views = [[("u", 10 * k + i, _at(k * 100 + i * 10)) for i in range(4)] for k in range(5)]
    bought = [[("u", 500 + k, _at(k * 100 + 35)), ("x", 600 + k, _at(k * 100))] for k in range(5)]
    a = _stream(spark, f"{tmp_path}/a", views, "user string, view long, seen timestamp")
    b = _stream(spark, f"{tmp_path}/b", bought, "user string, buy long, ts timestamp")
    out = event_time.joined_within(a, b, "user", "seen", "ts", "20 MINUTES", "30 minutes").select("user", "buy", "view")
    q = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r["buy"], r["view"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == sorted((500 + k, 10 * k + i) for k in range(5) for i in (2, 3))
    assert event_time.evicted_rows(q) > 0
