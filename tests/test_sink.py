"""Keyed tables under replays and deaths, the change feed and the incremental index."""

import datetime

import pytest
from pyspark.sql import functions as F

from postloom.operators import embedding, incremental
from postloom.sources.sink import KeyedTable


def _table(spark, tmp_path, **more):
    return KeyedTable(spark, f"{tmp_path}/t", "id long, v long, s string", ["id"], version="v", buckets=8, **more)


def _rows(table):
    return sorted(map(tuple, table.rows().collect()))


def _batch(spark, rows, columns="id long, v long, s string, gone boolean"):
    return spark.createDataFrame(rows, columns)


def test_upsert_takes_each_batch_once_and_touches_its_buckets(spark, tmp_path):
    t = _table(spark, tmp_path)
    assert _rows(t) == [] and t.commits() == []
    first = _batch(spark, [(i, 1, "a", False) for i in range(100)] + [(5, 2, "newer", None)])
    assert t.upsert(first, "s", 0) and len(_rows(t)) == 100 and (5, 2, "newer") in _rows(t)
    before = t.state()["folders"]
    second = _batch(spark, [(7, 3, "b", False), (8, 0, "older", False), (9, 4, None, True), (200, 1, "new", False)])
    assert t.upsert(second, "s", 1, "gone")
    want = {i: (i, 1, "a") for i in range(100)} | {5: (5, 2, "newer"), 7: (7, 3, "b"), 200: (200, 1, "new")}
    del want[9]
    assert _rows(t) == sorted(want.values())
    same = [b for b, f in t.state()["folders"].items() if before[b] == f]
    assert len(same) >= 4
    assert not t.upsert(first, "s", 1) and not t.upsert(first, "s", 0) and _rows(t) == sorted(want.values())
    assert t.upsert(second, "other", 0, "gone") and _rows(t) == sorted(want.values())
    assert sorted(map(tuple, t.rows(1).collect())) != _rows(t)
    assert t.clear(1) >= 1 and _rows(t) == sorted(want.values()) and t.commits() == [3]


def test_a_killed_batch_leaves_no_trace(spark, tmp_path, monkeypatch):
    t = _table(spark, tmp_path)
    t.upsert(_batch(spark, [(i, 1, "a", False) for i in range(20)]), "s", 0)
    before = _rows(t)

    def dies(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "_commit", dies)
        with pytest.raises(KeyboardInterrupt):
            t.upsert(_batch(spark, [(1, 2, "b", False)]), "s", 1)
    assert _rows(t) == before and t.commits() == [1]
    assert t.upsert(_batch(spark, [(1, 2, "b", False)]), "s", 1) and (1, 2, "b") in _rows(t)
    assert t.clear() == 1
    with pytest.raises(RuntimeError):
        t._commit(t.commits()[-1], {})


def test_replace_by_group(spark, tmp_path):
    t = KeyedTable(spark, f"{tmp_path}/g", "g string, id long", ["g", "id"], by=["g"], buckets=4)
    t.replace(_batch(spark, [("a", 1), ("a", 2), ("b", 1)], "g string, id long"), _batch(spark, [("a",), ("b",)], "g string"), "s", 0)
    t.replace(_batch(spark, [("a", 3), ("c", 9)], "g string, id long"), _batch(spark, [("a",), ("b",)], "g string"), "s", 1)
    assert _rows(t) == [("a", 3)]


def test_a_stream_that_is_stopped_and_replayed(spark, tmp_path, monkeypatch):
    rows = [(i % 50, i, f"r{i}") for i in range(600)]
    for k in range(6):
        spark.createDataFrame(rows[k * 100 : k * 100 + 100], "id long, v long, s string").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    t = _table(spark, tmp_path)
    stream = lambda: spark.readStream.schema("id long, v long, s string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    real, calls = KeyedTable.upsert, []

    def late_death(self, *a, **b):
        out = real(self, *a, **b)
        calls.append(out)
        if len(calls) == 3:
            raise RuntimeError("died after the commit")
        return out

    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "upsert", late_death)
        with pytest.raises(Exception, match="died after"):
            t.follow(stream(), "in", f"{tmp_path}/state").awaitTermination()
        assert len(t.commits()) == 3
        t.follow(stream(), "in", f"{tmp_path}/state").awaitTermination()
    assert calls[:4] == [True, True, True, False] and len(t.commits()) == 6
    assert _rows(t) == sorted((i % 50, i, f"r{i}") for i in range(550, 600))


def test_incremental_runs_equal_a_full_build(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def counting(texts):
        made.add(len(texts))
        return embedding.hashed(texts)

    day = datetime.datetime(2024, 1, 1)
    old = [(i, f"text {i} " * (i * 9), day) for i in range(40)] + [(41, None, day), (42, " ", day)]
    new = [(i, t + ("more" if i % 8 == 0 else ""), day + datetime.timedelta(1)) if t else (i, t, day) for i, t, _ in old if i % 5] + [(90, "late words", day), (41, "now some", day)]
    new = [r for r in {r[0]: r for r in new}.values()]
    frames = [spark.createDataFrame(rows, "key long, text string, modified timestamp") for rows in (old, new)]
    index = incremental.IncrementalIndex(spark, f"{tmp_path}/a", embed=counting)
    feed = {r["key"]: r["change"] for r in index.run(frames[0], 0).collect()}
    assert set(feed.values()) == {"insert"} and len(feed) == 42
    first = made.value
    feed = {r["key"]: r["change"] for r in index.run(frames[1], 1).collect()}
    was, now = {r[0]: r[1] for r in old}, {r[0]: r[1] for r in new}
    assert feed == {k: "delete" if k not in now else "insert" if k not in was else "update" for k in was.keys() | now.keys() if k not in was or k not in now or (was[k] or "") != (now[k] or "")}
    again = made.value - first
    full = incremental.IncrementalIndex(spark, f"{tmp_path}/b")
    full.run(frames[1], 0)
    rows = lambda x: sorted((r["key"], r["position"], r["text"], r["status"], tuple(r["embedding"] or ())) for r in x.chunks.rows().collect())
    assert rows(index) == rows(full) and len(rows(full)) > 40
    changed = {k for k, c in feed.items() if c != "delete"}
    assert again == sum(r[0] in changed and r[3] != "blank" for r in rows(full))
    assert index.run(frames[1], 2).count() == 0 and made.value - first == again
    assert index.run(frames[0], 2).count() == len(feed)
