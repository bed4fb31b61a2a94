"""The index of proximity graphs: recall on the given vectors and on clustered ones, and the exact search beside it."""

import os

import numpy as np
import pytest

from postloom.operators import proximity, vector
from postloom.plans import catalog

GIVEN = "/root/testdata/sf0.1"


def _cosines(vectors, step=20):
    unit = proximity.units(vectors)
    near = unit[::step] @ unit.T
    near[np.arange(len(near)), np.arange(0, len(unit), step)] = -2
    return near


def _hits(rows, near, k):
    last = -np.sort(-near, 1)[:, k - 1]
    return sum(near[r["query_id"] // 20, r["id"]] >= last[r["query_id"] // 20] - 1e-6 for r in rows)


def _write(spark, path, vectors, more=()):
    rows = [(i, v.tolist()) for i, v in enumerate(vectors.astype(np.float32))]
    spark.createDataFrame([*rows, *more], "vec_id long, embedding array<float>").write.parquet(str(path))
    return spark.read.parquet(str(path))


@pytest.mark.skipif(not os.path.exists(GIVEN), reason="needs the given tables")
def test_recall_on_the_given_vectors(spark, tmp_path):
    e = spark.read.parquet(f"{GIVEN}/embeddings.parquet")
    m = np.array([r["embedding"] for r in e.orderBy("vec_id").collect()])
    got = catalog.QUERIES["v06_approximate_nearest"](spark, GIVEN).collect()
    assert len(got) == 10 * len(m[::20]) and _hits(got, _cosines(m), 10) >= 0.9 * len(got)
    vector.build_index(e, f"{tmp_path}/index", 64)
    held = vector.search_index(e.where("vec_id % 20 = 0"), f"{tmp_path}/index", 10, 64).select("query_id", "held").distinct().collect()
    assert len(held) == len(m[::20]) and max(r["held"] for r in held) < 0.1 * len(m)


def test_recall_with_many_shards_and_one_vector_as_a_third(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector, "SHARD", 256)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 64))
    vectors = centres[rng.integers(0, 40, 4000)] + 0.5 * rng.normal(size=(4000, 64))
    vectors[700:2000] = vectors[0]
    e = _write(spark, tmp_path / "e", vectors, [(5000, None), (5020, [1.0] * 3), (5040, [0.0] * 64), (5060, [float("nan")] * 64)])
    path = f"{tmp_path}/index"
    vector.build_index(e, path, 64)
    shards = spark.read.parquet(f"{path}/shards")
    assert shards.count() > 10 and shards.agg({"n": "sum"}).first()[0] == 4001 and shards.agg({"n": "max"}).first()[0] < 1024
    asked = e.where("vec_id % 20 = 0")
    near = _cosines(vectors.astype(np.float32))
    got = [r for r in vector.search_index(asked, path, 10, 64, ef=64, probed=6).collect() if r["query_id"] < 4000]
    assert len(got) == 2000 and _hits(got, near, 10) >= 0.9 * 2000
    zero = [r["id"] for r in vector.search_index(asked.where("vec_id = 0"), path, 10, 64).orderBy("rank").collect()]
    assert zero[0] == 700 and len(set(zero)) == 10 and set(zero) <= set(range(700, 2000))  # ties: a shard's smallest ids
    exact = [r for r in vector.exact(asked, e, 10, 64).collect() if r["query_id"] < 4000]
    assert len(exact) == 2000 and _hits(exact, near, 10) == 2000 and {r["held"] for r in exact} == {4000}
    first = sorted(r["id"] for r in exact if r["query_id"] == 0)
    assert first == list(range(700, 710))


def test_index_of_nothing_and_of_one(spark, tmp_path):
    e = _write(spark, tmp_path / "e", np.eye(4, 64))
    for name, rows in (("none", e.where("false")), ("one", e.where("vec_id = 1"))):
        vector.build_index(rows, f"{tmp_path}/{name}", 64)
    assert vector.search_index(e, f"{tmp_path}/none", 3, 64).count() == vector.exact(e, e.where("false"), 3, 64).count() == 0
    found = vector.search_index(e, f"{tmp_path}/one", 3, 64)
    assert sorted((r["query_id"], r["rank"], r["id"]) for r in found.collect()) == [(0, 1, 1), (2, 1, 1), (3, 1, 1)]
    assert vector.search_index(e.where("false"), f"{tmp_path}/one", 3, 64).count() == 0


def test_links_are_bounded_and_reach_every_node():
    m = np.random.default_rng(1).normal(size=(600, 16))
    g = proximity.Graph.of(m)
    assert g.links.shape == (600, proximity.DEGREE) and g.links.max() < 600
    assert all(len(set(row[row >= 0].tolist())) == (row >= 0).sum() and i not in row for i, row in enumerate(g.links))
    seen, todo = set(range(0, 600, proximity.UPPER)), list(range(0, 600, proximity.UPPER))
    while todo:
        for x in g.links[todo.pop()].tolist():
            if x >= 0 and x not in seen:
                seen.add(x)
                todo.append(x)
    assert len(seen) == 600
