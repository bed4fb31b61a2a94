"""The full-text index against the scan that cuts every text."""

import random

import pytest
from pyspark.sql import functions as F

from postloom.operators import lexical, text_index

WORDS = [f"w{i}x" for i in range(60)]


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    r = random.Random(4)
    rows = []
    for i in range(3000):
        subject = " ".join(r.choices(WORDS, k=r.randint(0, 4)))
        body = " ".join(r.choices(WORDS, weights=[1 + 200 / (1 + k) for k in range(60)], k=r.randint(0, 30)))
        if i % 500 == 7:
            body += " rare words running" * 3 + " w0x" * 40
        rows.append((i, r.choice([subject, None]), r.choice([body] * 5 + [None, ""]), "extra"))
    docs = spark.createDataFrame(rows, "id long, subject string, body string, lexeme string")
    path = str(tmp_path_factory.mktemp("index") / "text")
    text_index.build(docs, "id", {"subject": "A", "body": "D"}, path, range_rows=16, buckets=8)
    return docs, path


@pytest.mark.parametrize("groups", [[["rare"]], [["run"], ["words", "w5x"]], [["w0x"], ["w1x"]], [["w40x", "w41x"], ["w3x"], ["w2x"]], [["w7x"], ["w7x"]], [["absent"]], [["w1x"], ["absent"]], [["the"]], []])
@pytest.mark.parametrize("limit", [5, 4000])
def test_search_equals_the_scan(spark, indexed, groups, limit):
    docs, path = indexed
    want = lexical.ranked_search(docs, "id", {"subject": "A", "body": "D"}, groups, limit).collect()
    got = text_index.search(spark, path, "id", groups, limit).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]


def test_blocks_are_skipped_and_bounds_hold(spark, indexed):
    docs, path = indexed
    groups = [["w0x"]]
    every = text_index._blocks(spark, path, ["w0x"]).count()
    first, further = text_index.candidates(spark, path, groups, 3)
    assert every > 150 and first.count() == 3 and further.count() < every / 4
    ranges = F.pmod(F.xxhash64("id"), F.lit(-(-3000 // 16))).cast("int")
    for groups in ([["w0x"], ["w1x", "w9x"]], [["w3x"]]):
        ranked = lexical.ranked_search(docs, "id", {"subject": "A", "body": "D"}, groups, 4000).withColumn("range", ranges)
        over = ranked.join(text_index.bounds(spark, path, groups), "range", "left").where("bound IS NULL OR rank > bound")
        assert over.count() == 0


def test_a_query_opens_its_own_buckets(spark, indexed):
    _, path = indexed
    plan = text_index._blocks(spark, path, ["w0x"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [IsNotNull(lexeme), EqualTo(lexeme,w0x)]" in plan.replace("In(lexeme, [w0x])", "EqualTo(lexeme,w0x)")
    bounds = text_index.bounds(spark, path, [["w0x"]])._jdf.queryExecution().toString()
    assert "postings" not in bounds.split("== Physical Plan ==")[1]
    files = text_index._blocks(spark, path, ["w0x"]).select(F.input_file_name()).distinct().count()
    assert files <= 2


def test_an_empty_index(spark, tmp_path):
    docs = spark.createDataFrame([], "id string, body string")
    text_index.build(docs, "id", {"body": "D"}, f"{tmp_path}/x")
    assert text_index.search(spark, f"{tmp_path}/x", "id", [["a1"]], 5).count() == 0
