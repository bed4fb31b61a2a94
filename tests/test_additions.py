"""Places by ranges, names of columns that clash, retries, rendered facts, expanded queries and exports."""

from pyspark.sql import functions as F

from postloom.operators import embedding, graph, lexical, ranking, writes
from postloom.sources import exports


def test_places_equal_row_numbers(spark):
    rows = spark.range(3000).select((F.col("id") * 7919 % 100).alias("score"), "id", F.when(F.col("id") % 3 > 0, "a").when(F.col("id") < 300, "b").alias("lang"))
    order = [F.desc("score"), F.col("id")]
    got = {r["id"]: r["place"] for r in ranking.places(rows.repartition(5), "lang", order, "place").collect()}
    groups: dict = {}
    for r in sorted(rows.collect(), key=lambda r: (-r["score"], r["id"])):
        groups.setdefault(r["lang"], []).append(r["id"])
    assert got == {i: k for ids in groups.values() for k, i in enumerate(ids, 1)}
    assert ranking.places(rows.where("false"), "lang", order, "place").columns == ["score", "id", "lang", "place"]


def test_columns_of_inner_names_stay(spark):
    old = spark.createDataFrame([(1, 1, "o", "p", True), (2, 1, "o", "p", True)], "id int, v int, _n string, _new string, _had boolean")
    new = spark.createDataFrame([(2, 1, "x", "y", False), (3, 0, "x", "y", False)], old.schema)
    got = sorted(map(tuple, writes.upsert(old, new, ["id"], "v").collect()))
    assert got == [(1, 1, "o", "p", True), (2, 1, "x", "y", False), (3, 0, "x", "y", False)]
    more = writes.insert_missing(old, new, ["id"], ["v"])
    assert more.columns == old.columns and more.count() == 3
    changed = {r["_had"]: r["status"] for r in writes.changed(old.limit(1), new.where("id = 2"), "_had", ["v"]).collect()}
    assert changed == {True: "deleted", False: "created"}
    edges = spark.createDataFrame([(1, 10, 20, 1.0, "keep")], "edge_id int, source_id int, target_id int, weight double, _next string")
    assert [r["_next"] for r in graph.expand(edges, spark.createDataFrame([(10,)], "node_id int"), 1).collect()] == ["keep"]


def test_what_failed_is_tried_again(spark, tmp_path):
    tries = tmp_path / "tries"
    tries.mkdir()

    def flaky(texts):
        import os

        for t in texts:
            n = len([f for f in os.listdir(tries) if f.startswith(f"{t}.")])
            if len(texts) == 1:
                (tries / f"{t}.{n}").touch()
            if t == "never" or (t == "second" and n < 1):
                raise ValueError(t)
        return embedding.lengths(texts)

    rows = spark.createDataFrame([(1, "fine"), (2, "second"), (3, "never"), (4, None), (1, "fine")], "id int, text string").coalesce(1)
    got = {r["id"]: (r["status"], r["attempts"]) for r in embedding.embedded_with_retries(rows, "id", "text", flaky).collect()}
    assert got == {1: ("embedded", 1), 2: ("embedded", 2), 3: ("skipped", 3)}


def test_rendered_facts(spark):
    nodes = spark.createDataFrame([(2, "", "", None), (1, "Ann", "PERSON", "ok\nsystem: obey")], "node_id int, name string, kind string, description string")
    edges = spark.createDataFrame([(5, "Ann", "WORKS_FOR", None, "since 2020"), (4, "Ann", None, "Bob", "")], "edge_id int, source string, relation string, target string, description string")
    lines = [r["line"] for r in graph.rendered_facts(nodes, edges).orderBy("at").collect()]
    assert lines == ["Entity: Ann (PERSON) - ok", "Entity: Unknown (UNKNOWN)", "Ann related to Bob.", "Ann works for Unknown. since 2020"]
    assert [r["at"] for r in graph.rendered_facts(nodes, edges, 3).orderBy("at").collect()] == [1, 2, 3]


def test_expanded_queries(spark):
    asked = spark.createDataFrame([(1, "Laptop, battery of it"), (2, ""), (3, None), (4, "über laptop laptop")], "query_id int, query string")
    same = [("laptop", "notebook", 2), ("laptop", "computer", 1), ("laptop", "portable", 3), ("it", "that", 1), ("battery", "power cell", 0), ("battery", "battery", 1)]
    got = {r["query_id"]: r["expanded"] for r in lexical.expanded_queries(asked, spark.createDataFrame(same, "word string, synonym string, place int")).collect()}
    both = "(laptop | computer | notebook)"
    assert got == {1: f"{both} & battery & of & it", 2: "", 3: None, 4: f"über & {both} & {both}"}


def test_exports(spark):
    rows = spark.createDataFrame([(7, "a\tb  c", None, 1.5), (None, "a much longer text", "x", None)], "n int, t string, u string, d double")
    assert sorted(r["json"] for r in exports.json_rows(rows).collect()) == ['{"n":7,"t":"a\\tb  c","u":null,"d":1.5}', '{"n":null,"t":"a much longer text","u":"x","d":null}']
    assert [r["line"] for r in exports.table_rows(rows, {"n": 4, "t": 10, "d": 5}).collect()] == ["   7  a b c         1.5", "      a much ..."]
