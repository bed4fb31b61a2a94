"""Queries on rows that the given tables lack, against their SQL."""

import re
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from postloom.plans import catalog
from tests.test_queries import rows

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def held(spark, tmp_path):
    """Runs a query on given tables {name: (rows, schema)} and holds it against its SQL."""

    def check(name, tables):
        con = duckdb.connect()
        for t, (values, schema) in tables.items():
            spark.createDataFrame(values, schema).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
        found = catalog.QUERIES[name](spark, str(tmp_path))
        got = rows(found.columns, found.collect())
        result = con.execute(catalog.SQL[name])
        assert got == rows([d[0] for d in result.description], result.fetchall())
        return got

    return check


def test_pushed_as_both_kinds(held):
    docs = [(1, "same", "en", "s", 4), (3, "same", "de", "s", 4), (5, "same", None, "s", 4), (2, "x", "en", "s", 1), (7, "", "en", "s", 0)]
    assert len(held("s17_pushed", {"documents": (docs, DOCUMENTS)})) == 3


def test_pii_is_counted_where_the_sql_counts_it(held):
    docs = [(0, "é" * 99_999 + " a@b.org", "en", "s", 0), (6, "é" * 50_000 + " a@b.org", "en", "s", 0), (12, None, "en", "s", 0)]
    assert len(held("t18_pii_counts", {"documents": (docs, DOCUMENTS)})) == 3


def test_best_entity_of_more_than_a_thousand(held):
    suppliers = [(i, f"Supplier#00001{i:04}", 0, 5.0 if i % 700 == 3 else 1.0) for i in range(1500)]
    assert [n for (_, n) in held("g06_best_entity", {"supplier": (suppliers, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double")})] == [1500.0]


def test_best_entity_without_balances(held):
    held("g06_best_entity", {"supplier": ([(1, "Supplier#000011", 0, None), (2, "Supplier#000012", 0, 1.0), (3, None, 0, 9.0)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double")})


def test_a_long_text_is_measured_once(held):
    start = time.monotonic()
    assert len(held("k02_token_starts", {"documents": ([(1, "é" * 1_500_001, "en", "s", 0), (2, "", "en", "s", 0), (3, None, "en", "s", 0), (4, "abc", "en", "s", 3), (5, "abcdefghi" * 5, "en", "s", 45)], DOCUMENTS)})) == 4
    assert time.monotonic() - start < 40


def test_equal_names_meet_once(spark, tmp_path):
    from postloom.operators import trigram_index

    nodes = spark.range(4000).selectExpr("id AS node_id", "if(id % 2 = 0, 'red bolt', 'hot anvil') AS name", "double(id % 7) AS pagerank")
    trigram_index.build(nodes, "node_id", "name", f"{tmp_path}/t", ("pagerank",))
    asked = spark.range(50).selectExpr("id AS query_id", "if(id % 2 = 0, 'rd bolt', 'hot anvl') AS name")
    assert trigram_index.candidates(spark, f"{tmp_path}/t", asked.where("query_id < 2")).count() == 2
    got = trigram_index.similar(spark, f"{tmp_path}/t", asked, 3, ("pagerank",)).collect()
    assert {(r["query_id"], r["rank"], r["id"]) for r in got} == {(q, k + 1, i) for q in range(50) for k, i in enumerate([6, 20, 34] if q % 2 == 0 else [13, 27, 41])}


def test_pairs_of_one_nation_are_dealt_to_many_tasks(spark, held, tmp_path):
    tables = {
        "customer": ([(i, f"c{i}", 1 if i < 190 else None, 9500.0, "M") for i in range(200)], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
        "supplier": ([(i, f"s{i}", 1 if i < 15 else 2, 6000.0) for i in range(20)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"),
        "nation": ([(1, "A", 0), (2, "B", 0)], "n_nationkey int, n_name string, n_regionkey int"),
    }
    assert sum(held("j02_aliased_double_join", tables).values()) == 190 * 15
    found = catalog.QUERIES["j02_aliased_double_join"](spark, str(tmp_path))
    assert found.select(F.spark_partition_id()).distinct().count() > 8


@pytest.mark.parametrize("name", ["x05_cover_density", "x08_snippets", "k05_chunks", "k11_extraction_windows"])
def test_texts_go_to_python_in_small_batches(spark, tmp_path, name):
    other, key = spark.newSession(), "spark.sql.execution.arrow.maxBytesPerBatch"
    other.createDataFrame([(1, "a the released license. " * 200, "en", "s", 0), (2, None, None, None, None)], DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    assert catalog.QUERIES[name](other, str(tmp_path)).count() > 0
    assert int(other.conf.get(key)) == 4 << 20
    other.conf.set(key, "1m")
    catalog.QUERIES[name](other, str(tmp_path))
    assert other.conf.get(key) == "1m"


def test_claims_words_travel_without_their_set(spark):
    from postloom.operators import maintenance

    claims = spark.createDataFrame([(1, "Red bolts hold large anvils"), (2, "red Bolts hold large anvils"), (3, "nothing alike"), (4, ""), (5, None)], "claim_id long, claim string")
    facts = spark.createDataFrame([(7, "large red bolts hold anvils firmly"), (8, "other words")], "fact_id long, fact string")
    found = maintenance.keyword_support(claims, facts)
    assert {(r["claim_id"], r["fact_id"], r["supported"]) for r in found.collect()} == {(1, 7, True), (2, 7, True), (3, None, False), (4, None, False), (5, None, False)}
    assert not re.search(r"Aggregate \[w#\d+, n#", found._jdf.queryExecution().optimizedPlan().toString())


def test_near_names_are_held_against_those_that_stay(spark, monkeypatch):
    from postloom.operators import graph

    seen, similar = [], graph._similar
    monkeypatch.setattr(graph, "_similar", lambda pairs, *rest: seen.append(pairs.count()) or similar(pairs, *rest))
    monkeypatch.setattr(graph, "FOLD_AT_ONCE", 20)
    monkeypatch.setattr(graph, "FOLD_LINKS", 15)
    stem = "a long name of an organization that many rows have with one letter or two of it changed, number "
    nodes = spark.range(400).selectExpr("id AS node_id", f"concat('{stem}', lpad(string(id), 3, '0')) AS name", "'ORGANIZATION' AS kind", "string(NULL) AS email")
    assert {tuple(r) for r in graph.resolve_people(nodes).collect()} == {(i, 0) for i in range(1, 400)}
    assert sum(seen) < 1000  # of 79,800 pairs


@pytest.mark.parametrize("name", ["g03_expand", "g12_pagerank"])
def test_edges_are_dealt_by_their_number(spark, held, monkeypatch, name):
    from postloom.operators import graph

    seen, dealt = [], graph.dealt
    monkeypatch.setattr(graph, "TASK_ROWS", 50)
    monkeypatch.setattr(graph, "dealt", lambda df, rows, *keys: (seen.append((rows, dealt(df, rows, *keys).rdd.getNumPartitions())), dealt(df, rows, *keys))[1])
    orders = [(i, i % 37) for i in range(200)]
    lines = [(i % 200, i % 29, i % 7, float(i % 11 + 1), "AN"[i % 2]) for i in range(1000)]
    tables = {"orders": (orders, "o_orderkey long, o_custkey long"), "lineitem": (lines, "l_orderkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string")}
    held(name, tables)
    assert (1000, 20) in seen and all(parts >= rows / 50 for rows, parts in seen if rows > 50)


def test_an_index_gathers_words_where_they_are(spark, tmp_path, monkeypatch):
    from postloom.operators import lexical, text_index

    docs = spark.createDataFrame([(1, "The Things ran; things", "Bees"), (2, None, "bees the bee things"), (3, "", None), (4, "thing", "x"), (4, "bee thing", None), (None, "thing", None), (None, "a thing thing", "bee")], "id long, a string, b string")
    fields, cut = {"a": "A", "b": "D"}, []
    want = text_index._merged_postings(docs, "id", fields).select("key", "lexeme", "gaps", "weights", "n", "top").where("key < 4").collect()
    got = lexical.postings(docs, "id", fields).where("key < 4").collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) > 4
    whole = lexical.token_table
    monkeypatch.setattr(lexical, "token_table", lambda rows, *rest: cut.append(rows.count()) or whole(rows, *rest))
    text_index.build(docs, "id", fields, f"{tmp_path}/x")
    assert cut == [4]  # only rows that share a key are joined by it
    monkeypatch.undo()
    for groups in ([["thing"]], [["thing"], ["bee"]]):
        assert text_index.search(spark, f"{tmp_path}/x", "id", groups, 9).collect() == lexical.ranked_search(docs, "id", fields, groups, 9).collect()


def test_a_keyed_table_is_merged_in_one_shuffle(spark, tmp_path):
    from postloom.sources.sink import KeyedTable

    plans = []

    class Watched(KeyedTable):
        def merge(self, batch, change, source, number, touched=None):
            def seen(old):
                new = change(old)
                plans.append(new._jdf.queryExecution().executedPlan().toString())
                return new

            return super().merge(batch, seen, source, number, touched)

    rows = lambda *r: spark.createDataFrame(list(r), "g string, id long")
    t = Watched(spark, f"{tmp_path}/t", "g string, id long", ["g", "id"], by=["g"], buckets=4)
    groups = lambda *g: spark.createDataFrame([(x,) for x in g], "g string")
    t.replace(rows(("a", 1), ("a", 2), ("b", 1), (None, 5)), groups("a", "b", None), "s", 0)
    t.replace(rows(("a", 3), ("c", 9)), groups("a", "a", "b"), "s", 1)
    assert sorted(map(tuple, t.rows().collect())) == [("a", 3)]
    t.upsert(rows(("a", 3), ("d", 1)), "s", 2)
    assert sorted(map(tuple, t.rows().collect())) == [("a", 3), ("d", 1)]
    assert [p.count("Exchange ") for p in plans] == [1, 1, 1]


def test_chunks_get_their_embeddings_in_one_pass(spark):
    from postloom.operators import embedding

    def fails_on_b(texts):
        if "b" in texts:
            raise ValueError
        return embedding.lengths(texts)

    df = spark.createDataFrame([(1, "aa"), (2, "b"), (3, " "), (4, None), (5, "")], "k long, t string").coalesce(1)
    out = embedding.with_embeddings(df, "t", fails_on_b)
    assert "Exchange hash" not in out._jdf.queryExecution().executedPlan().toString()
    assert [(r.k, r.t, r.embedding and r.embedding[0], r.status) for r in out.orderBy("k").collect()] == [(1, "aa", 2.0, "embedded"), (2, "b", None, "skipped"), (3, " ", None, "blank"), (4, None, None, "blank"), (5, "", None, "blank")]


def test_a_hop_is_found_once(spark):
    from postloom.operators import graph

    edges = spark.range(40).selectExpr("id AS edge_id", "id AS source_id", "id + 1 AS target_id", "1.0 AS weight")
    out = graph.expand(edges, spark.createDataFrame([(3,)], "node_id long"), 3)
    assert "Range" not in out._jdf.queryExecution().optimizedPlan().toString()  # no edge is read again after its hop
    assert sorted((r.edge_id, r.hop) for r in out.collect()) == [(0, 3), (1, 2), (2, 1), (3, 1), (4, 2), (5, 3)]


def test_files_are_read_once_for_their_texts(spark):
    from postloom.sources import folders, office

    made = spark.createDataFrame([("a.txt", b"plain"), ("b.HTML", b"<p>page</p>"), ("c.docx", office.docx_bytes(["one", "two"])), ("d.docx", b"broken"), ("e.xyz", b"?"), ("f.rtf", None), (None, b"x")], "name string, content binary")
    out = folders.extracted_text(made.repartition(2))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1  # a scan of the files for each branch before
    texts = {r["name"]: r["text"] for r in out.collect()}
    assert texts["a.txt"] == "plain" and texts["b.HTML"].strip() == "page" and texts["c.docx"].split() == ["one", "two"]
    assert texts["d.docx"] is None and texts["e.xyz"] is None and texts["f.rtf"] is None and None not in texts
