"""Queries on rows that the given tables lack, against their SQL, and stages that must count."""

from postloom.plans import catalog
from tests.test_findings_r03 import DOCUMENTS, held  # noqa: F401


def test_office_texts_leave_out_blank_documents(held):  # noqa: F811
    blank = ["", " ", "\n \n", "漢字", " \t", None]
    texts = [*blank, 'a "b",c\n\nd', '"', "é\\{x}\r\n?"]
    docs = [(i, t, "en", "s", 0) for i, t in enumerate([t for t in texts for _ in range(4)])]
    docs += [(i, "a line\nof two", "en", "s", 0) for i in (-1, -2, -3, -4, None, (1 << 60) + 3)]
    assert len(held("s15_office_texts", {"documents": (docs, DOCUMENTS)})) == 3 * 4 + 6


def test_office_texts_are_whole(held):  # noqa: F811
    text = "\n".join(f"line {k}" for k in range(200_100))
    assert len(held("s15_office_texts", {"documents": ([(3, text, "en", "s", 0), (7, "short", "en", "s", 0), (2, text, "en", "s", 0)], DOCUMENTS)})) == 3


def test_sheets_are_read_whole():
    from postloom.sources import formats, office

    rows = [["a", "b", "c"], *[[str(k), "x", "y"] for k in range(70_000)]]
    assert formats.xlsx(office.xlsx_bytes({"s": rows})).splitlines()[-1] == "69999,x,y"


def test_stop_words_of_a_query_ask_nothing(spark):
    from postloom.operators import lexical

    docs = spark.createDataFrame([(1, "Released under the license"), (2, "the other"), (3, None)], "id long, t string")
    found = lambda q: [tuple(r) for r in lexical.ranked_search(docs, "id", {"t": "B"}, lexical.expanded(q, {"the": ["released"]}), 9).collect()]
    assert found("license of released") == found("license the") != [] and found("of by") == []
    assert lexical.stemmed([["the"], ["license"], ["of", "works"]]) == [["license"], ["work"]]


def test_every_stage_of_retrieval_counts(spark):
    from dataclasses import replace

    from postloom.plans import retrieval, retrieval_queries
    from postloom.sources.tables import stored

    folder = "/root/testdata/sf0.01"
    corpus, settings = retrieval_queries.corpus(spark, folder), retrieval_queries._settings(spark, folder)
    hits, asked = retrieval.candidates(corpus, retrieval_queries._ASKED, retrieval_queries._vector(spark, folder), settings)
    hits = stored(hits)
    of = lambda c: {r[0] is None for r in hits.select(c).collect()}
    assert of("lexical_score") == of("vector_score") == {True, False}
    by_summary = retrieval.lexical.conversation_search(corpus.conversations, asked, settings.synonyms, settings.summaries)
    by_graph = retrieval.graph_conversations(corpus, asked, settings)
    scores = lambda s: {r["chunk_id"]: (r["score"], r["summary_boosted"], r["graph_boosted"]) for r in retrieval.scored(hits, corpus, asked, by_summary, by_graph, s).collect()}
    whole, undated = scores(settings), scores(replace(settings, strength=0.0))
    assert {f[1] for f in whole.values()} == {f[2] for f in whole.values()} == {True, False}
    assert sum(whole[k][0] > undated[k][0] for k in whole) > len(whole) / 2
    kept = corpus.chunks.join(corpus.conversations.where("latest_date >= '2000-01-01'"), "conversation_id", "left_semi").count()
    assert 0 < kept < corpus.chunks.count()


def test_tasks_list_and_read_the_files(spark, tmp_path):
    from pyspark.sql import functions as F

    from postloom.sources import folders

    root = tmp_path / "in"
    names = [f"f{k}/Conversation.txt" for k in range(40)] + ["f1/attachments/a ü %41.txt", "f2/.hidden", "f2/_log", "_g/x", "f3/k=1/_k=2", "top.txt", "top/top"]
    for k, n in enumerate(names):
        (root / n).parent.mkdir(parents=True, exist_ok=True)
        (root / n).write_bytes(bytes([65 + k]) * (0 if k == 5 else 3 << 20 if k < 4 else k))
    (root / "empty").mkdir()
    found = folders.files(spark, str(root))
    assert found.inputFiles() == []  # the driver held them all before
    asked = ["folder", "inner", "name", "size", F.date_trunc("second", "modificationTime"), F.sha2("content", 256)]
    got = sorted(map(tuple, found.select(*asked).collect()))
    path = F.regexp_replace("path", "^file:/+", "/")
    whole = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(root))
    inner = F.substring(path, len(str(root)) + 2, 1000)
    want = whole.select(F.substring_index(inner, "/", 1).alias("folder"), F.regexp_replace(inner, "^[^/]+/", "").alias("inner"), F.substring_index(inner, "/", -1).alias("name"), F.col("length").alias("size"), "modificationTime", "content")
    empty = [g for g in got if g[3] == 0]  # Spark's reader leaves it out
    assert [g for g in got if g not in empty] == sorted(map(tuple, want.select(*asked).collect())) and [g[0] for g in empty] == ["f5"] and len(got) == 44
    assert {r[0] for r in found.select("path").collect()} == {str(root / g[0] / g[1]) if g[1] != "top.txt" else str(root / "top.txt") for g in got}
    assert sorted(map(tuple, folders.files(spark, f"file:{root}/").select(*asked).collect())) == got
    assert "ArrowEvalPython" not in found.groupBy("folder").count()._jdf.queryExecution().executedPlan().toString()


def test_names_are_paired_in_many_tasks(spark, held, tmp_path, monkeypatch):  # noqa: F811
    from pyspark.sql import functions as F

    from postloom.plans import relational_queries

    monkeypatch.setattr(relational_queries, "SHARE_ROWS", 50)
    names = ["red bolt"] * 300 + ["Bolt"] * 40 + ["old red  bolt", "", " ", "red", "a red", "red bolt x", None, "bolt bolt", "boltred"] + [f"only {k}" for k in range(60)]
    parts = [(None if k == 7 else 12 if k == 13 else k, n) for k, n in enumerate(names)]  # one without a key, two of one key
    assert sum(held("j08_whole_word_join", {"part": (parts, "p_partkey long, p_name string")}).values()) > 300 * 298
    found = catalog.QUERIES["j08_whole_word_join"](spark, str(tmp_path))
    assert found.select(F.spark_partition_id()).distinct().count() > 20


def test_pairs_of_long_lists_come_in_batches():
    import pyarrow as pa

    from postloom.plans import relational_queries

    ids = [list(range(100_000)), [200_000, 200_001], [], [3]]
    batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.list_(pa.int64())), pa.array([[1, 2, 3], list(range(70_000)), [1], []], pa.list_(pa.int64()))], ["short_ids", "long_ids"])
    out = list(relational_queries._paired([batch]))
    assert max(b.num_rows for b in out) < 2 * relational_queries.PAIRS
    assert sum(b.num_rows for b in out) == len({(x, y) for b in out for x, y in zip(b[0].to_pylist(), b[1].to_pylist(), strict=True)}) == 299_997 + 140_000
