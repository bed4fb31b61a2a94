import math

from pyspark.sql import functions as F

import corpus_pipeline
from postloom.llm import decontaminate, ngram_join, pii, toxicity
from postloom.llm.common import stored

from .helpers import rows
from .test_ngram_join import brute


def _tables(spark, folder):
    clean = [f"{'alpha beta gamma delta'} {k} " + " ".join(f"w{k}x{j}" for j in range(30)) for k in range(60)]
    toxic = [t.replace("gamma", "vileword") for t in clean[:30]]
    item = "the quick brown fox jumps over the lazy dog near the river bank at noon today"
    texts = clean + [f"{t} t{k}" for k, t in enumerate(toxic)] + [clean[3] + " tail", clean[4], item + " " + clean[7].upper(), "write to ann.b@mail.example.com please", None, ""]
    docs = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(60 <= i < 90)) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs


def test_each_stage_does_its_part(spark, tmp_path):
    folder = str(tmp_path)
    docs = _tables(spark, folder)
    names, stages = zip(*corpus_pipeline.STAGES, strict=True)
    assert names == ("toxicity", "ngram_join", "decontaminate", "pii", "packing")
    at = docs
    for k, stage in enumerate(stages):
        before, at = at, stored(stage(spark, at, folder))
        assert k == 4 or at.columns == docs.columns
        ids = {r["doc_id"] for r in at.select("doc_id").collect()}
        had = {r["doc_id"]: r["text"] for r in before.collect()}
        if k == 0:
            weights = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
            assert ids == {r["doc_id"] for r in toxicity.score(docs, weights).where("score < 0.5").collect()}
            assert ids == set(had) - set(range(60, 90))
        if k == 1:
            order = sorted(had)
            assert ids == {order[i] for i, _, c in brute([had[d] for d in order]) if i == c}
            assert 90 not in ids and 91 not in ids and 94 in ids
        if k == 2:
            leaks = {r["doc_id"] for r in decontaminate.find_items(before, spark.read.parquet(f"{folder}/benchmark.parquet")).collect()}
            assert leaks == {92} and ids == set(had) - leaks
        if k == 3:
            now = {r["doc_id"]: r for r in at.collect()}
            assert now[93]["text"] == "write to [EMAIL] please" and now[93]["n_chars"] == 23
            assert all(r["text"] == had[d] for d, r in now.items() if d != 93)
            assert not any(pii.base_spans(r["text"] or "") for r in now.values())
    total = at.agg(F.sum("length")).first()[0]
    assert at.select("sequence_id").distinct().count() == math.ceil(total / 2048)
    assert rows(corpus_pipeline.run(spark, folder), "doc_id", "piece", "length", "ids_crc32") == rows(at, "doc_id", "piece", "length", "ids_crc32")


def test_empty_documents(spark, tmp_path):
    docs = _tables(spark, str(tmp_path)).where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    assert docs.count() == 0


def test_rows_without_ids_stay(spark, tmp_path):
    docs = _tables(spark, str(tmp_path)).limit(5).withColumn("doc_id", F.lit(None).cast("long"))
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stored(stage(spark, docs, str(tmp_path)))
    assert docs.count() == 5 and ngram_join.jaccard_components(docs).where("component_id is not null").count() == 0


def test_rows_are_judged_each_by_its_own_text(spark, tmp_path):
    _tables(spark, str(tmp_path))
    item = "the quick brown fox jumps over the lazy dog near the river bank at noon today"
    a, b = (" ".join(f"{k}{i}" for i in range(40)) for k in "ab")
    raw = [(5, a), (5, a), (5, b), (None, b), (None, item + b.upper().replace("B", "c")), (7, item), (7, "clean words here"), (3, a + " x"), (9, None), (9, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, k) for k, (i, t) in enumerate(raw)], "doc_id long, text string, lang string, source string, n_chars long, row int")
    one = stored(corpus_pipeline.one_of_each_group(spark, docs, str(tmp_path)))
    assert one.columns == docs.columns
    assert sorted(r["row"] for r in one.collect()) == [2, 4, 5, 6, 7, 8, 9]
    left = corpus_pipeline.drop_leaks(spark, one, str(tmp_path))
    assert left.columns == docs.columns and sorted(r["row"] for r in left.collect()) == [2, 6, 7, 8, 9]
