import random
import time

import numpy as np
from pyspark.sql import functions as F

from postloom.llm import common, ngram_join, substring_dedup


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for k in range(files.size()) if (name := files.apply(k).getName()).startswith("shuffle_")}


def test_stored_tables_and_bitmaps_leave_no_shuffle_files(spark):
    before, key = shuffle_files(spark), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    rows = common.stored(spark.range(1000).withColumn("k", F.col("id") % 7).groupBy("k").agg(F.max("id").alias("m")))
    common.bitmap_of(spark.range(1000).select(F.xxhash64("id").alias("h")), "h", 12)
    assert rows.count() == 7 and spark.conf.get(key) == "false"
    kept = shuffle_files(spark) - before
    until = time.monotonic() + 20
    while len(kept) > 2 and time.monotonic() < until:  # those of count() stay
        time.sleep(0.2)
        kept &= shuffle_files(spark)
    assert len({name.split("_")[1] for name in kept}) <= 1


def test_a_pair_is_handed_on_where_it_first_meets(spark):
    rng = random.Random(3)
    first = [str(rng.random()) for _ in range(3000)]
    texts = [first]
    for changed in (5, 15, 40, 60, 90):
        texts.append([w if rng.random() > changed / 3000 else str(rng.random()) for w in first])
    docs = spark.createDataFrame([(k, " ".join(words)) for k, words in enumerate(texts)], "doc_id long, text string")
    rows = ngram_join._features(ngram_join._texts(docs), np.zeros(0, np.uint64)).orderBy("doc_id").collect()
    size = np.array([r.n for r in rows])
    leading = np.stack([np.frombuffer(r.leading, np.int64) for r in rows])
    place = [{h: k for k, h in enumerate(r.prefix)} for r in rows]
    sets = [{tuple(words[k : k + 5]) for k in range(len(words) - 4)} for words in texts]
    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            shared = [h for h in rows[a].prefix if h in place[b]]
            ends = np.array([[place[a][h], place[b][h]] for h in shared])
            roomy = ngram_join.roomy(size[a], size[b], size[a] - ends[:, 0], size[b] - ends[:, 1])
            met = [bool(len(ngram_join.first_met(np.array([0]), np.array([1]), leading[[a, b]], at)[0])) for at in ends]
            told = int((roomy & met).sum())
            assert len(shared) > 100 and told < len(shared) / 4  # each shared entry's tree told of the pair before
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                assert told


def test_segments_are_shuffled_once_and_anchors_fill_a_bitmap_evenly(spark, monkeypatch):
    rng = np.random.default_rng(5)
    hashes = rng.integers(0, 1 << 63, 20_000, dtype=np.int64).view(np.uint64) * np.uint64(2)
    text = " ".join(f"w{k}" for k in hashes.tolist()).encode()
    anchors = substring_dedup._segments(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]
    assert 0.4 < (anchors >> np.uint64(63)).mean() < 0.6  # smallest of nine: nearly all were in the lower half

    monkeypatch.setattr(substring_dedup, "SHARD", 50)
    r = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    passage = r.choices(words, k=20)
    texts = [" ".join(r.choices(words, k=15) + passage + r.choices(words, k=15)) for _ in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts + texts[:30])), "doc_id long, text string")
    plans = []
    real = substring_dedup.stored
    monkeypatch.setattr(substring_dedup, "stored", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
    substring_dedup.remove_repeats(docs)
    # of the plans that take the segments' words from their table, only those of hot anchors aggregate or join by shuffles
    scans = [p for p in plans if "Scan parquet" in p and "words" in p]
    assert scans and not any("SortMergeJoin" in p and "first(words" in p for p in scans)
    assert not any("first(words" in p and "BroadcastHashJoin" not in p for p in plans if "second" not in p)
