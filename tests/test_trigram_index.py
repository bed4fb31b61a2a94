"""The trigram index against the scan of all names."""

import random

from pyspark.sql import functions as F

from postloom.operators import graph, trigram_index


def test_similar_names_equal_the_scan_from_few_candidates(spark, tmp_path):
    r = random.Random(2)
    syllables = ["".join(r.choices("bcdfghklmnprst", k=1)) + r.choice("aeiou") for _ in range(60)]
    rows = [(i, " ".join("".join(r.choices(syllables, k=r.randint(1, 4))) for _ in range(r.randint(1, 2))), r.random()) for i in range(2000)]
    rows += [(3000, None, 1.0), (3001, "", 1.0), (3002, "--", 1.0), (3003, rows[0][1], 0.5), (3004, rows[0][1], 0.5)]
    nodes = spark.createDataFrame(rows, "node_id long, name string, pagerank double")
    trigram_index.build(nodes, "node_id", "name", f"{tmp_path}/t", ("pagerank",))
    asked = [(k, n) for k, n in enumerate([rows[0][1], rows[1][1][1:], rows[2][1] + "xy", rows[5][1].upper(), "zzz", "", None, rows[9][1].replace("a", "")])]
    got = trigram_index.similar(spark, f"{tmp_path}/t", spark.createDataFrame(asked, "query_id long, name string"), 10, ("pagerank",)).collect()
    found = {q: [(x["id"], x["similarity"]) for x in sorted((x for x in got if x["query_id"] == q), key=lambda x: x["rank"])] for q, _ in asked}
    for q, name in asked:
        want = graph.similar_entities(nodes.where("name is not null"), name or "", 10).collect()
        assert found[q] == [(x["node_id"], x["similarity"]) for x in want], name
    assert len(found[0]) > 2 and not found[4] and not found[5] and not found[6]
    met = trigram_index.candidates(spark, f"{tmp_path}/t", spark.createDataFrame([a for a in asked if a[1]], "query_id long, name string")).count()
    assert met < 0.1 * 6 * len(rows)


def test_sample_of_names_does_not_depend_on_partitions(spark):
    nodes = spark.range(5000).select(F.when(F.col("id") % 3 > 0, "a").when(F.col("id") < 20, "b").alias("kind"), F.concat(F.lit("n"), F.col("id") % 4000).alias("name"), F.col("id").alias("node_id"))
    one = sorted(map(tuple, graph.sampled_names(nodes.coalesce(1), "kind", "name", "node_id", 10).collect()), key=str)
    assert one == sorted(map(tuple, graph.sampled_names(nodes.repartition(13), "kind", "name", "node_id", 10).collect()), key=str)
    assert len(one) == 10 + 7 + 10
