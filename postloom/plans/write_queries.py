"""Queries of ids and merge semantics (W): documents as what is stored, and a changed part of them as what comes in."""

from __future__ import annotations

from pyspark.sql import functions as F

from postloom.functions import ids
from postloom.operators import writes
from postloom.plans.registry import query, table


def _stored(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.sha2("text", 256).alias("h"), F.lit(1).alias("version"))


def _incoming(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("doc_id % 5 in (0, 1)")
    return d.select((F.col("doc_id") * 2).alias("doc_id"), "source", F.upper("lang").alias("lang"), F.sha2("text", 256).alias("h"), (F.col("doc_id") % 3).cast("int").alias("version"))


_SQL = """s AS (SELECT doc_id, source, lang, sha256(text) AS h, 1 AS version FROM documents),
i AS (SELECT doc_id * 2 AS doc_id, source, upper(lang) AS lang, sha256(text) AS h, CAST(doc_id % 3 AS INTEGER) AS version FROM documents WHERE doc_id % 5 IN (0, 1))"""


@query()
def w01_stable_ids(spark, sf_dir):
    """Name-based UUIDs; the test compares them with Python's uuid, as SQL there has none."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", ids.stable_id("t1", F.lit("chunk"), F.col("source"), F.lit("body"), F.col("doc_id"), F.sha2("text", 256)).alias("chunk_id"))


@query(
    f"""WITH {_SQL}, b AS (SELECT *, 0 AS n FROM s UNION ALL SELECT *, 1 FROM i)
SELECT doc_id, source, lang, h, version FROM b QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY version DESC, n DESC) = 1"""
)
def w02_upsert(spark, sf_dir):
    return writes.upsert(_stored(spark, sf_dir), _incoming(spark, sf_dir), ["doc_id"], "version")


@query(f"WITH {_SQL} SELECT doc_id, source FROM s WHERE source NOT IN (SELECT source FROM i WHERE version = 2) OR (doc_id, source) IN (SELECT doc_id, source FROM i WHERE version = 2)")
def w03_without_stale(spark, sf_dir):
    return writes.without_stale(_stored(spark, sf_dir), _incoming(spark, sf_dir).where("version = 2"), "source", "doc_id").select("doc_id", "source")


@query(
    """SELECT doc_id, sha256(replace(text, chr(13) || chr(10), chr(10))) AS content_hash, true AS pre_cleaned, '1.0.0' AS version, coalesce(nullif(source, ''), 'unknown') AS source FROM documents"""
)
def w04_metadata(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", ids.content_hash(F.col("text")).alias("content_hash"), F.lit(True).alias("pre_cleaned"), F.lit("1.0.0").alias("version"), F.coalesce(F.nullif("source", F.lit("")), F.lit("unknown")).alias("source"))


@query(f"WITH {_SQL}, k AS (SELECT DISTINCT source, h FROM s WHERE doc_id % 2 = 0) SELECT i.doc_id, k.h IS NULL AS written FROM i LEFT JOIN k ON k.source = i.source AND k.h = i.h")
def w05_split_known(spark, sf_dir):
    fresh, known = writes.split_known(_stored(spark, sf_dir).where("doc_id % 2 = 0"), _incoming(spark, sf_dir), "source", "h")
    return fresh.select("doc_id", F.lit(True).alias("written")).unionByName(known.select("doc_id", F.lit(False).alias("written")))


@query(
    f"""WITH {_SQL}, k AS (SELECT * FROM s WHERE source LIKE '%1%'), f AS (SELECT * FROM i WHERE source NOT IN (SELECT source FROM k) QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) = 1)
SELECT doc_id, source FROM k UNION ALL SELECT doc_id, source FROM f"""
)
def w06_insert_missing(spark, sf_dir):
    return writes.insert_missing(_stored(spark, sf_dir).where("source like '%1%'"), _incoming(spark, sf_dir), ["source"], ["doc_id"]).select("doc_id", "source")


@query(
    """WITH e AS (SELECT c_name AS source, s_name AS target FROM customer JOIN supplier ON s_suppkey = c_custkey % 150), n AS (SELECT c_name AS name, c_custkey AS id FROM customer WHERE c_custkey % 4 <> 0 UNION ALL SELECT s_name, -s_suppkey FROM supplier)
SELECT a.id AS source_id, b.id AS target_id FROM e JOIN n a ON a.name = e.source JOIN n b ON b.name = e.target"""
)
def w07_resolved_edges(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    edges = c.join(s, F.col("s_suppkey") == F.col("c_custkey") % 150).select(F.col("c_name").alias("source"), F.col("s_name").alias("target"))
    nodes = c.where("c_custkey % 4 <> 0").select(F.col("c_name").alias("name"), F.col("c_custkey").alias("node_id")).unionByName(s.select(F.col("s_name").alias("name"), (-F.col("s_suppkey")).alias("node_id")))
    return writes.resolved_edges(edges, nodes)


@query(
    """WITH f AS (SELECT source, max(n_chars) AS modified FROM documents GROUP BY source), p AS (SELECT source, max(n_chars) AS stamp FROM documents WHERE doc_id % 3 = 0 GROUP BY source)
SELECT source, modified FROM f LEFT JOIN p USING (source) WHERE stamp IS NULL OR stamp < modified"""
)
def w08_stale_folders(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    folders = d.groupBy("source").agg(F.max("n_chars").alias("modified"))
    saved = d.where("doc_id % 3 = 0").groupBy("source").agg(F.max("n_chars").alias("stamp"))
    return writes.stale_folders(folders, saved, "source", "modified", "stamp").select("source", "modified")


@query(
    """WITH o AS (SELECT doc_id, lang, n_chars FROM documents WHERE doc_id % 7 <> 0), n AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE lang END AS lang, n_chars FROM documents WHERE doc_id % 5 <> 0)
SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'created' WHEN n.doc_id IS NULL THEN 'deleted' WHEN o.lang IS NOT DISTINCT FROM n.lang AND o.n_chars IS NOT DISTINCT FROM n.n_chars THEN 'unchanged' ELSE 'updated' END AS status
FROM o FULL JOIN n ON o.doc_id = n.doc_id"""
)
def w12_changed(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    new = d.where("doc_id % 5 <> 0").withColumn("lang", F.when(F.col("doc_id") % 11 != 0, F.col("lang")))
    return writes.changed(d.where("doc_id % 7 <> 0"), new, "doc_id", ["lang", "n_chars"])


@query("SELECT user_id, count(*) AS jobs, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE value > 50) AS chunks FROM events GROUP BY user_id")
def w13_job_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id")
    return e.agg(F.count("*").alias("jobs"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("value") > 50).alias("chunks"))
