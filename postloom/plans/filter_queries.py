"""Queries of the filter grammar (F): customers as conversations, documents as chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from postloom.operators import filters
from postloom.plans.registry import query, table


def _conversations(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("latest_date"))
    c = table(spark, sf_dir, "customer").join(o, "c_custkey")
    people = F.array(
        F.struct(F.lit("sender").alias("role"), F.concat("c_mktsegment", F.lit("@X.org")).alias("smtp")),
        F.struct(F.lit("recipient").alias("role"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string"), F.lit("@x.org")).alias("smtp")),
    )
    return c.select(F.col("c_custkey").alias("conversation_id"), F.col("c_name").alias("subject"), "latest_date", people.alias("participants"))


_C = """c AS (SELECT c_custkey AS conversation_id, c_name AS subject, max(o_orderdate) AS latest_date, lower(c_mktsegment) AS seg, c_nationkey AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL)"""


@query(f"WITH {_C} SELECT conversation_id FROM c WHERE contains(lower(subject), 'customer#0000') AND latest_date >= TIMESTAMP '1995-01-01' AND latest_date <= TIMESTAMP '1998-06-01' AND seg || '@x.org' IN ('building@x.org', 'machinery@x.org') AND n IN (3, 7, 11)")
def f09_conversation_filter(spark, sf_dir):
    f, _ = filters.parse('subject:"Customer#0000" after:1995-01-01 before:1998-06-01 from:building@x.org from:Machinery@x.org to:n3@x.org to:n7@x.org to:n11@x.org budget')
    return filters.resolve(f, _conversations(spark, sf_dir))


@query("SELECT doc_id FROM documents WHERE doc_id % 3 = 0 AND lang IN ('en', 'de') AND NOT contains(lower(text), 'zu') AND NOT contains(lower(text), 'license')")
def f07_chunk_filter(spark, sf_dir):
    f, _ = filters.parse("has:attachment type:en,.de report -zu -license")
    return table(spark, sf_dir, "documents").where(filters.chunk_filter(f, F.col("text"), F.col("doc_id") % 3 == 0, F.col("lang"))).select("doc_id")


@query(f"WITH {_C}, k AS (SELECT conversation_id FROM c WHERE n = 3) SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT conversation_id FROM k) AND o_orderstatus = 'F'")
def f12_narrowed(spark, sf_dir):
    """Two id sets narrowed to what both hold, as semi joins."""
    f, _ = filters.parse("to:n3@x.org")
    ids = filters.resolve(f, _conversations(spark, sf_dir)).select(F.col("conversation_id").alias("o_custkey"))
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").join(ids, "o_custkey", "left_semi").select("o_orderkey")


@query("SELECT doc_id, source FROM documents WHERE lang = 'en' AND source = 'src1'")
def f14_tenant(spark, sf_dir):
    return table(spark, sf_dir, "documents").where((F.col("lang") == "en") & (F.col("source") == "src1")).select("doc_id", "source")
