"""Queries of whole retrieval (F, X, V, H): documents as chunks, customers as conversations, orders as their graph."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import functions as F

from postloom.functions import vectors as V
from postloom.operators import filters, lexical, ranking
from postloom.plans import graph_queries, retrieval
from postloom.plans.registry import query, table
from postloom.plans.search_queries import _vector

_CONVERSATIONS = 1000  # documents belong to conversations by their id; more than the graph may name
# every stage has something to do for it: no document names a supplier, and many are licensed
_ASKED = "the license of the Supplier type:en,de after:2000-01-01 -zu"
_SYNONYMS = {"supplier": ["released", "licensed"]}


def _customers(spark, sf_dir):
    """Customers as conversations."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").cast("timestamp").alias("latest_date"))
    c = table(spark, sf_dir, "customer").join(o, "c_custkey", "left")
    people = F.array(F.struct(F.lit("sender").alias("role"), F.concat("c_mktsegment", F.lit("@x.org")).alias("smtp")))
    return c.select(F.col("c_custkey").alias("conversation_id"), F.col("c_name").alias("subject"), F.col("c_mktsegment").alias("summary"), "latest_date", people.alias("participants"))


def corpus(spark, sf_dir) -> retrieval.Corpus:
    d = table(spark, sf_dir, "documents")
    of = (F.col("doc_id") % _CONVERSATIONS + 1).alias("conversation_id")
    chunks = d.select(
        F.col("doc_id").alias("chunk_id"),
        of,
        "text",
        F.when(F.col("doc_id") % 5 == 0, "quoted_history").otherwise("message_body").alias("chunk_type"),
        (F.col("doc_id") % 3 == 0).alias("is_attachment"),
        F.col("lang").alias("file_type"),
    )
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    # a conversation's first document is its summary
    first = d.groupBy(of).agg(F.min("doc_id").alias("doc_id"))  # a row a conversation
    summaries = d.select("doc_id", "text").join(F.broadcast(first), "doc_id").select("conversation_id", "text")
    conversations = _customers(spark, sf_dir).join(summaries, "conversation_id", "left").withColumn("summary", F.concat_ws(" ", "summary", "text")).drop("text")
    edges = graph_queries._edges(spark, sf_dir).withColumn("conversation_id", F.col("conversation_id") % _CONVERSATIONS + 1)
    return retrieval.Corpus(chunks, vectors, conversations, graph_queries._nodes(spark, sf_dir), edges)


def _settings(spark, sf_dir) -> retrieval.Settings:
    """Times count from the last order."""
    last = table(spark, sf_dir, "orders").agg(F.unix_seconds(F.max("o_orderdate").cast("timestamp"))).first()[0]
    now = retrieval.Settings.now if last is None else datetime.fromtimestamp(last, UTC)
    return retrieval.Settings(synonyms=_SYNONYMS, now=now)


@query()
def h00_retrieve(spark, sf_dir):
    """The whole of retrieval for a query with filters; no SQL, as ranks come from covers of stems and picks depend on each
    other. A test holds it against plain Python."""
    return retrieval.retrieve(corpus(spark, sf_dir), _ASKED, _vector(spark, sf_dir), _settings(spark, sf_dir))


@query()
def x06_conversation_search(spark, sf_dir):
    """Conversations by full-text rank with escaped snippets; no SQL, as covers are found by a scan."""
    return lexical.conversation_search(_customers(spark, sf_dir), "machinery customer", limit=50)


@query(
    """WITH h AS (SELECT doc_id, source, lang, n_chars / 1000.0 AS s FROM documents),
t AS (SELECT DISTINCT source FROM (SELECT source FROM h ORDER BY s DESC, doc_id LIMIT 5))
SELECT doc_id, t.source IS NOT NULL AS summary_boosted, coalesce(h.lang = 'fr', false) AS graph_boosted,
  round(s * CASE WHEN t.source IS NOT NULL THEN 1.2 ELSE 1 END * CASE WHEN h.lang = 'fr' THEN 1.15 ELSE 1 END, 6) AS score FROM h LEFT JOIN t ON t.source = h.source"""
)
def h06_boosts(spark, sf_dir):
    """Both boosts with their flags: by a list of the five best, then by a set found elsewhere."""
    hits = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", (F.col("n_chars") / 1000.0).alias("score"))
    leading = hits.orderBy(F.desc("score"), "doc_id").limit(5).select("source")
    one = ranking.boosted(hits, "score", "source", leading, ranking.SUMMARY_BOOST, "summary_boosted")
    two = ranking.boosted(one, "score", "lang", spark.createDataFrame([("fr",)], "lang string"), ranking.GRAPH_BOOST, "graph_boosted")
    return two.select("doc_id", "summary_boosted", "graph_boosted", F.round("score", 6).alias("score"))


@query("SELECT doc_id, CAST(length(text) % 101 AS DOUBLE) AS score FROM (SELECT doc_id, left(text, 4096) AS text, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50)")
def h08_rescored(spark, sf_dir):
    """A scorer in place of the list's own scores, over its 50 highest; the others leave the list."""
    hits = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("n_chars").cast("double").alias("score"))
    return ranking.rescored(hits, lambda asked, texts: [float(len(t) % 101) for t in texts], "any", "doc_id", F.col("text"), "score").select("doc_id", "score")


@query()
def h12_diverse_vectors(spark, sf_dir):
    """Maximal marginal relevance by embeddings, ten of each label; no SQL, as picks depend on each other."""
    e = table(spark, sf_dir, "embeddings").withColumn("v", V.normalized(F.col("embedding")))
    hits = e.select("label", "vec_id", F.round(F.col("v")[0], 6).alias("score"), "v")
    return ranking.diverse_vectors(hits, "label", "vec_id", "score", "v", 10)


@query(
    """WITH s AS (SELECT doc_id, sha256(text) AS h, n_chars % 97 AS score FROM documents WHERE text IS NOT NULL),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY h ORDER BY score DESC, doc_id) = 1)
SELECT doc_id, score FROM b WHERE score >= 40"""
)
def h16_over_threshold(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 97).alias("score"), F.sha2("text", 256).alias("content_hash"))
    return ranking.over_threshold(rows, "content_hash", "score", ["doc_id"], 40).select("doc_id", "score")


@query(
    """SELECT conv_id, array_to_string(list_distinct([x for x in ['t' || (conv_id % 5), role, '', 't' || turn, role] if x <> '']), '') IS NOT NULL AS some,
  len(list_distinct([x for x in ['t' || (conv_id % 5), role, '', 't' || turn, role] if x <> ''])) AS n FROM conversations"""
)
def v05_merged_ids(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    a = F.array(F.concat(F.lit("t"), (F.col("conv_id") % 5).cast("string")), F.col("role"), F.lit(""))
    b = F.array(F.concat(F.lit("t"), F.col("turn").cast("string")), F.col("role"))
    ids = filters.merged_ids(a, b)
    return c.select("conv_id", ids.isNotNull().alias("some"), F.size(ids).cast("long").alias("n"))


@query(
    """SELECT c_custkey FROM customer WHERE contains(lower(c_name), 'customer#0000') AND NOT contains(lower(c_name), '7') AND (c_mktsegment = 'BUILDING' OR lower(c_mktsegment) IN ('machinery', 'household'))"""
)
def f13_subject_filter(spark, sf_dir):
    """The older filter: words are excluded by subject, and a row without a type passes."""
    f, _ = filters.parse("subject:customer#0000 type:machinery,household -7")
    c = table(spark, sf_dir, "customer")
    kind = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment"))
    return c.where(filters.subject_filter(f, F.col("c_name"), F.lit("a.pdf"), kind, F.lit(None).cast("timestamp"))).select("c_custkey")


@query(
    """SELECT 'all' AS asked, count(*) AS n FROM orders UNION ALL SELECT 'none', 0 UNION ALL SELECT 'some', count(*) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)"""
)
def f11_narrowed(spark, sf_dir):
    """No list of ids leaves all rows, an empty one leaves none."""
    o = table(spark, sf_dir, "orders")
    ids = table(spark, sf_dir, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    out = [filters.narrowed(o, x, "o_custkey").agg(F.count("*").alias("n")).select(F.lit(name).alias("asked"), "n") for name, x in (("all", None), ("none", ids.where("false")), ("some", ids))]
    return out[0].unionByName(out[1]).unionByName(out[2])
