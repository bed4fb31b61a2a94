"""Queries by indexes that are built once and kept: full text (X-01, X-07), trigrams (G-02); the sample of names that comes
with schema discovery (G-15), rendered facts (G-08), expanded queries (X-04), embedding anew (Y-08, Z-06) and exports (S-20)."""

from __future__ import annotations

from pyspark.sql import functions as F

from postloom.operators import embedding, graph, lexical, text_index, trigram_index
from postloom.plans.graph_queries import _EDGES, _NODES, _TRI, _edges, _nodes
from postloom.plans.registry import query, table
from postloom.sources import exports
from postloom.sources.tables import new_path

_FORMS = "['thing', 'things', 'thinged', 'thinging', 'thingly']"  # the words whose stem is thing


@query(
    f"""WITH t AS (SELECT doc_id, len(list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: list_contains({_FORMS}, w))) AS c FROM documents)
SELECT doc_id, round(0.1::DOUBLE * c / (0.1::DOUBLE * c + 1), 9) AS rank FROM t WHERE c > 0 ORDER BY 2 DESC, 1 LIMIT 100"""
)
def x07_indexed_top(spark, sf_dir):
    """The best texts by cover density from the full-text index of all documents."""
    path = new_path(spark, "text")
    text_index.build(table(spark, sf_dir, "documents"), "doc_id", {"text": "D"}, path)
    return text_index.search(spark, path, "doc_id", [["thing"]], 100)


@query(
    f"""WITH {_NODES}, t AS (SELECT node_id, name, pagerank, {_TRI.format("name")} AS b FROM nodes),
q AS (SELECT node_id AS query_id, {_TRI.format("replace(name, 'e', '')")} AS a FROM nodes WHERE node_id % 20 = 2),
s AS (SELECT query_id, node_id, name, pagerank, len(list_intersect(a, b)) AS c, len(a) AS na, len(b) AS nb FROM q, t),
r AS (SELECT *, round(c / (na + nb - c), 6) AS similarity FROM s WHERE c > 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, pagerank DESC, node_id) AS INTEGER) AS rank, node_id AS id, name, similarity FROM r WHERE similarity > 0.3
QUALIFY rank <= 10"""
)
def g02_indexed_entities(spark, sf_dir):
    """The names most similar to misspelled ones, from the trigram index of all nodes."""
    nodes, path = _nodes(spark, sf_dir), new_path(spark, "names")
    trigram_index.build(nodes, "node_id", "name", path, ("pagerank",))
    asked = nodes.where("node_id % 20 = 2").select(F.col("node_id").alias("query_id"), F.replace("name", F.lit("e"), F.lit("")).alias("name"))
    return trigram_index.similar(spark, path, asked, 10, ("pagerank",))


@query(f"WITH {_NODES} SELECT kind, CAST(row_number() OVER (PARTITION BY kind ORDER BY md5(name), node_id) AS INTEGER) AS place, name FROM nodes QUALIFY place <= 10")
def g15_sampled_names(spark, sf_dir):
    return graph.sampled_names(_nodes(spark, sf_dir), "kind", "name", "node_id", 10)


@query(
    f"""WITH {_NODES}, {_EDGES}, n AS (SELECT * FROM nodes WHERE name IN ('Supplier#000000003', 'Supplier#000000005')),
l AS (SELECT 0 AS part, node_id AS id, 'Entity: ' || name || ' (' || kind || ')' AS line FROM n UNION ALL
  SELECT 1, e.edge_id, s.name || ' ' || lower(replace(e.relation, '_', ' ')) || ' ' || t.name || '.' FROM edges e JOIN nodes s ON s.node_id = e.source_id JOIN n t ON t.node_id = e.target_id)
SELECT CAST(row_number() OVER (ORDER BY part, id, line) AS INTEGER) AS at, line FROM l ORDER BY part, id, line LIMIT 100"""
)
def g08_rendered_facts(spark, sf_dir):
    """The first hundred lines on two entities, for a prompt: the limit is the feature."""
    nodes, edges = _nodes(spark, sf_dir).withColumn("description", F.lit(None).cast("string")), _edges(spark, sf_dir)
    named = nodes.where(F.col("name").isin("Supplier#000000003", "Supplier#000000005"))
    ends = edges.join(F.broadcast(named.select(F.col("node_id").alias("target_id"), F.col("name").alias("target"))), "target_id")  # the named ones
    facts = ends.join(nodes.select(F.col("node_id").alias("source_id"), F.col("name").alias("source")), "source_id")
    return graph.rendered_facts(named, facts.select("edge_id", "source", "relation", "target", F.lit(None).cast("string").alias("description")))


_SYNONYMS = [("the", "this", 2), ("the", "that", 1), ("the", "those", 3), ("and", "also", 1), ("and", "as well", 0), ("of", "from", 1), ("tion", "tion", 0), ("tion", "sion", 1)]
_SYNONYM_ROWS = ", ".join(f"('{w}', '{s}', {p})" for w, s, p in _SYNONYMS)


@query(
    f"""WITH s AS (SELECT * FROM (VALUES {_SYNONYM_ROWS}) v(word, synonym, place) WHERE length(word) > 2 AND synonym <> word AND NOT contains(synonym, ' ')),
m AS (SELECT word, list(synonym ORDER BY place)[1:2] AS more FROM s GROUP BY word),
q AS (SELECT doc_id AS query_id, text AS query, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]+') AS w FROM documents),
e AS (SELECT query_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM q),
t AS (SELECT query_id, string_agg(CASE WHEN more IS NULL THEN word ELSE '(' || word || ' | ' || array_to_string(more, ' | ') || ')' END, ' & ' ORDER BY i) AS expanded FROM e LEFT JOIN m USING (word) GROUP BY query_id)
SELECT q.query_id, sha256(coalesce(expanded, query)) AS hash FROM q LEFT JOIN t USING (query_id)"""
)
def x04_expanded(spark, sf_dir):
    """The documents as queries, expanded by a table of synonyms."""
    asked = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))
    out = lexical.expanded_queries(asked, spark.createDataFrame(_SYNONYMS, "word string, synonym string, place int"))
    return out.select("query_id", F.sha2("expanded", 256).alias("hash"))


@query(
    """SELECT doc_id, CASE WHEN trim(text) <> '' THEN 'embedded' ELSE 'old' END AS forced, CASE WHEN doc_id % 2 = 1 AND trim(text) <> '' THEN 'embedded' ELSE 'old' END AS missing,
CASE WHEN trim(text) <> '' THEN CASE WHEN length(text) % 3 = 0 THEN 'skipped' ELSE 'embedded' END END AS tried FROM documents"""
)
def y08_reembedded(spark, sf_dir):
    """What is embedded anew by force, where an embedding is missing, and with retries (a model that refuses some texts)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    chunks = d.select("doc_id", "text", F.when(F.col("doc_id") % 2 == 0, F.array(F.lit(1.0).cast("float"))).alias("embedding"), F.lit("old").alias("status"))
    status = lambda rows, name: rows.select("doc_id", F.col("status").alias(name))

    def choosy(texts):
        if any(len(t) % 3 == 0 for t in texts):
            raise ValueError("refused")
        return embedding.lengths(texts)

    out = status(embedding.reembedded(chunks, "doc_id", "text", embedding.lengths, force=True), "forced")
    out = out.join(status(embedding.reembedded(chunks, "doc_id", "text", embedding.lengths), "missing"), "doc_id")
    return out.join(status(embedding.embedded_with_retries(d, "doc_id", "text", choosy), "tried"), "doc_id", "left")


@query("SELECT CAST(to_json({'doc_id': doc_id, 'lang': lang, 'source': source, 'n_chars': n_chars}) AS VARCHAR) AS json FROM documents")
def s20_json_rows(spark, sf_dir):
    return exports.json_rows(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"))


@query(
    """WITH t AS (SELECT doc_id, lang, regexp_replace(text, '\\s+', ' ', 'g') AS text FROM documents)
SELECT rtrim(lpad(CAST(doc_id AS VARCHAR), 9, ' ') || '  ' || rpad(coalesce(lang, ''), 4, ' ') || '  ' || rpad(coalesce(CASE WHEN length(text) > 40 THEN left(text, 37) || '...' ELSE text END, ''), 40, ' '), ' ') AS line FROM t"""
)
def s20_table_rows(spark, sf_dir):
    return exports.table_rows(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), {"doc_id": 9, "lang": 4, "text": 40})
