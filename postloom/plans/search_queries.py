"""Queries of retrieval, fusion and ranking (X, V, H), over documents, embeddings, conversations and benchmark."""

from __future__ import annotations


from pyspark.sql import functions as F

from postloom.functions import vectors as V
from postloom.operators import lexical, ranking, vector
from postloom.plans import search
from postloom.plans.registry import query, quoted, table
from postloom.sources.tables import small_batches

TERMS = ["the", "and", "thing", "ening", "der", "que"]
_TERMS_SQL = "[" + ", ".join(map(quoted, TERMS)) + "]"
_SCORE = f"len(list_intersect(string_split_regex(lower(text), '[^a-z0-9]+'), {_TERMS_SQL}))"
_COS = "round(list_cosine_similarity(CAST({} AS DOUBLE[]), CAST({} AS DOUBLE[])), 6)"


def _vector(spark, sf_dir) -> list[float]:
    """The query vector: that of vec_id 0."""
    rows = table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").take(1)
    return list(rows[0][0]) if rows else []


_LISTS = f"""
lex0 AS (SELECT doc_id, source, text, {_SCORE} AS score FROM documents),
lex1 AS (SELECT doc_id, source, sha256(text) AS h, score FROM lex0 WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 150),
vec0 AS (SELECT e.vec_id AS doc_id, {_COS.format("e.embedding", "q.embedding")} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q),
vec1 AS (SELECT doc_id, score FROM vec0 ORDER BY score DESC, doc_id LIMIT 150),
vec2 AS (SELECT d.doc_id, d.source, sha256(d.text) AS h, v.score FROM vec1 v JOIN documents d USING (doc_id)),
lex AS (SELECT * FROM lex1 QUALIFY row_number() OVER (PARTITION BY h ORDER BY score DESC, doc_id) = 1),
vec AS (SELECT * FROM vec2 QUALIFY row_number() OVER (PARTITION BY h ORDER BY score DESC, doc_id) = 1),
top5 AS (SELECT DISTINCT source FROM (SELECT source FROM lex1 ORDER BY score DESC, doc_id LIMIT 5)),
fields AS (SELECT doc_id, coalesce(l.source, v.source) AS source, CAST(l.score AS DOUBLE) AS lexical_score, v.score AS vector_score FROM lex l FULL JOIN vec v USING (doc_id))"""
_RRF = """
fused AS (SELECT doc_id, round(sum(p), 9) AS fusion FROM (
  SELECT doc_id, 1.0 / (60 + row_number() OVER (ORDER BY score DESC, doc_id)) AS p FROM lex
  UNION ALL SELECT doc_id, 1.0 / (60 + row_number() OVER (ORDER BY score DESC, doc_id)) FROM vec) GROUP BY doc_id)"""
_WEIGHTED = """
fused AS (SELECT doc_id, round(0.5 * coalesce(v.score, 0) + 0.5 * coalesce(l.score / (SELECT max(score) FROM lex1), 0), 9) AS fusion FROM lex l FULL JOIN vec v USING (doc_id))"""
_OUT = """
SELECT doc_id, round(fusion * CASE WHEN t.source IS NOT NULL THEN 1.2 ELSE 1 END, 9) AS fusion, lexical_score, vector_score, t.source IS NOT NULL AS boosted
FROM fused JOIN fields USING (doc_id) LEFT JOIN top5 t ON t.source = fields.source ORDER BY 2 DESC, 1 LIMIT 50"""


@query(f"WITH {_LISTS}, {_RRF} {_OUT}")
def hybrid_search(spark, sf_dir):
    return search.hybrid(table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings"), TERMS, _vector(spark, sf_dir))


@query(f"WITH {_LISTS}, {_WEIGHTED} {_OUT}")
def h03_weighted_search(spark, sf_dir):
    settings = search.SearchSettings(fusion="weighted")
    return search.hybrid(table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings"), TERMS, _vector(spark, sf_dir), settings)


@query(f"SELECT doc_id, {_SCORE} AS score FROM documents WHERE NOT contains(lower(text), 'zu') AND {_SCORE} > 0 ORDER BY score DESC, doc_id LIMIT 100")
def x07_lexical_top(spark, sf_dir):
    return search.lexical_hits(table(spark, sf_dir, "documents"), TERMS, 100, ["zu"]).select("doc_id", "score")


@query(
    """WITH t AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(regexp_replace(text, '[^\\x00-\\x7F]', ' ', 'g')), '[^a-z0-9]+'), lambda x: x <> '')) AS w FROM documents)
SELECT doc_id FROM t GROUP BY doc_id HAVING bool_or(w IN ('the', 'der')) AND bool_or(w IN ('and', 'que', 'of'))"""
)
def x03_boolean_match(spark, sf_dir):
    words = lexical.tokens(F.regexp_replace("text", r"[^\x00-\x7F]", " "))
    return table(spark, sf_dir, "documents").where(lexical.matching(words, [["the", "der"], ["and", "que", "of"]])).select("doc_id")


@query()
def x05_cover_density(spark, sf_dir):
    """Ranks by minimal covers of stems; no SQL, as covers are found by a scan of each document's hits."""
    docs = small_batches(table(spark, sf_dir, "documents"))
    groups = lexical.expanded("released license", {"these": ["those"]})
    tokens = lexical.token_table(docs, "doc_id", {"source": "A", "text": "B"})
    groups = [[lexical.stem(w) for w in g] for g in groups]
    return lexical.cover_density(tokens, "doc_id", groups).orderBy(F.desc("rank"), "doc_id").limit(100)


@query()
def x08_snippets(spark, sf_dir):
    docs = small_batches(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", lexical.snippet(F.col("text"), ["the"]).alias("snippet"))


@query("SELECT doc_id, substr(text, greatest(greatest(strpos(text, 'the'), 1) - 50, 1), 100) AS part FROM documents")
def x09_window_around(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", lexical.window_around(F.col("text"), F.lit("the"), 50).alias("part"))


@query(
    f"""SELECT e.vec_id, {_COS.format("e.embedding", "q.embedding")} AS similarity, round(greatest(0, least(1, ({_COS.format("e.embedding", "q.embedding")} + 1) / 2)), 4) AS score
FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.label <> 3 ORDER BY similarity DESC, e.vec_id LIMIT 100"""
)
def v01_nearest(spark, sf_dir):
    return vector.nearest(table(spark, sf_dir, "embeddings"), _vector(spark, sf_dir), 100, F.col("label") != 3)


@query("SELECT vec_id, len(embedding) = 64 AND len(list_filter(embedding, lambda x: isnan(x))) = 0 AS usable, round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 6) AS norm FROM embeddings")
def v03_usable_vectors(spark, sf_dir):
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", V.usable(e, 64).alias("usable"), F.round(V.norm(e), 6).alias("norm"))


@query("SELECT vec_id, round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda y: y * y))))), 6) AS total FROM embeddings")
def v04_normalized(spark, sf_dir):
    total = F.aggregate(V.normalized(F.col("embedding")), F.lit(0.0), lambda s, x: s + x)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(total, 6).alias("total"))


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, {_COS.format('a.embedding', 'b.embedding')} AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def v07_pair_cosine(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    pairs = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")).join(e.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("y")), "a")
    return pairs.select("a", "b", F.round(V.cosine(F.col("x"), F.col("y")), 6).alias("cosine"))


@query(
    """WITH s AS (SELECT doc_id, text, source, n_chars % 97 AS score FROM documents)
SELECT doc_id, score FROM s QUALIFY row_number() OVER (PARTITION BY CASE WHEN doc_id % 10 = 0 THEN 'id' || doc_id ELSE sha256(text) END ORDER BY score DESC, doc_id) = 1"""
)
def h01_best_of_each(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 97).alias("score"), F.when(F.col("doc_id") % 10 != 0, F.sha2("text", 256)).alias("content_hash"))
    return ranking.best_of_each(rows, "content_hash", "score", ["doc_id"]).select("doc_id", "score")


@query(
    """WITH a AS (SELECT item_id AS id, round(length(text) / 1000.0, 6) AS lexical_score FROM benchmark WHERE item_id % 3 <> 0), b AS (SELECT vec_id AS id, round(CAST(abs(embedding[1]) AS DOUBLE), 6) AS vector_score FROM embeddings WHERE vec_id % 4 <> 0),
j AS (SELECT id, lexical_score, vector_score, round(0.3 * coalesce(vector_score, 0) + 0.7 * coalesce(lexical_score, 0), 9) AS fusion FROM a FULL JOIN b USING (id)),
m AS (SELECT max(lexical_score) AS l, max(vector_score) AS v FROM j),
r AS (SELECT id, fusion, round(0.35 * coalesce(vector_score, 0) / v + 0.65 * coalesce(lexical_score, 0) / l, 9) AS rerank_score FROM j, m)
SELECT id, round(rerank_score, 4) AS rerank_score, round(0.5 * fusion + 0.5 * rerank_score, 4) AS score FROM r"""
)
def h07_light_rerank(spark, sf_dir):
    a = table(spark, sf_dir, "benchmark").where("item_id % 3 <> 0").select(F.col("item_id").alias("id"), F.round(F.length("text") / 1000.0, 6).alias("score"))
    b = table(spark, sf_dir, "embeddings").where("vec_id % 4 <> 0").select(F.col("vec_id").alias("id"), F.round(F.abs(F.col("embedding")[0]).cast("double"), 6).alias("score"))
    hits = ranking.weighted(a, b, "id", 0.3).withColumnRenamed("fusion", "score")
    return ranking.light_rerank(hits).select("id", F.round("rerank_score", 4).alias("rerank_score"), F.round("score", 4).alias("score"))


_DAYS = "(epoch(TIMESTAMP '2024-02-01') - epoch(ts)) / 86400.0"


@query(
    f"""SELECT event_id, round(value * (1 + exp(-ln(2) / 30 * greatest({_DAYS}, 0))), 6) AS boosted,
    round(CASE WHEN {_DAYS} < 0 THEN value ELSE value * pow(0.5, floor({_DAYS}) / 30) END, 6) AS halved FROM events"""
)
def h09_recency(spark, sf_dir):
    days = (F.unix_micros(F.lit("2024-02-01").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 86_400_000_000
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", F.round(ranking.recency(F.col("value"), days), 6).alias("boosted"), F.round(ranking.half_power_recency(F.col("value"), days), 6).alias("halved"))


@query("SELECT vec_id, round(CASE WHEN label = 2 THEN vec_id * CAST(0.7 AS DOUBLE) ELSE vec_id END, 6) AS score FROM embeddings")
def h10_quoted_factor(spark, sf_dir):
    kind = F.when(F.col("label") == 2, "quoted_history").otherwise("message_body")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(ranking.quoted_factor(F.col("vec_id").cast("double"), kind), 6).alias("score"))


_SET = "list_distinct(list_filter(string_split_regex(lower(left({}, 4096)), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> ''))"


@query(
    f"""WITH s AS (SELECT conv_id, turn, {_SET.format("text")} AS s FROM conversations)
SELECT a.conv_id, a.turn, round(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))), 6) AS jaccard FROM s a JOIN s b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"""
)
def h11_jaccard_pairs(spark, sf_dir):
    s = table(spark, sf_dir, "conversations").select("conv_id", "turn", ranking.token_set(F.col("text")).alias("s"))
    nxt = s.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("s").alias("t"))
    return s.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", F.round(ranking.jaccard(F.col("s"), F.col("t")), 6).alias("jaccard"))


@query()
def h11_diverse(spark, sf_dir):
    """Maximal marginal relevance for each language's 200 longest documents, all others after them by length; no SQL, as
    picks depend on each other."""
    docs = table(spark, sf_dir, "documents").select("lang", "doc_id", (F.col("n_chars") / 20000.0).alias("score"), "text")
    return ranking.diverse(docs, "lang", "doc_id", "score", "text")


@query(
    """SELECT conv_id, turn, least(length(text), greatest(400 - coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)) AS room
FROM conversations QUALIFY room > 0"""
)
def h19_char_budget(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    out = ranking.within_budget(rows, F.length("text").cast("long"), 400, ["turn"], ["conv_id"])
    return out.select("conv_id", "turn", "room")


@query("SELECT source, min(doc_id) AS first_id, max(doc_id) AS last_id, count(*) AS n, min_by(lang, doc_id) AS first_lang FROM documents GROUP BY source")
def h17_rollup(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count("*").alias("n"), F.min_by("lang", "doc_id").alias("first_lang"))


@query(
    """WITH a AS (SELECT conv_id, turn, text || ' Source ' || (turn + 1) || ' and Source 2' AS t FROM conversations),
c AS (SELECT conv_id, turn, list_distinct(list_transform(regexp_extract_all(t, 'Source (\\d+)', 1), lambda x: CAST(x AS INTEGER))) AS s FROM a)
SELECT conv_id, turn, len(s) AS n_cited, CAST(round(least(0.95, 0.5 + 0.1 * len(s)), 6) AS DOUBLE) AS confidence FROM c"""
)
def h18_evidence(spark, sf_dir):
    text = F.concat("text", F.lit(" Source "), (F.col("turn") + 1).cast("string"), F.lit(" and Source 2"))
    cited = F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(r"Source (\d+)"), F.lit(1))), 1, 5)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(cited).cast("long").alias("n_cited"))
    return rows.withColumn("confidence", F.round(F.when(F.col("n_cited") > 0, F.least(F.lit(0.95), 0.5 + 0.1 * F.col("n_cited"))).otherwise(0.6), 6))
