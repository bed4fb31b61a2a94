"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm import decontaminate, language_id, license_scan, mixing, ngram_join, packing, phrases, pii, spelling, substring_dedup, top_k, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.languages(_table(spark, sf_dir, "documents"))


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return top_k.top_k(vectors.where(F.col("vec_id") % 50 == 0), vectors, "vec_id", "embedding", k=5, scale=256)


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents"))


def tokenizer() -> str:
    """The tokenizer file that the packing query takes."""
    from public_tokenizers import path

    return path("byte_bpe_50k.json")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"), tokenizer())


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_records(_table(spark, sf_dir, "pages"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.remove_repeats(_table(spark, sf_dir, "documents")))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predictions(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    all_of = (
        op1_language_id,
        op2_top_k,
        op3_ngram_join,
        op4_packing,
        op5_warc,
        op6_substring_dedup,
        op7_pii,
        op8_toxicity,
        op9_license_scan,
        op10_decontaminate,
        op11_phrases,
        op12_spelling,
        op13_mixing,
    )
    return {f.__name__: f for f in all_of}


_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

_OP2 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n, vec_id, score FROM s
)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
"""

_OP3 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents
), h AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS g
  FROM w
), n AS (SELECT doc_id, CAST(len(g) AS BIGINT) AS n FROM h),
e AS (SELECT doc_id, hash(unnest(g)) AS g FROM h),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
c AS (SELECT doc_id, doc_id AS k FROM n UNION SELECT c.doc_id, l.b FROM c JOIN l ON l.a = c.k)
SELECT n.doc_id, n.n AS n_shingles, m.k AS component_id FROM n JOIN (SELECT doc_id, min(k) AS k FROM c GROUP BY doc_id) m USING (doc_id)
"""

_OP5 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, html, octet_length(encode(html)) AS n, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS k FROM p),
b AS (
  SELECT *, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((CAST('0x' || substr(h, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS INTEGER)) >> CAST(15 - i % 4 * 5 AS INTEGER)) & 31 AS BIGINT) + 1, 1)), '') AS digest
  FROM d
)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = k THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> k THEN k END AS refers_to
FROM b
"""

_OP6 = f"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM w WHERE len(w) >= 13),
v AS (SELECT doc_id, i, md5(array_to_string(w[i:i+12], ' ')) AS v FROM x),
f AS (SELECT v, min(doc_id) AS k FROM v GROUP BY v),
g AS (SELECT DISTINCT v.doc_id, unnest(range(v.i, v.i + 13)) AS i FROM v JOIN f ON f.v = v.v AND f.k < v.doc_id),
r AS (SELECT doc_id, list(i) AS gone FROM g GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i)), lambda i: w[i]) END, ' ')) AS kept_sha256
FROM w LEFT JOIN r USING (doc_id)
"""


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP11 = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOW}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
g AS (SELECT lang, unnest(flatten(list_transform(range(1, 5), lambda n: list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i+n-1], ' '))))) AS phrase FROM w),
f AS (SELECT lang, phrase, count(*) AS a, string_split(phrase, ' ') AS w FROM g GROUP BY lang, phrase HAVING count(*) >= 30),
n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
c AS (SELECT lang, phrase, a, w, unnest(range(1, len(w))) AS k FROM f WHERE len(w) > 1),
s AS (
  SELECT c.lang, c.phrase, c.a, x.a AS l, y.a AS r, 2000000 * c.a // (x.a + y.a) AS score,
         row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY 2000000 * c.a // (x.a + y.a), k) AS cut
  FROM c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k+1:], ' ')
), o AS (
  SELECT lang, phrase, max(a) AS a FROM (
    SELECT lang, a, unnest(flatten(list_transform(range(2, len(w)), lambda n: list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i+n-1], ' '))))) AS phrase
    FROM f WHERE len(w) > 2) GROUP BY lang, phrase
), r AS (
  SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, s.a DESC, encode(s.phrase)) AS rank, s.phrase, s.a, l, r, score
  FROM s LEFT JOIN o ON o.lang = s.lang AND o.phrase = s.phrase WHERE cut = 1 AND NOT coalesce(100 * o.a >= 80 * s.a, false)
)
SELECT r.lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r.r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM r JOIN n USING (lang) WHERE rank <= 2000
"""

_OP12 = rf"""
WITH RECURSIVE t AS (  -- CRC-32 by half bytes
  SELECT list_transform(range(16), lambda i: list_reduce(list_prepend(CAST(i AS BIGINT), range(4)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), d AS MATERIALIZED (
  SELECT doc_id, run, count(*) AS k
  FROM (SELECT doc_id, unnest(regexp_extract_all({_LOW}, '[a-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents) GROUP BY doc_id, run
), h AS (
  SELECT run, k, length(run) AS size, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM d
), z AS (
  SELECT run, k, size, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(x)), lambda i: CAST(instr('0123456789ABCDEF', x[xor(i, 1) + 1]) - 1 AS BIGINT))),
    lambda c, v: xor(c >> 4, t[(xor(c, v) & 15) + 1])), 4294967295) AS h
  FROM h, t
), v AS MATERIALIZED (
  SELECT word, CAST(sum(k) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % size) || substr(run, h % size + 2) ELSE run END AS word, k FROM z)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5
), e AS (
  SELECT word, n, i, CASE WHEN i = 0 THEN word ELSE substr(word, 1, i - 1) || substr(word, i + 1) END AS cut
  FROM (SELECT word, n, unnest(range(length(word) + 1)) AS i FROM v)
), p AS (
  SELECT DISTINCT a.word, b.word AS near, b.n FROM e a JOIN e b ON a.cut = b.cut AND a.word <> b.word AND (a.i = b.i OR a.i = 0 OR b.i = 0)
), b AS (
  SELECT word, near, n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY n DESC, encode(near)) AS place FROM p
), f AS (
  SELECT v.word, CASE WHEN b.n >= 5 * v.n THEN near END AS form, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN b.n >= 5 * v.n THEN b.n END AS form_n
  FROM v LEFT JOIN b ON b.word = v.word AND place = 1
), c AS (SELECT word, word AS root FROM f UNION ALL SELECT c.word, f.form FROM c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM f JOIN c ON c.word = f.word JOIN f last ON last.word = c.root WHERE last.form IS NULL
"""

_OP13 = f"""
WITH d AS (SELECT doc_id, source, CAST(len({_WORDS.format("coalesce(text, '')")}) AS BIGINT) AS size FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS HUGEINT) AS s,
         CAST(CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS HUGEINT) AS w
  FROM d GROUP BY source
), p AS (
  SELECT *, sum(s) OVER () - coalesce(sum(3 * s) OVER before, 0) AS a, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS b
  FROM s WINDOW before AS (ORDER BY s * 10 // w, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (SELECT arg_min(a, s * 10 // w) AS a, arg_min(b, s * 10 // w) AS b FROM p WHERE a * w <= 3 * s * b),
g AS (
  SELECT source, s.s, CASE WHEN level.a * w <= 3 * s.s * level.b THEN CAST(level.a * w AS DOUBLE) / CAST(level.b AS DOUBLE) ELSE CAST(3 * s.s AS DOUBLE) END AS target,
         CAST(CAST('0x' || substr(md5('0:' || coalesce(source, '')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0::DOUBLE AS u
  FROM s, level
), r AS (
  SELECT doc_id, size, g.s, target, CASE WHEN g.s > 0 THEN target / CAST(g.s AS DOUBLE) ELSE 0 END AS e, u,
         row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id NULLS FIRST) AS i
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, CAST(s AS BIGINT) AS source_size, target, CAST(size * (floor(i * e + u) - floor((i - 1) * e + u)) AS BIGINT) AS taken FROM r
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_top_k": _OP2, "op3_ngram_join": _OP3, "op5_warc": _OP5, "op6_substring_dedup": _OP6, "op9_license_scan": license_scan.scan_sql(), "op11_phrases": _OP11, "op12_spelling": _OP12, "op13_mixing": _OP13}
