"""Licence scans: canonical digests of entire texts, hash-joined to the digests of known licences.

A text's canonical form has A-Z lower-cased, copyright lines left out, equivalent spellings made one, and every run of
punctuation, symbols and white space as one space; its digest is SHA-256. A document's entire text is looked up, and so
is each of its lines as a text of its own, since a notice is often one line among others.

Only built-in functions run. Texts without any cue word that all known texts hold at least one of are never canonicalised;
where a known text holds no cue, that filter is left out. The known digests are broadcast up to BROADCAST_ROWS of them
and joined by shuffle beyond; only rows that matched are aggregated.

Edge cases: null, empty and wholly punctuated texts match nothing. Rows that repeat a doc_id, null among them, each have a
row, with what their texts have together. A digest known under several identifiers reports each. Extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm.license_texts import KNOWN

BROADCAST_ROWS = 100_000  # of a 32-byte digest and an identifier

#: Equivalent spellings, applied in this order to the lower-cased text: fixed values.
SPELLINGS = [
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("non-infringement", "noninfringement"),
    ("acknowledgement", "acknowledgment"),
    ("judgement", "judgment"),
    ("authoris", "authoriz"),
    ("organis", "organiz"),
    ("recognis", "recogniz"),
    ("favour", "favor"),
    ("behaviour", "behavior"),
    ("honour", "honor"),
    ("wilful", "willful"),
    ("https://", "http://"),
    ("&", " and "),
]
COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n]*(?:copyright|\(c\)|©)[^\n]*$"
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F\x{A0}-\x{BF}\x{2000}-\x{206F}]+"
CUES = ["licen", "permi", "spdx"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def canonical(text: Column) -> Column:
    """The canonical form of a text."""
    out = F.regexp_replace(F.translate(text, UPPER, LOWER), COPYRIGHT_LINE, "")
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(out, GAPS, " "))


def _cued(text: Column) -> Column:
    """Whether a text may hold a cue. lower() also changes letters beyond A-Z, which can only let more texts through."""
    low = F.lower(text)
    return reduce(lambda a, b: a | b, (F.contains(low, F.lit(cue)) for cue in CUES))


def known_digests(spark: SparkSession, known: list[tuple[str, str]]) -> DataFrame:
    """Rows (digest, license) of known (identifier, text) pairs."""
    texts = spark.createDataFrame(known, "license string, text string").withColumn("canon", canonical(F.col("text")))
    return texts.where("canon <> ''").select(F.sha2("canon", 256).alias("digest"), "license").distinct()


def scan(docs: DataFrame, known: list[tuple[str, str]] = KNOWN) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, license (of the entire text; the first by name of several),
    n_notices (lines that are a known text), licenses (identifiers found, sorted, joined by commas)."""
    digests = known_digests(docs.sparkSession, known)
    if len(known) <= BROADCAST_ROWS:
        digests = F.broadcast(digests)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    lines = F.split("text", "\n")
    if all(any(c in t.lower() for c in CUES) for _, t in known):
        rows = rows.where(_cued(F.col("text")))
        lines = F.filter(lines, _cued)
    unit = lambda whole: lambda t: F.struct(F.lit(whole).alias("whole"), t.alias("text"))
    units = rows.select("doc_id", F.explode(F.concat(F.transform(F.array("text"), unit(True)), F.transform(lines, unit(False)))).alias("u")).select("doc_id", "u.whole", "u.text")
    found = units.select("doc_id", "whole", F.sha2(canonical(F.col("text")), 256).alias("digest")).join(digests, "digest")
    per_doc = found.groupBy(F.col("doc_id").alias("id")).agg(
        F.min(F.when(F.col("whole"), F.col("license"))).alias("license"),
        F.count_if(~F.col("whole")).alias("n_notices"),
        F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"),
    )
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    joined = every.join(per_doc, every["doc_id"].eqNullSafe(per_doc["id"]), "left")
    return joined.select("doc_id", "license", F.coalesce("n_notices", F.lit(0)).alias("n_notices"), F.coalesce("licenses", F.lit("")).alias("licenses"))


def scan_sql(known: list[tuple[str, str]] = KNOWN) -> str:
    """The same result in DuckDB's SQL."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    form = lambda c: f"regexp_replace(translate({c}, '{UPPER}', '{LOWER}'), {quoted(COPYRIGHT_LINE)}, '', 'g')"

    def canon(c: str) -> str:
        out = form(c)
        for a, b in SPELLINGS:
            out = f"replace({out}, {quoted(a)}, {quoted(b)})"
        return f"trim(regexp_replace({out}, {quoted(GAPS)}, ' ', 'g'))"

    values = ", ".join(f"({quoted(i)}, {quoted(t)})" for i, t in known)
    return f"""
WITH k AS (SELECT DISTINCT license, sha256(c) AS digest FROM (SELECT license, {canon("t")} AS c FROM (VALUES {values}) v(license, t)) WHERE c <> ''),
u AS (
  SELECT doc_id, true AS whole, text AS t FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT doc_id, false, unnest(string_split(text, chr(10))) FROM documents WHERE text IS NOT NULL
), f AS (SELECT u.doc_id, u.whole, k.license FROM u JOIN k ON sha256({canon("u.t")}) = k.digest),
g AS (
  SELECT doc_id, min(CASE WHEN whole THEN license END) AS license, count(CASE WHEN NOT whole THEN 1 END) AS n_notices,
         string_agg(DISTINCT license, ',' ORDER BY license) AS licenses
  FROM f GROUP BY doc_id
)
SELECT d.doc_id, g.license, coalesce(g.n_notices, 0) AS n_notices, coalesce(g.licenses, '') AS licenses
FROM documents d LEFT JOIN g ON d.doc_id IS NOT DISTINCT FROM g.doc_id
"""
