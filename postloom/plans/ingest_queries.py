"""Queries of ingest and of further operators: manifests (T-12 to T-16), embedding (W-10, W-11), graph extraction (G-06,
G-10, K-11), approximate neighbours (V-06), context (X-10, Q-04), selections (Y), and grouping sets (A-09)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from postloom.functions import people
from postloom.operators import chunking, embedding, graph, vector, writes
from postloom.plans.registry import query, table
from postloom.sources.tables import new_path, small_batches


@query(
    """WITH p AS (SELECT c_mktsegment AS g, 'From' AS f, lower(c_name) AS k, c_custkey AS i FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_mktsegment, 'To', lower(c_name), c_custkey + 100000 FROM customer WHERE c_custkey % 2 = 0),
d AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY g, k ORDER BY i) = 1), n AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY i) AS n FROM d)
SELECT g, string_agg(f || ':' || k, '|' ORDER BY i) AS people FROM n WHERE n <= 25 GROUP BY g"""
)
def t13_first_seen_people(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    a = c.where("c_custkey % 3 = 0").select(F.col("c_mktsegment").alias("g"), F.lit("From").alias("f"), F.lower("c_name").alias("k"), F.col("c_custkey").alias("i"))
    b = c.where("c_custkey % 2 = 0").select(F.col("c_mktsegment").alias("g"), F.lit("To").alias("f"), F.lower("c_name").alias("k"), (F.col("c_custkey") + 100000).alias("i"))
    first = a.unionByName(b).groupBy("g", "k").agg(F.min(F.struct("i", "f")).alias("m"))
    ranked = first.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("m.i"))).where("n <= 25")
    out = ranked.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("m.i", "m.f", "k"))).alias("l"))
    return out.select("g", F.array_join(F.transform("l", lambda x: F.concat(x["f"], F.lit(":"), x["k"])), "|").alias("people"))


@query("SELECT user_id, min(ts) AS earliest, max(ts) AS latest FROM events WHERE event_id % 10 <> 0 GROUP BY user_id")
def t14_date_range(spark, sf_dir):
    raw = F.when(F.col("event_id") % 10 == 0, "no date").when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    d = table(spark, sf_dir, "events").select("user_id", F.try_to_timestamp(raw).alias("d"))
    return d.groupBy("user_id").agg(F.min("d").alias("earliest"), F.max("d").alias("latest"))


@query()
def t15_people_in_text(spark, sf_dir):
    """People of header lines; the test has hand-made cases, as RE2 splits no quoted lists."""
    c = table(spark, sf_dir, "conversations")
    text = F.concat(F.lit('2024-10-07 14:43 | From: "Lee, Ann" <Ann@X.org> | To: bob@y.org; /o=A/ou=B/cn=Recipients/cn=Joe Doe | Cc: '), F.col("role"), F.lit("@z.org\n"), "text")
    return c.select("conv_id", "turn", F.to_json(people.people_in_text(text)).alias("people"))


@query()
def t16_quoted_spans(spark, sf_dir):
    """Quoted spans by document; offsets of patterns are found in Python only."""
    d = table(spark, sf_dir, "documents")

    def spans(batches):
        for pdf in batches:
            pdf["spans"] = [",".join(f"{s}-{e}" for s, e in chunking.quoted_spans("FYI\n> a\n\n> b\n" + t + "\n--\nme")) for t in pdf["text"].fillna("")]
            yield pdf[["doc_id", "spans"]]

    return d.select("doc_id", "text").mapInPandas(spans, "doc_id long, spans string")


@query()
def w10_embedded(spark, sf_dir):
    """Embeddings by the deterministic embedder; a model's output has no SQL."""
    out = embedding.embedded(table(spark, sf_dir, "documents"), "doc_id", "text")
    return out.select("doc_id", F.size("embedding").alias("dim"), "status")


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'old' WHEN doc_id % 4 = 1 THEN 'skipped' WHEN doc_id % 4 = 2 OR trim(text) <> '' THEN 'embedded' END AS status FROM documents")
def w11_backfill(spark, sf_dir):
    k = F.col("doc_id") % 4
    old = table(spark, sf_dir, "documents").select("doc_id", "text", F.when(k == 0, F.array(F.lit(1.0).cast("float"))).alias("embedding"), F.when(k == 0, "old").when(k == 1, "skipped").alias("status"))
    return embedding.backfill(old, "doc_id", "text", embedding.lengths).select("doc_id", "status")


@query()
def v06_approximate_nearest(spark, sf_dir):
    """The ten nearest of every 20th id by an index of proximity graphs, built here below the shared folder; no SQL, as the
    index is approximate. Tests hold its recall on the given vectors and on clustered ones against the exact search."""
    e = table(spark, sf_dir, "embeddings")
    path = new_path(spark, "vectors")
    vector.build_index(e, path, 64)
    return vector.search_index(e.where("vec_id % 20 = 0"), path, 10, 64).select("query_id", "rank", "id", F.round("similarity", 6).alias("similarity"))


_COSINE = "list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))"


@query(
    f"""WITH p AS (SELECT q.vec_id AS query_id, {_COSINE} AS similarity FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, round(max(similarity), 4) AS nearest, count(*) AS n FROM p GROUP BY query_id"""
)
def v06_exact_nearest(spark, sf_dir):
    """The exact way beside the index: the nearest of every 20th id, and how many vectors were held against it."""
    e = table(spark, sf_dir, "embeddings")
    found = vector.exact(e.where("vec_id % 20 = 0"), e, 1, 64)
    return found.select("query_id", F.round("similarity", 4).alias("nearest"), F.col("held").alias("n"))


@query()
def k11_extraction_windows(spark, sf_dir):
    """Windows of 2,000 characters that end at the last line end behind their middle; each begins 200 characters before the
    end of the one before it. No SQL, as each depends on the one before; a test holds them against these rules."""
    d = small_batches(table(spark, sf_dir, "documents").select("doc_id", "text").where("text is not null"))

    def cut(batches, size=2000, overlap=200):
        import pandas as pd

        for pdf in batches:
            out = []
            for i, t in zip(pdf["doc_id"], pdf["text"], strict=True):
                at, k = 0, 0
                while at < len(t) or k == 0:
                    end = min(len(t), at + size)
                    line = t.rfind("\n", at, end) if end < len(t) else -1
                    end = line if line > at + size // 2 else end
                    out.append((i, k, at, end))
                    if end == len(t):
                        break
                    at, k = (end - overlap if end - overlap > at else end), k + 1
            yield pd.DataFrame(out, columns=["doc_id", "position", "char_start", "char_end"])

    return d.mapInPandas(cut, "doc_id long, position int, char_start int, char_end int")


@query(
    """WITH n AS (SELECT event_id, event_type AS name, user_id FROM events), e AS (SELECT DISTINCT name, 'UNKNOWN' AS kind FROM n UNION SELECT DISTINCT 'user ' || user_id, 'PERSON' FROM n)
SELECT name, kind FROM e"""
)
def g10_parsed_subgraphs(spark, sf_dir):
    """Nodes of extracted JSON graphs: those listed, and the ends of edges that no list names."""
    schema = "nodes array<struct<name:string,kind:string>>, edges array<struct<source:string,target:string>>"
    e = table(spark, sf_dir, "events")
    user = F.concat(F.lit("user "), F.col("user_id").cast("string"))
    text = F.to_json(F.struct(F.array(F.struct(user.alias("name"), F.lit("PERSON").alias("kind"))).alias("nodes"), F.array(F.struct(user.alias("source"), F.col("event_type").alias("target"))).alias("edges")))
    g = e.select(F.from_json(text, schema).alias("g"))
    listed = g.select(F.explode("g.nodes").alias("n")).select("n.name", "n.kind")
    ends = g.select(F.explode("g.edges").alias("e")).select(F.explode(F.array("e.source", "e.target")).alias("name"), F.lit(None).cast("string").alias("kind"))
    return listed.unionByName(ends).groupBy("name").agg(F.coalesce(F.max("kind"), F.lit("UNKNOWN")).alias("kind"))


@query("SELECT max_by(s_name, s_acctbal) AS entity, count(*) AS n FROM supplier WHERE contains(lower(s_name), '00001')")
def g06_best_entity(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node_id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("pagerank"))
    first = F.when(F.col("pagerank").isNotNull(), F.struct("pagerank", -F.col("node_id")))  # of equal ones the smallest key, which comes first in the table
    return graph.named(s, ["00001"]).agg(F.max_by("name", first).alias("entity"), F.count("*").alias("n"))


@query("SELECT doc_id, substr(text, greatest(1, 201 - 100), least(length(text), 300 + 100) - greatest(0, 200 - 100)) AS part FROM documents WHERE length(text) >= 300")
def x10_expanded_context(spark, sf_dir):
    """The text from 200 to 300 with 100 characters on both sides."""
    d = table(spark, sf_dir, "documents").where(F.length("text") >= 300)
    end = F.least(F.length("text"), F.lit(400))
    return d.select("doc_id", F.substring("text", F.lit(101), end - 100).alias("part"))


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def q04_conversation_text(spark, sf_dir):
    parts = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n").alias("text"))


@query("SELECT lang, source, count(*) AS n, grouping(source) AS g FROM documents GROUP BY ROLLUP (lang, source)")
def a09_rollup(spark, sf_dir):
    return table(spark, sf_dir, "documents").rollup("lang", "source").agg(F.count("*").alias("n"), F.grouping("source").cast("long").alias("g"))


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) ORDER BY n_chars, doc_id LIMIT 30 OFFSET 30")
def y09_missing_page(spark, sf_dir):
    missing = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")
    return missing.orderBy("n_chars", "doc_id").offset(30).limit(30).select("doc_id")


_FILES = """f AS (SELECT p_partkey AS file_id, p_name AS name, p_size * 1000 AS size FROM part), m AS (SELECT n_nationkey AS id, split_part(p_name, ' ', 1) AS w FROM nation JOIN part ON p_partkey = n_nationkey + 1)"""


@query(f"WITH {_FILES} SELECT id, file_id FROM m JOIN f ON list_contains(string_split(name, ' '), w) WHERE size < 25000 QUALIFY row_number() OVER (PARTITION BY id ORDER BY size DESC, file_id) <= 3")
def y18_attachments_by_mention(spark, sf_dir):
    """The three largest files of a fitting size that hold a mentioned word: joined on the words of their names."""
    p = table(spark, sf_dir, "part")
    m = table(spark, sf_dir, "nation").join(p, F.col("p_partkey") == F.col("n_nationkey") + 1).select(F.col("n_nationkey").alias("id"), F.substring_index("p_name", " ", 1).alias("w"))
    f = p.select(F.col("p_partkey").alias("file_id"), (F.col("p_size") * 1000).alias("size"), F.explode(F.array_distinct(F.split("p_name", " "))).alias("w")).where("size < 25000")
    by = Window.partitionBy("id").orderBy(F.desc("size"), "file_id")
    return m.join(f, "w").withColumn("n", F.row_number().over(by)).where("n <= 3").select("id", "file_id")


@query(
    r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text || ' ==========  x', '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '[=\-_]{10,}', ' ', 'g'), '(?m)^-{20,}\n', '', 'g')) AS text FROM documents"""
)
def y20_light_cleaning(spark, sf_dir):
    out = F.concat("text", F.lit(" ==========  x"))
    for pattern, new in ((r"[ \t]+", " "), (r"\n{3,}", "\n\n"), (r"[=\-_]{10,}", " "), (r"(?md)^-{20,}\n", "")):
        out = F.regexp_replace(out, pattern, new)
    return table(spark, sf_dir, "documents").select("doc_id", F.trim(out).alias("text"))


@query(
    """WITH t AS (SELECT conv_id, turn, role AS who, left(text, 10) AS what FROM conversations WHERE turn > 1), k AS (SELECT DISTINCT conv_id, role AS who, left(text, 10) AS what FROM conversations WHERE turn <= 1)
SELECT conv_id, turn, CASE WHEN regexp_matches(what, '^[=+@-]') THEN chr(39) || what ELSE what END AS what FROM t WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.conv_id = t.conv_id AND k.who = t.who AND k.what = t.what)"""
)
def m12_todo_append(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("who"), F.left("text", F.lit(10)).alias("what"))
    fresh = c.where("turn > 1")
    new = fresh.join(c.where("turn <= 1").select("conv_id", "who", "what").distinct(), ["conv_id", "who", "what"], "left_anti")
    return new.select("conv_id", "turn", F.when(F.rlike("what", F.lit("^[=+@-]")), F.concat(F.lit("'"), "what")).otherwise(F.col("what")).alias("what"))


@query(
    """WITH o AS (SELECT doc_id, sha256(replace(text, chr(13) || chr(10), chr(10))) AS h FROM documents WHERE doc_id % 6 <> 0), n AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE sha256(text) END AS h FROM documents)
SELECT n.doc_id, CASE WHEN o.doc_id IS NULL THEN 'created' WHEN o.h = n.h THEN 'unchanged' ELSE 'updated' END AS status FROM n LEFT JOIN o USING (doc_id)"""
)
def w09_manifest_refresh(spark, sf_dir):
    from postloom.functions.ids import content_hash

    d = table(spark, sf_dir, "documents").select("doc_id", content_hash(F.col("text")).alias("h"))
    return writes.changed(d.where("doc_id % 6 <> 0"), d.withColumn("h", F.when(F.col("doc_id") % 5 == 0, "x").otherwise(F.col("h"))), "doc_id", ["h"])
