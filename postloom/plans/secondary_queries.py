"""Queries of secondary operators (Y) and of folded sources (S-12, S-21): conversations as threads, documents as files."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from postloom.functions import people
from postloom.functions import text as T
from postloom.operators import ranking
from postloom.plans.registry import query, table


@query(
    """WITH b AS (SELECT source, doc_id, text, coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents)
SELECT doc_id, '--- ATTACHMENT: ' || doc_id || ' ---' || chr(10) || left(text, CAST(least(length(text), 20000 - before) AS BIGINT)) AS part FROM b WHERE before < 20000 AND length(text) > 0"""
)
def s12_attachment_budget(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "doc_id", "text")
    kept = ranking.within_budget(d, F.length("text").cast("long"), 20000, ["doc_id"], ["source"])
    part = F.concat(F.lit("--- ATTACHMENT: "), F.col("doc_id").cast("string"), F.lit(" ---\n"), F.left("text", F.col("room").cast("int")))
    return kept.select("doc_id", part.alias("part"))


@query("SELECT doc_id, coalesce(nullif(trim(CASE WHEN doc_id % 3 = 0 THEN '  ' ELSE text END), ''), nullif(trim(source), ''), 'file') AS text FROM documents")
def y21_text_materialised(spark, sf_dir):
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    text = F.when(F.col("doc_id") % 3 == 0, "  ").otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(filled(text), filled(F.col("source")), F.lit("file")).alias("text"))


@query(
    r"""SELECT doc_id, regexp_replace(array_to_string(list_transform(list_filter(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), lambda l: NOT contains(lower(l), 'license')), lambda l: trim(regexp_replace(l, '[ \t]+', ' ', 'g'))), chr(10)), '\n{3,}', chr(10) || chr(10), 'g') AS text FROM documents"""
)
def y01_clean_conversation(spark, sf_dir):
    lines = F.filter(F.split(F.regexp_replace("text", "\r\n", "\n"), "\n"), lambda x: ~F.contains(F.lower(x), F.lit("license")))
    body = F.array_join(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"[ \t]+", " "))), "\n")
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(body, r"\n{3,}", "\n\n").alias("text"))


@query(
    """WITH l AS (SELECT doc_id, i, x[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
m AS (SELECT *, trim(line) = '' OR starts_with(trim(line), '-') AS alone FROM l),
g AS (SELECT *, sum(CASE WHEN alone OR coalesce(lag_alone, true) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM (SELECT *, lag(alone) OVER (PARTITION BY doc_id ORDER BY i) AS lag_alone FROM m))
SELECT doc_id, island, string_agg(line, ' ' ORDER BY i) AS paragraph FROM g GROUP BY doc_id, island"""
)
def y02_paragraphs(spark, sf_dir):
    """Wrapped lines as paragraphs: islands of lines between those that stand alone."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    alone = (F.trim("line") == "") | F.startswith(F.trim("line"), F.lit("-"))
    by = Window.partitionBy("doc_id").orderBy("i")
    new = F.when(F.col("alone") | F.coalesce(F.lag("alone").over(by), F.lit(True)), 1).otherwise(0)
    islands = lines.withColumn("alone", alone).withColumn("new", new).withColumn("island", F.sum("new").over(by))
    out = islands.groupBy("doc_id", "island").agg(F.array_sort(F.collect_list(F.struct("i", "line"))).alias("l"))
    return out.select("doc_id", "island", F.array_join(F.transform("l", lambda x: x["line"]), " ").alias("paragraph"))


@query(
    """WITH s AS (SELECT event_id, array_to_string(list_sort(json_keys(CAST(props AS JSON))), '|') AS signature FROM events)
SELECT signature, min(event_id) AS first_id, count(*) AS n FROM s GROUP BY signature ORDER BY first_id LIMIT 300"""
)
def y03_schema_variations(spark, sf_dir):
    keys = F.array_join(F.array_sort(F.json_object_keys("props")), "|")
    return table(spark, sf_dir, "events").select("event_id", keys.alias("signature")).groupBy("signature").agg(F.min("event_id").alias("first_id"), F.count("*").alias("n")).orderBy("first_id").limit(300)


@query(
    """SELECT a.doc_id, concat_ws(',', CASE WHEN a.quality IS DISTINCT FROM b.quality THEN 'quality' END, CASE WHEN a.toxic IS DISTINCT FROM b.toxic THEN 'toxic' END) AS changed
FROM labels a JOIN labels b ON b.doc_id = a.doc_id + 1"""
)
def y04_field_diff(spark, sf_dir):
    a = table(spark, sf_dir, "labels")
    b = a.select((F.col("doc_id") - 1).alias("doc_id"), F.col("quality").alias("q"), F.col("toxic").alias("t"))
    differ = F.array_compact(F.array(F.when(~F.col("quality").eqNullSafe(F.col("q")), "quality"), F.when(~F.col("toxic").eqNullSafe(F.col("t")), "toxic")))
    return a.join(b, "doc_id").select("doc_id", F.array_join(differ, ",").alias("changed"))


@query("SELECT c.conv_id, r.role FROM (SELECT DISTINCT conv_id FROM conversations) c, (SELECT DISTINCT role FROM conversations) r WHERE NOT EXISTS (SELECT 1 FROM conversations x WHERE x.conv_id = c.conv_id AND x.role = r.role)")
def y05_missing_parts(spark, sf_dir):
    """What each folder lacks of the parts that any has (few): expected less present."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "role")
    roles = c.select("role").distinct().agg(F.collect_set("role").alias("roles"))  # one row of a few kinds
    expected = c.select("conv_id").distinct().crossJoin(F.broadcast(roles)).select("conv_id", F.explode("roles").alias("role"))
    return expected.join(c.distinct(), ["conv_id", "role"], "left_anti")


@query("SELECT round(100.0 * (SELECT count(*) FROM labels) / (SELECT count(*) FROM documents), 4) AS percent")
def y06_progress(spark, sf_dir):
    n = table(spark, sf_dir, "documents").agg(F.count("*").alias("n"))
    m = table(spark, sf_dir, "labels").agg(F.count("*").alias("m"))
    return n.crossJoin(m).select(F.round(F.lit(100.0) * F.col("m") / F.col("n"), 4).alias("percent"))  # two rows


@query("SELECT conv_id, max_by(text, turn) FILTER (WHERE role <> 'assistant') AS last_inbound, left(max_by(text, turn) FILTER (WHERE role <> 'assistant'), 500) AS reply_query FROM conversations GROUP BY conv_id")
def y10_last_inbound(spark, sf_dir):
    last = F.max_by(F.when(F.col("role") != "assistant", F.col("text")), F.when(F.col("role") != "assistant", F.col("turn")))
    out = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(last.alias("last_inbound"))
    return out.select("conv_id", "last_inbound", F.left("last_inbound", F.lit(500)).alias("reply_query"))


@query(
    """WITH r AS (SELECT c_custkey, ['us@x.org', 'n' || c_nationkey || '@x.org', 'N' || c_nationkey || '@x.org', c_mktsegment || '@x.org', 'list-all@x.org'] AS cc FROM customer),
d AS (SELECT c_custkey, list_filter(cc, lambda x, i: list_position(list_transform(cc, lambda y: lower(y)), lower(x)) = i AND NOT lower(x) IN ('us@x.org', 'n3@x.org')) AS cc FROM r)
SELECT c_custkey, array_to_string(cc, ',') AS reply_all, array_to_string(list_filter(cc, lambda x: NOT contains(x, 'list'))[1:8], ',') AS smart FROM d"""
)
def y11_reply_recipients(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    nation = F.col("c_nationkey").cast("string")
    cc = F.array(F.lit("us@x.org"), F.concat(F.lit("n"), nation, F.lit("@x.org")), F.concat(F.lit("N"), nation, F.lit("@x.org")), F.concat("c_mktsegment", F.lit("@x.org")), F.lit("list-all@x.org"))
    kept = F.filter(T.distinct_by_lower(cc), lambda x: ~F.lower(x).isin("us@x.org", "n3@x.org"))
    smart = F.slice(F.filter(F.col("cc"), lambda x: ~F.contains(x, F.lit("list"))), 1, 8)
    return c.select("c_custkey", kept.alias("cc")).select("c_custkey", F.array_join("cc", ",").alias("reply_all"), F.array_join(smart, ",").alias("smart"))


@query("SELECT doc_id, CASE WHEN starts_with(lower(s), 're:') THEN s ELSE 'Re: ' || s END AS subject FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'RE: ' ELSE '' END || source AS s FROM documents)")
def y13_reply_subject(spark, sf_dir):
    s = F.concat(F.when(F.col("doc_id") % 2 == 0, "RE: ").otherwise(""), F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.startswith(F.lower(s), F.lit("re:")), s).otherwise(F.concat(F.lit("Re: "), s)).alias("subject"))


@query("SELECT conv_id, left(string_agg(text, chr(10) ORDER BY turn), 40000) AS q FROM (SELECT * FROM conversations WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 5) GROUP BY conv_id")
def y14_query_from_history(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").where("role = 'user'")
    by = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    last = t.withColumn("n", F.row_number().over(by)).where("n <= 5").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("l"))
    return last.select("conv_id", F.left(F.array_join(F.transform("l", lambda x: x["text"]), "\n"), F.lit(40000)).alias("q"))


@query(
    """WITH h AS (SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS history FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4) GROUP BY conv_id)
SELECT conv_id, history, length(history) >= 300 AS enough FROM h"""
)
def y15_history(spark, sf_dir):
    by = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    last = table(spark, sf_dir, "conversations").withColumn("n", F.row_number().over(by)).where("n <= 4")
    listed = last.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("l"))
    history = F.array_join(F.transform("l", lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n")
    return listed.select("conv_id", history.alias("history")).withColumn("enough", F.length("history") >= 300)


@query("SELECT doc_id, CAST(round(greatest(0.3, least(0.98, 0.5 + 0.05 * (n_chars % 12) - 0.2 * (doc_id % 3))), 6) AS DOUBLE) AS confidence FROM documents")
def y17_draft_confidence(spark, sf_dir):
    raw = F.lit(0.5) + F.lit(0.05) * (F.col("n_chars") % 12) - F.lit(0.2) * (F.col("doc_id") % 3)
    return table(spark, sf_dir, "documents").select("doc_id", F.round(F.greatest(F.lit(0.3), F.least(F.lit(0.98), raw)), 6).alias("confidence"))


@query("SELECT event_id, string_split(i, '::')[1] || '::' || string_split(i, '::')[2] AS prefix FROM (SELECT event_id, event_type || '::' || user_id || '::' || event_id AS i FROM events)")
def y22_id_prefix(spark, sf_dir):
    i = F.concat_ws("::", "event_type", F.col("user_id").cast("string"), F.col("event_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", F.substring_index(i, "::", 2).alias("prefix"))


@query(
    """WITH k AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 3 = 0 THEN 'm' || (event_id // 2) ELSE strftime(ts, '%Y-%m-%d %H') || event_type || user_id END AS key FROM events),
d AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts, event_id) = 1)
SELECT user_id, count(*) AS n, sha256(string_agg(CAST(event_id AS VARCHAR), '|' ORDER BY CAST(event_id AS VARCHAR))) AS signature FROM d GROUP BY user_id"""
)
def y24_message_identity(spark, sf_dir):
    own = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("m"), F.floor(F.col("event_id") / 2).cast("string")))
    key = F.coalesce(own, F.concat(F.date_format("ts", "yyyy-MM-dd HH"), "event_type", F.col("user_id").cast("string")))
    kept = ranking.best_of_each(table(spark, sf_dir, "events").withColumn("key", key).withColumn("late", -F.unix_micros(F.col("ts").cast("timestamp"))), "key", "late", ["event_id"])
    ids = F.array_sort(F.collect_list(F.col("event_id").cast("string")))
    return kept.groupBy("user_id").agg(F.count("*").alias("n"), F.sha2(F.array_join(ids, "|"), 256).alias("signature"))


@query(
    """WITH l AS (SELECT conv_id, turn, i, x[i] AS line FROM (SELECT conv_id, turn, string_split(t, chr(10)) AS x, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS i FROM
  (SELECT conv_id, turn, text || chr(10) || CASE WHEN turn % 2 = 0 THEN '-----Original Message-----' ELSE '> a' || chr(10) || 'b' || chr(10) || '> c' END || chr(10) || 'tail' AS t FROM conversations))),
q AS (SELECT *, starts_with(line, '-----Original Message') OR (starts_with(line, '>') AND sum(CASE WHEN starts_with(line, '>') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) >= 2) AS cut FROM l)
SELECT conv_id, turn, min(i) FILTER (WHERE cut) AS cut_at FROM q GROUP BY conv_id, turn"""
)
def y25_quoted_cut(spark, sf_dir):
    """The first line of a quoted block: a marker, or a quoted line with another one among the seven after it."""
    tail = F.when(F.col("turn") % 2 == 0, "-----Original Message-----").otherwise("> a\nb\n> c")
    t = F.concat("text", F.lit("\n"), tail, F.lit("\ntail"))
    lines = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split(t, "\n")).alias("i", "line"))
    by = Window.partitionBy("conv_id", "turn").orderBy("i").rowsBetween(0, 7)
    mark = F.startswith("line", F.lit(">"))
    cut = F.startswith("line", F.lit("-----Original Message")) | (mark & (F.sum(mark.cast("int")).over(by) >= 2))
    return lines.withColumn("cut", cut).groupBy("conv_id", "turn").agg(F.min(F.when(F.col("cut"), F.col("i") + 1)).cast("long").alias("cut_at"))


@query(
    """WITH m AS (SELECT conv_id, max_by(text, turn) FILTER (WHERE role <> 'assistant' AND coalesce(trim(text), '') <> '') AS body, string_agg(text, chr(10) ORDER BY turn) AS all_text FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN body IS NOT NULL THEN 'Reply to: Thread ' || conv_id || chr(10) || chr(10) || left(trim(body), 500) ELSE coalesce(nullif(trim(right(all_text, 500)), ''), 'Reply to this email thread') END AS query FROM m"""
)
def y12_reply_query(spark, sf_dir):
    """What a reply is asked for: subject and text of the last message that is not ours, else the conversation's end."""
    c = table(spark, sf_dir, "conversations")
    inbound = (F.col("role") != "assistant") & (F.coalesce(F.trim("text"), F.lit("")) != "")
    m = c.groupBy("conv_id").agg(F.max_by(F.when(inbound, F.col("text")), F.when(inbound, F.col("turn"))).alias("body"), F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("l"))
    tail = F.nullif(F.trim(F.right(F.array_join(F.transform("l", lambda x: x["text"]), "\n"), F.lit(500))), F.lit(""))
    ask = F.concat(F.lit("Reply to: Thread "), F.col("conv_id").cast("string"), F.lit("\n\n"), F.left(F.trim("body"), F.lit(500)))
    return m.select("conv_id", F.when(F.col("body").isNotNull(), ask).otherwise(F.coalesce(tail, F.lit("Reply to this email thread"))).alias("query"))


@query(
    """SELECT conv_id, count(*) FILTER (WHERE trim(coalesce(text, '')) <> '') >= 1 AND coalesce(sum(length(text)), 0) >= 300 AS ok,
  CASE WHEN count(*) FILTER (WHERE trim(coalesce(text, '')) <> '') < 1 THEN 'Insufficient context snippets' WHEN coalesce(sum(length(text)), 0) < 300 THEN 'Context too small' ELSE 'ok' END AS reason FROM conversations GROUP BY conv_id"""
)
def y16_context_quality(spark, sf_dir):
    filled = F.count_if(F.trim(F.coalesce("text", F.lit(""))) != "") >= 1
    enough = F.coalesce(F.sum(F.length("text")), F.lit(0)) >= 300
    reason = F.when(~filled, "Insufficient context snippets").when(~enough, "Context too small").otherwise("ok")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg((filled & enough).alias("ok"), reason.alias("reason"))


@query(
    """WITH c AS (SELECT conv_id, min(turn) AS at, string_agg(text, chr(10) ORDER BY turn) AS text, conv_id % 3 AS k FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN k = 1 THEN 1 ELSE 1 END AS n_people, CASE WHEN k = 1 THEN 'old@x.org' ELSE 'u' || conv_id || '@x.org' END AS first FROM c"""
)
def y07_people_backfill(spark, sf_dir):
    """People filled in from the header lines of the text where a conversation has none yet, null or empty."""
    c = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    kind = "array<struct<smtp:string,name:string,role:string>>"
    old = F.array(F.struct(F.lit("old@x.org").alias("smtp"), F.lit("Old").alias("name"), F.lit("sender").alias("role")))
    held = F.when(F.col("conv_id") % 3 == 1, old).when(F.col("conv_id") % 3 == 2, F.array().cast(kind))
    text = F.concat(F.lit("2024-10-07 14:43 | From: U <u"), F.col("conv_id").cast("string"), F.lit("@x.org>\nbody"))
    found = people.backfilled(c.select("conv_id", held.alias("participants"), text.alias("text")))
    return found.select("conv_id", F.size("participants").alias("n_people"), F.col("participants")[0]["smtp"].alias("first"))
