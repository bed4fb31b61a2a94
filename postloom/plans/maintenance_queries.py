"""Queries of audit, policy, grounding and ledgers (M): events as the audit log, conversations as answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from postloom.operators import maintenance as M
from postloom.plans.registry import query, quoted, table


@query()
def m01_audit_hash(spark, sf_dir):
    """Hashes of rows as JSON; the test compares them with Python's, as the engines write numbers differently."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", M.audit_hash(F.struct("event_id", "event_type", "user_id")).alias("hash"))


@query("SELECT event_id, user_id, ts FROM events WHERE event_type = 'click' AND user_id < 50 AND ts >= TIMESTAMP '2024-01-05' ORDER BY ts DESC, event_id LIMIT 1000")
def m02_audit_trail(spark, sf_dir):
    where = (F.col("event_type") == "click") & (F.col("user_id") < 50) & (F.col("ts") >= F.lit("2024-01-05").cast("timestamp"))
    return M.audit_trail(table(spark, sf_dir, "events"), where, 5000).select("event_id", "user_id", "ts")


@query(
    """SELECT count(*) FILTER (WHERE ts < TIMESTAMP '2024-02-01' - INTERVAL 20 DAY) AS expired, count(*) FILTER (WHERE event_type = 'view' AND ts < TIMESTAMP '2024-02-01' - INTERVAL 1 HOUR) AS stuck FROM events"""
)
def m03_retention(spark, sf_dir):
    now = F.lit("2024-02-01").cast("timestamp")
    return table(spark, sf_dir, "events").agg(
        F.count_if(F.col("ts") < now - F.expr("interval 20 days")).alias("expired"), F.count_if((F.col("event_type") == "view") & (F.col("ts") < now - F.expr("interval 1 hour"))).alias("stuck")
    )


@query("SELECT doc_id FROM documents WHERE NOT (contains(lower(text), 'license') OR contains(lower(text), 'aaaa'))")
def m04_clutter(spark, sf_dir):
    hit = F.contains(F.lower("text"), F.lit("license")) | F.contains(F.lower("text"), F.lit("aaaa"))
    return table(spark, sf_dir, "documents").where(~hit).select("doc_id")


_TABLES = ["documents", "embeddings", "pages", "conversations", "events", "labels", "benchmark"]


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in _TABLES))
def m05_table_counts(spark, sf_dir):
    parts = [table(spark, sf_dir, t).agg(F.lit(t).alias("name"), F.count("*").alias("n")) for t in _TABLES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("SELECT d.lang, count(*) AS n, count(l.doc_id) AS n_labelled, round(100.0 * count(l.doc_id) / count(*), 4) AS share FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.lang")
def m06_coverage(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("has")), "doc_id", "left")
    return d.groupBy("lang").agg(F.count("*").alias("n"), F.count("has").alias("n_labelled"), F.round(F.lit(100.0) * F.count("has") / F.count("*"), 4).alias("share"))


@query("SELECT lang, n, 250 AS expected, abs(n - 250) <= 2.5 AS ok FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)")
def m07_expected_counts(spark, sf_dir):
    n = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return M.within_tolerance(n, n.select("lang", F.lit(250).alias("expected")), "lang")


_ACTIONS = ["search", "send_email", "draft_email", "delete_thread", "other"]
_CONTENT = ["all fine", "the password is x", "ssn 078-05-1120", "4111 1111 1111 1111", "keep this private"]


@query(
    f"""WITH e AS (SELECT event_id, [{", ".join(map(quoted, _ACTIONS))}][event_id % 5 + 1] AS action, [{", ".join(map(quoted, _CONTENT))}][event_id // 5 % 5 + 1] AS t,
  event_id % 13 AS n, CASE WHEN event_id % 4 = 0 THEN 'run.EXE' ELSE 'a.pdf' END AS f, event_id % 9 * 4000000 AS size, event_id % 17 = 0 AS admin FROM events),
v AS (SELECT *, CASE WHEN action = 'search' THEN 'low' WHEN action IN ('send_email', 'delete_thread') THEN 'high' ELSE 'medium' END AS risk,
  list_filter([CASE WHEN n > 10 THEN 'recipient_count' WHEN n > 5 THEN 'external_recipients' END,
    CASE WHEN {" OR ".join(f"regexp_matches(t, {quoted(p)})" for p in M.SENSITIVE)} THEN 'sensitive_content' END,
    CASE WHEN ends_with(lower(f), '.exe') THEN 'dangerous_attachment' WHEN size > 26214400 THEN 'attachment_size' END], lambda x: x IS NOT NULL) AS broken FROM e),
d AS (SELECT *, CASE WHEN risk = 'high' THEN CASE WHEN len(broken) > 0 THEN 'deny' ELSE 'require_approval' END WHEN risk = 'medium' AND len(broken) > 0 THEN 'require_approval' ELSE 'allow' END AS base FROM v)
SELECT event_id, risk, array_to_string(broken, ',') AS broken, CASE WHEN admin AND base <> 'deny' THEN 'allow' ELSE base END AS decision FROM d"""
)
def m08_policy(spark, sf_dir):
    i = F.col("event_id")
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at % 5 + 1).cast("int"))
    n = (i % 13).cast("int")
    host = F.when(n > 5, "@else.org").otherwise("@mail.internal.company.com")
    recipients = F.transform(F.array_repeat(F.lit("a"), n), lambda a: F.concat(a, host))
    e = table(spark, sf_dir, "events").select(
        "event_id", M.risk(pick(_ACTIONS, i)).alias("risk"), M.violations(recipients, pick(_CONTENT, F.floor(i / 5)), F.array(F.when(i % 4 == 0, "run.EXE").otherwise("a.pdf")), i % 9 * 4_000_000).alias("v"), (i % 17 == 0).alias("admin")
    )
    return e.select("event_id", "risk", F.array_join("v", ",").alias("broken"), M.decision(F.col("risk"), F.col("v"), F.col("admin")).alias("decision"))


@query(
    """WITH i AS (SELECT conv_id, turn, unnest([text[1:20], role, upper(role)]) AS item, unnest([0, 1, 2]) AS k FROM conversations),
f AS (SELECT * FROM i WHERE trim(item) <> '' QUALIFY row_number() OVER (PARTITION BY conv_id, lower(trim(item)) ORDER BY turn, k) = 1)
SELECT conv_id, string_agg(item, '|' ORDER BY turn, k) AS items FROM f GROUP BY conv_id"""
)
def m09_merge_ledgers(spark, sf_dir):
    parts = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array(F.left("text", F.lit(20)), F.col("role"), F.upper("role")).alias("asks"))
    return M.merge_ledgers(parts, "conv_id", "asks", "turn").select("conv_id", F.array_join("items", "|").alias("items"))


@query(
    """WITH k AS (SELECT c_name AS name, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment || c_custkey || '@x.org' END AS email, CASE WHEN c_custkey % 2 = 0 THEN 'client' ELSE 'broker' END AS role FROM customer WHERE c_custkey % 5 <> 0),
f AS (SELECT upper(c_name) AS name, CASE WHEN c_custkey % 4 = 0 THEN lower(c_mktsegment || c_custkey || '@X.org') END AS email, 'unknown' AS role FROM customer)
SELECT f.name, coalesce(m.email, f.email, n.email) AS email, coalesce(m.role, n.role, f.role) AS role FROM f LEFT JOIN k m ON lower(m.email) = lower(f.email) LEFT JOIN k n ON lower(n.name) = lower(f.name)"""
)
def m11_overlay(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    mail = F.concat("c_mktsegment", F.col("c_custkey").cast("string"), F.lit("@x.org"))
    known = c.where("c_custkey % 5 <> 0").select(F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 3 > 0, mail).alias("email"), F.when(F.col("c_custkey") % 2 == 0, "client").otherwise("broker").alias("role"))
    found = c.select(F.upper("c_name").alias("name"), F.when(F.col("c_custkey") % 4 == 0, F.lower(mail)).alias("email"), F.lit("unknown").alias("role"))
    return M.overlay(found, known)


@query()
def m13_claims(spark, sf_dir):
    """Claims of answers; no SQL, as sentences are split behind a mark and RE2 has no look-behind."""
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return c.select("conv_id", "turn", F.array_join(M.claims(F.col("text")), "|").alias("claims"))


_W = "list_filter(list_distinct(string_split_regex(lower({}), '[^\\p{{L}}\\p{{N}}_]+')), lambda w: w <> '' AND w NOT IN (" + ", ".join(map(quoted, M.CLAIM_STOP_WORDS)) + "))"


@query(
    f"""WITH c AS (SELECT conv_id * 1000 + turn AS claim_id, {_W.format("text")} AS w FROM conversations WHERE role = 'assistant'), f AS (SELECT item_id AS fact_id, {_W.format("text")} AS w FROM benchmark),
p AS (SELECT claim_id, fact_id, round(len(list_intersect(c.w, f.w)) / (len(c.w) + len(f.w) - len(list_intersect(c.w, f.w))), 6) AS score FROM c, f WHERE len(list_intersect(c.w, f.w)) > 0),
b AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY score DESC, fact_id) = 1)
SELECT c.claim_id, CASE WHEN b.score >= 0.3 THEN b.score ELSE 0.0 END AS score, CASE WHEN b.score >= 0.3 THEN b.fact_id END AS fact_id, coalesce(b.score, 0) >= 0.3 AS supported FROM c LEFT JOIN b USING (claim_id)"""
)
def m14_keyword_support(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("claim_id"), F.col("text").alias("claim"))
    return M.keyword_support(c, table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("fact_id"), F.col("text").alias("fact")))


@query(
    """WITH s AS (SELECT label, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = 0) AS DOUBLE[])) >= 0.0 AS supported FROM embeddings)
SELECT label, round(count(*) FILTER (WHERE supported) / count(*), 6) AS ratio, round(count(*) FILTER (WHERE supported) / count(*), 6) >= 0.7 AS grounded FROM s GROUP BY label"""
)
def m15_grounded(spark, sf_dir):
    from postloom.functions.vectors import cosine

    e = table(spark, sf_dir, "embeddings")
    rows = e.where("vec_id = 0").select("embedding").take(1)
    q = F.array(*(F.lit(float(x)) for x in (rows[0][0] if rows else [])))
    return M.grounded(e.select("label", (cosine(F.col("embedding"), q) >= 0.0).alias("supported")), "label")


@query("SELECT len(embedding) AS dim, count(*) AS n, count(*) = (SELECT count(*) FROM embeddings) AS all_same FROM embeddings GROUP BY 1")
def m16_index_consistency(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    total = e.agg(F.count("*").alias("total"))  # one row
    return e.groupBy(F.size("embedding").cast("long").alias("dim")).agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("dim", "n", (F.col("n") == F.col("total")).alias("all_same"))


@query(
    """WITH a AS (SELECT conv_id, list(text ORDER BY turn) AS l FROM conversations WHERE turn % 2 = 0 GROUP BY conv_id), b AS (SELECT conv_id, list('  ' || text ORDER BY turn) AS l FROM conversations GROUP BY conv_id),
j AS (SELECT conv_id, coalesce(a.l, []) AS x, coalesce(b.l, []) AS y FROM a FULL JOIN b USING (conv_id))
SELECT conv_id, array_to_string(list_concat(x, list_filter(y, lambda v: NOT list_contains(list_transform(x, lambda u: lower(trim(u))), lower(trim(v)))))[1:5], '|') AS facts FROM j"""
)
def m10_united(spark, sf_dir):
    """Two analyses of each conversation united, five facts at most."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    listed = lambda rows, text: rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", text.alias("t")))).alias("l")).select("conv_id", F.transform("l", lambda x: x["t"]).alias("facts"))
    out = M.united(listed(c.where("turn % 2 = 0"), F.col("text")), listed(c, F.concat(F.lit("  "), "text")), "conv_id", {"facts": 5})
    return out.select("conv_id", F.array_join("facts", "|").alias("facts"))
