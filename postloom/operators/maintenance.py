"""Audit, policy, grounding and ledger rules over tables of events, messages and facts."""

from __future__ import annotations

from collections.abc import Sequence

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---- fixed values: action risks, content rules and grounding word lists ----
LOW_RISK = "search read_thread read_message get_thread_context summarize_thread answer_question".split()
HIGH_RISK = "send_email delete_message delete_thread delete_attachment admin_action export_data bulk_operation".split()
EXTERNAL = r"(?i)@(?!(?:[A-Z0-9-]+\.)*internal\.company\.com(?=$|[^A-Z0-9.-]))[A-Z0-9.-]+(?=$|[^A-Z0-9.-])"
SENSITIVE = [
    r"(?i)\b(?:confidential|secret|private|internal only)\b",
    r"(?i)\b(?:password|credential|api.?key|token)\b",
    r"\b\d{3}[- ]?\d{2}[- ]?\d{4}\b",
    r"\b(?:(?:\d{4}[- ]?){3}\d{4}|\d{13,19})\b",
]
DANGEROUS = [".exe", ".bat", ".cmd", ".ps1", ".vbs", ".js"]
MOST_RECIPIENTS, MOST_ATTACHED = 10, 25 * 1024 * 1024
CLAIM_LEAST, KEYWORD_LEAST, VECTOR_LEAST, GROUNDED_LEAST = 15, 0.3, 0.75, 0.7
QUESTION_STARTS = r"(?i)^(?:who|what|where|when|why|how|is |are |do |does )"
HEDGES = r"(?i)\b(?:might|could|possibly|perhaps|maybe|probably|likely|seems?|appears?|i think|i believe|it's possible)\b"
META = r"(?i)(?:based on the context|according to the provided|from the information|i found that|the sources indicate)"
CLAIM_STOP_WORDS = (
    "a an the and or but if of to in on at by for with from as is are was were be been being it its this that these those he "
    "she they we you i his her their our your not no do does did has have had will would can could should may might"
).split()
# ---- end of fixed values ----


def audit_hash(payload: Column) -> Column:
    """SHA-256 of a struct as JSON; the caller names the fields in their fixed order."""
    return F.sha2(F.to_json(payload), 256)


def audit_trail(events: DataFrame, where: Column, limit: int) -> DataFrame:
    """The newest events that pass, 1 to 1000 of them."""
    return events.where(where).orderBy(F.desc("ts"), "event_id").limit(max(1, min(1000, limit)))


def risk(action: Column) -> Column:
    """low, medium or high; an action that is not known is medium."""
    return F.when(action.isin(LOW_RISK), "low").when(action.isin(HIGH_RISK), "high").otherwise("medium")


def violations(recipients: Column, text: Column, filenames: Column, total_size: Column) -> Column:
    """The kinds of rules that an action breaks: recipients, content, attachments, one each at most."""
    sensitive = reduce(lambda a, b: a | b, (F.rlike(text, F.lit(p)) for p in SENSITIVE))
    dangerous = F.exists(filenames, lambda f: reduce(lambda a, b: a | b, (F.endswith(F.lower(f), F.lit(e)) for e in DANGEROUS)))
    who = F.when(F.size(recipients) > MOST_RECIPIENTS, "recipient_count").when(F.exists(recipients, lambda r: F.rlike(r, F.lit(EXTERNAL))), "external_recipients")
    what = F.when(sensitive, "sensitive_content")
    how = F.when(dangerous, "dangerous_attachment").when(total_size > MOST_ATTACHED, "attachment_size")
    return F.array_compact(F.array(who, what, how))


def decision(risk_level: Column, broken: Column, admin: Column) -> Column:
    """allow, require_approval or deny; an administrator passes what is not denied."""
    some = F.size(broken) > 0
    base = F.when(risk_level == "high", F.when(some, "deny").otherwise("require_approval")).when((risk_level == "medium") & some, "require_approval").otherwise("allow")
    return F.when(admin & (base != "deny"), "allow").otherwise(base)


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.trim(text), r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def claims(text: Column) -> Column:
    """The sentences that state something: long enough, no question, hedge or talk of the answer itself."""
    bare = lambda s: F.regexp_replace(s, r"[ .!?]+$", "")
    said = F.filter(sentences(text), lambda s: ~F.endswith(s, F.lit("?")))
    ok = lambda s: (F.length(s) >= CLAIM_LEAST) & ~F.rlike(s, F.lit(QUESTION_STARTS)) & ~F.rlike(s, F.lit(HEDGES)) & ~F.rlike(s, F.lit(META))
    return F.filter(F.transform(said, bare), ok)


def claim_words(text: Column) -> Column:
    words = F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: w != ""))
    return F.array_except(words, F.array(*map(F.lit, CLAIM_STOP_WORDS)))


def keyword_support(claims_: DataFrame, facts: DataFrame) -> DataFrame:
    """Rows (claim_id, score, fact_id, supported): each claim's best fact by shared words over all words, if it reaches
    KEYWORD_LEAST; score 0 and no fact otherwise. Two sets whose share is that high have a word in common among the first
    n - ceil(share * n) + 1 of each, rarest first; so only those words meet, and a word in very many facts is one of
    them only where a set has no other. Equal sets are compared once; words travel with a digest of a claim's set, not
    with the set, which would cost the square of its size."""
    words = F.array_sort(claim_words(F.col("claim")))
    c = claims_.select("claim_id", words.alias("w")).select("claim_id", "w", F.sha2(F.array_join("w", " "), 256).alias("claim"))
    f = facts.select("fact_id", claim_words(F.col("fact")).alias("w"))
    sets = f.groupBy(F.array_sort("w").alias("w")).agg(F.min("fact_id").alias("fact_id"))
    asked = c.where("size(w) > 0").groupBy("claim").agg(F.first("w").alias("w"))
    count = sets.select(F.explode("w").alias("word")).groupBy("word").agg(F.count("*").alias("seen"))

    def first(rows: DataFrame, key: list[str]) -> DataFrame:
        words = rows.select(*key, F.explode("w").alias("word"), F.size("w").alias("n")).join(count, "word")  # a word of no fact meets nothing
        placed = words.groupBy(*key, "n").agg(F.array_sort(F.collect_list(F.struct("seen", "word"))).alias("s"))
        keep = (F.col("n") - F.ceil(F.col("n") * KEYWORD_LEAST - 1e-9) + 1).cast("int")
        return placed.select(*key, F.explode(F.transform(F.slice("s", 1, keep), lambda x: x["word"])).alias("word"))

    near = first(asked, ["claim"]).join(first(sets, ["fact_id"]), "word").select("claim", "fact_id").distinct()
    pairs = near.join(sets, "fact_id").join(asked.withColumnRenamed("w", "wc"), "claim").withColumn("n", F.size(F.array_intersect("wc", "w")))
    scored = pairs.withColumn("score", F.round(F.col("n") / (F.size("wc") + F.size("w") - F.col("n")), 6)).where(F.col("score") >= KEYWORD_LEAST)
    best = scored.groupBy("claim").agg(F.max("score").alias("score"), F.max_by("fact_id", F.struct("score", -F.col("fact_id"))).alias("fact_id"))
    out = c.select("claim_id", "claim").join(best, "claim", "left")
    return out.select("claim_id", F.coalesce("score", F.lit(0.0)).alias("score"), "fact_id", F.col("fact_id").isNotNull().alias("supported"))


def grounded(support: DataFrame, group: str) -> DataFrame:
    """Rows (group, ratio, grounded) of claims (group, supported)."""
    ratio = F.round(F.count_if("supported") / F.count("*"), 6)
    return support.groupBy(group).agg(ratio.alias("ratio")).withColumn("grounded", F.col("ratio") >= GROUNDED_LEAST)


def merge_ledgers(parts: DataFrame, group: str, field: str, order: str) -> DataFrame:
    """Rows (group, items) of a ledger's list field over several parts: each item once but for case, in order."""
    items = parts.select(group, order, F.posexplode(field).alias("at", "item")).where("trim(item) <> ''")
    by = Window.partitionBy(group, F.lower(F.trim("item"))).orderBy(order, "at")
    first = items.withColumn("_n", F.row_number().over(by)).where("_n = 1")
    listed = first.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(order, "at", "item"))).alias("l"))
    return listed.select(group, F.transform("l", lambda x: x["item"]).alias("items"))


def united(first: DataFrame, second: DataFrame, group: str, caps: dict[str, int], keys: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Rows (group, a list for each field of caps) of two analyses: the first one's items, then those of the second that it
    does not have, but for case and outer space, up to the field's cap. Items are strings, or structs told apart by the
    fields in keys. A group that only one has keeps what that has."""
    both = first.alias("a").join(second.alias("b"), group, "full_outer")

    def own(name: str):
        parts = (keys or {}).get(name)
        norm = lambda v: F.lower(F.trim(F.coalesce(v, F.lit(""))))
        return (lambda x: F.concat_ws("\0", *(norm(x[p]) for p in parts))) if parts else norm

    def field(name: str, cap: int) -> Column:
        key, a, b = own(name), F.col(f"a.{name}"), F.col(f"b.{name}")
        held = F.transform(F.coalesce(a, F.slice(b, 1, 0)), key)
        fresh = F.filter(F.coalesce(b, F.slice(a, 1, 0)), lambda x: ~F.array_contains(held, key(x)))
        return F.slice(F.concat(F.coalesce(a, F.slice(b, 1, 0)), fresh), 1, cap).alias(name)

    return both.select(group, *(field(n, c) for n, c in caps.items()))


def overlay(found: DataFrame, known: DataFrame) -> DataFrame:
    """People (name, email, role) with role and e-mail from those known, by e-mail and then by name."""
    mail = known.where("email is not null").select(F.lower("email").alias("m"), F.col("role").alias("role_m"), F.col("email").alias("email_m")).dropDuplicates(["m"])
    name = known.where("name is not null").groupBy(F.lower("name").alias("n")).agg(F.min("role").alias("role_n"), F.min("email").alias("email_n"))
    out = found.join(mail, F.lower(found["email"]) == mail["m"], "left").join(name, F.lower(found["name"]) == name["n"], "left")
    return out.select("name", F.coalesce("email_m", "email", "email_n").alias("email"), F.coalesce("role_m", "role_n", "role").alias("role"))


def within_tolerance(actual: DataFrame, expected: DataFrame, key: str, share: float = 0.01) -> DataFrame:
    """Rows (key, n, expected, ok) of counts against those expected."""
    both = expected.join(actual, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return both.select(key, "n", "expected", (F.abs(F.col("n") - F.col("expected")) <= F.col("expected") * share).alias("ok"))
