"""Personal data and prompt-injection rules as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: detection patterns in order of priority, and what stands for each kind ----
PII_PATTERNS = [
    ("EMAIL_ADDRESS", r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"),
    ("PHONE_NUMBER", r"(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"),
    ("US_SSN", r"\b\d{3}[-\s]?\d{2}[-\s]?\d{4}\b"),
    ("CREDIT_CARD", r"\b(?:4\d{12}(?:\d{3})?|5[1-5]\d{14}|3[47]\d{13}|6(?:011|5\d{2})\d{12})\b"),
    ("IP_ADDRESS", r"\b(?:\d{1,3}\.){3}\d{1,3}\b"),
]
BLOCKLIST = [
    r"ignore previous instructions",
    r"ignore all instructions",
    r"forget all previous instructions",
    r"you are now (?:a|an|in) [\s\S]*",
    r"roleplay as",
    r"system override",
    r"developer mode",
    r"god mode",
    r"jailbreak",
    r"dan mode",
    r"ignore your previous instructions",
    r"new rule:",
    r"important instruction:",
    r"ignore all prior instructions",
    r"disregard previous directions",
    r"start a new conversation",
    r"act as a",
    r"simulate a",
    r"your new persona is",
    r"i\s*g\s*n\s*o\s*r\s*e",
    r"from now on, you are",
    r"you will now act as",
    r"what if someone said",
    r"(?:print|output) the following (?:system|developer)? ?(?:prompt|instructions)",
]
HOMOGLYPHS = ("аеорсхуі", "aeopcxyi")  # Cyrillic letters and what they look like
SUSPICIOUS = "ignore instruction instructions override jailbreak system developer prompt persona roleplay".split()
SUSPICIOUS_PAIRS = [("ignore", ["instruction", "instructions"]), ("system", ["prompt", "instructions"]), ("developer", ["prompt", "instructions"])]
INJECTION_WORDS = (
    "new ignore disregard override forget instruction system prompt chatgpt pretend eval exec import subprocess os sys "
    "__import__ developer jailbreak debug admin god dan mode reveal print show your context user human assistant base64 "
    "decode atob stop end above"
).split()
INJECTION_PATTERNS = [
    r"(?i)ignore\s*previous",
    r"(?i)disregard\s*earlier",
    r"(?i)new\s*instructions[:\s]",
    r"(?i)system\s*prompt[:\s]",
    r"(?i)run\s*code[:\s]",
    r"(?s)\{\{.*\}\}",
    r"(?s)\$\{[^}]+\}",
    r"(?i)<\s*script\s*>",
    r"<!--",
]
INJECTION_PAIRS = [("ignore", "instruction"), ("system", "prompt")]
ROLE_LINE = r"^\s*(?:system|assistant|user|human|instruction)\s*:"
ROLE_TAGS = "system user assistant instruction prompt context tool".split()
JAILBREAKS = [r"ignore all previous instructions", r"you are now in.*mode", r"act as if you are", r"your new instructions are"]
INPUT_MOST = 2048
LINE_PATTERNS = [
    "ignore previous instruction",
    "disregard earlier instruction",
    "override these rules",
    "forget all previous",
    "disregard all prior",
    "new instructions:",
    "updated instructions:",
    "system prompt:",
    "system:",
    "assistant:",
    "### instruction",
    "### system",
    "you are chatgpt",
    "you are now",
    "act as",
    "pretend you are",
    "as an ai language model",
    "as a large language model",
    "run code:",
    "execute:",
    "eval(",
    "exec(",
    "import os",
    "import sys",
    "subprocess",
    "__import__",
    "developer mode",
    "jailbreak",
    "debug mode",
    "admin mode",
    "god mode",
    "dan mode",
    "show me your prompt",
    "what are your instructions",
    "reveal your system prompt",
    "print your instructions",
    "{{",
    "${",
    "<!--",
    "<script",
    "javascript:",
    "user:",
    "human:",
    "base64",
    "decode(",
    "atob(",
    "stop output",
    "end instructions",
    "ignore above",
]
LINE_STARTS = ["system:", "assistant:", "user:", "instruction:", "### instruction", "```"]
EMAIL_FORMAT = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"
# ---- end of fixed values ----


def pii_counts(text: Column) -> Column:
    """How often each kind's pattern is found, as a struct."""
    return F.struct(*(F.regexp_count(text, F.lit(p)).alias(k) for k, p in PII_PATTERNS))


def redact_pii(text: Column) -> Column:
    """Each find replaced by its kind; of overlapping kinds the one of higher priority counts, as it is replaced first."""
    return reduce(lambda c, kp: F.regexp_replace(c, kp[1], f"<<{kp[0]}>>"), PII_PATTERNS, text)


SPAN = "struct<kind:string,start:int,end:int>"


def pattern_spans(text: Column, kind: str, pattern: str) -> Column:
    """Where a pattern is found, as an array of (kind, start, end), from 0 and end exclusive: what stands between the finds
    gives their places."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    lengths = F.transform(F.arrays_zip(found.alias("f"), between.alias("b")), lambda x: F.struct(F.length(x["b"]).alias("b"), F.coalesce(F.length(x["f"]), F.lit(0)).alias("f")))
    none = F.array().cast(f"array<{SPAN}>")

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["b"]
        one = F.array(F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + x["f"]).alias("end")))
        return F.struct((start + x["f"]).alias("at"), F.when(x["f"] > 0, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(lengths, F.struct(F.lit(0).alias("at"), none.alias("out")), add, lambda acc: acc["out"])


def merged_spans(*lists: Column) -> Column:
    """The spans of several detectors, first ones first: a span that overlaps one taken before it is left out. By start."""
    none = F.array().cast(f"array<{SPAN}>")
    every = F.concat(*(F.coalesce(x, none) for x in lists))
    kept = F.aggregate(every, none, lambda acc, x: F.when(F.exists(acc, lambda y: (x["start"] < y["end"]) & (x["end"] > y["start"])), acc).otherwise(F.concat(acc, F.array(x))))
    return F.array_sort(kept, lambda x, y: x["start"] - y["start"])


def redact_spans(text: Column, spans: Column) -> Column:
    """text with spans (by start, apart) replaced by their kinds."""

    def add(acc: Column, x: Column) -> Column:
        piece = F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit("<<"), x["kind"], F.lit(">>"))
        return F.struct(x["end"].alias("at"), piece.alias("out"))

    return F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), add, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def scrubbed_lines(text: Column) -> Column:
    """The older scrubber: without lines that hold a known pattern or start like a role."""
    low = lambda x: F.lower(F.trim(x))

    def bad(x: Column) -> Column:
        held = reduce(lambda a, b: a | b, (F.contains(low(x), F.lit(p)) for p in LINE_PATTERNS))
        return (low(x) != "") & (held | reduce(lambda a, b: a | b, (F.startswith(low(x), F.lit(p)) for p in LINE_STARTS)))

    return F.array_join(F.filter(F.split(text, "\r?\n"), lambda x: ~bad(x)), "\n")


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def contains_injection(text: Column) -> Column:
    """A blocklist and a keyword rule, after letters that only look Latin are made so."""
    plain = F.translate(text, *HOMOGLYPHS)
    words = F.array_distinct(F.split(F.lower(plain), "[^a-z]+"))
    hits = F.array_intersect(words, F.array(*map(F.lit, SUSPICIOUS)))
    pairs = [F.array_contains(hits, a) & F.arrays_overlap(hits, F.array(*map(F.lit, b))) for a, b in SUSPICIOUS_PAIRS]
    found = F.rlike(plain, F.lit("(?i)(?:" + "|".join(BLOCKLIST) + ")")) | _any(pairs) | (F.size(hits) >= 3)
    return F.when(F.trim(text) == "", F.lit(False)).otherwise(found)


def is_prompt_injection(text: Column) -> Column:
    """A keyword gate, then patterns and pairs of words."""
    low = F.lower(text)
    words = F.split(low, r"\W+")
    pairs = [F.array_contains(words, a) & F.array_contains(words, b) for a, b in INJECTION_PAIRS]
    return F.arrays_overlap(words, F.array(*map(F.lit, INJECTION_WORDS))) & (_any([F.rlike(low, F.lit(p)) for p in INJECTION_PATTERNS]) | _any(pairs))


def sanitize_retrieved(text: Column) -> Column:
    """Without lines that look like instructions, roles or fences; empty where the rest still does."""

    def kept(line: Column) -> Column:
        low = F.lower(F.trim(line))
        return (low == "") | ~(is_prompt_injection(low) | F.rlike(low, F.lit(ROLE_LINE)) | F.startswith(low, F.lit("```")))

    block = F.array_join(F.filter(F.split(text, "\n"), kept), "\n")
    return F.when(is_prompt_injection(block), "").otherwise(block)


def sanitize_input(text: Column, most: int = INPUT_MOST) -> Column:
    """Role tags and known phrases out, then cut to length."""
    out = text
    for tag in ROLE_TAGS:
        out = F.regexp_replace(F.regexp_replace(out, rf"(?is)<{tag}(?:\s[^>]*)?>.*?</{tag}>", ""), rf"(?is)<{tag}(?:\s[^>]*)?/>", "")
    for phrase in JAILBREAKS:
        out = F.regexp_replace(out, "(?i)" + phrase, "")
    return F.left(out, F.lit(max(0, most)))


def is_email(text: Column) -> Column:
    return F.rlike(text, F.lit(EMAIL_FORMAT))
