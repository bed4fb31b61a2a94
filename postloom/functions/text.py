"""Cleaning and parsing of message text as Column expressions. All of them run inside code generation; null gives null
unless a function says otherwise.

Patterns are written for both Java's and RE2's dialect; Java takes them with (?d), so that only \\n ends a line.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: patterns, word lists and limits of the cleaning rules ----
CONTROL_CHARS = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]"
HEADER_LINE = (
    r"^(?:\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}\s+\|\s+From:.*$"
    r"|(?:From|To|Cc|Bcc|Subject|主题|Date|Sent|Reply-To|Message-ID|In-Reply-To|References|Content-Type|MIME-Version|X-[a-z-]+):.*$)\n?"
)
FORWARD_LINE = r"^(?:-{3,}\s*(?:Original|Forwarded) Message\s*-{3,}|_{10,}|Begin forwarded message:|On .+ wrote:$)\n?"
QUOTE_MARK = r"^>+[ \t]?(.*)$"
SIGNATURES = [
    r"--\s*$",
    r"Best\s*regards?,?\s*$",
    r"Kind\s*regards?,?\s*$",
    r"Warm\s*regards?,?\s*$",
    r"Regards?,?\s*$",
    r"Sincerely,?\s*$",
    r"Thanks?,?\s*$",
    r"Thank\s*you,?\s*$",
    r"Cheers,?\s*$",
    r"Sent from my iPhone",
    r"Sent from my iPad",
    r"Sent from my Samsung",
    r"Get Outlook for",
    r"Sent from Mail for Windows",
    r"This email and any attachments",
    r"CONFIDENTIALITY NOTICE",
    r"DISCLAIMER:",
]
SIGNATURE_TAIL, SIGNATURE_LEAST = 2000, 100
BOILERPLATE = [
    "email from external sender",
    "this message, and its attachments",
    "this communication is confidential",
    "legal notice",
    "confidentiality notice",
    "please consider the environment before printing",
    "go green, avoid printing",
    "ce message, et ses éventuelles pièces jointes",
    "ce message a été classifié",
    "l'internet ne permettant pas d'assurer l'intégrité de ce message",
    "classification : interne",
    "classification : internal",
    "classification : public",
]
BOILERPLATE_LENGTH = 80
SOLE_URL = r"^(?i:https?://[^\s<>\"{}|\\^`\[\]]+)$"
SOLE_WWW = r"^www\.[A-Za-z0-9.-]+$"
SEPARATOR_RUN = r"[,\s|./\\]{2,}"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
URL = r"https?://[^\s<>\"{}|\\^`\[\]]+"
WWW = r"(?i)\bwww\.[a-z0-9.-]+\.[a-z]{2,}\b"
PUNCTUATION = [(r"\.{3,}", "..."), (r"!{2,}", "!"), (r"\?{2,}", "?"), (r"={3,}", ""), (r"-{5,}", "---"), (r"_{5,}", "")]
WHITE_SPACE = [(r"[ \t]{2,}", " "), (r"\n{3,}", "\n\n")]
SUBJECT_PREFIX = r"(?i)^(?:\s*(?:re|fwd?|aw|sv|vs|antw|odp|回复|答复|轉寄):\s*)+"
DOCUMENT_NAME = r"(?i)\b([\w\-.]+\.(?:pdf|docx?|xlsx?|pptx?|txt|csv|eml|msg|png|jpe?g|gif))\b"
QUOTED_NAME = r"[\"']([A-Za-z0-9][A-Za-z0-9\s_\-.]{2,60})[\"']"
ATTACHED_NAME = r"(?i)(?:attached|attachment|enclosed|enclosure)[:\s]+([A-Za-z0-9\s_-]+)(?:\.|,|\s|$)"
ENTITY_QUOTED = r"[\"']([^\"']{2,100})[\"']"
ENTITY_PHRASE = r"\b([A-Z][\w&-]*(?:\s+[A-Z][\w&-]*)+)\b"
ENTITY_WORD = r"\b([A-Z][a-z]{2,})\b"
ENTITY_STOP_WORDS = (
    "what when where why who how can could should would does do did is are the a an and or to from for of in on at by "
    "please tell explain find search show get about with this that these those have has had been being was were will may "
    "might must shall latest recent all policy policies claim claims email emails document documents"
).split()
DRAFTING = [
    r"\b(?:draft|write|compose|create|prepare)\s+(?:a|an)?\s*(?:email|reply|response|message)",
    r"\breply to\b",
    r"\brespond to\b",
    r"\bsend\s+(?:a|an)\s+(?:email|message)",
    r"\b(?:help me|can you)\s+(?:write|draft|reply)",
]
NAVIGATIONAL = [
    r"\b(?:from|sent by|email from)\s+[\w\.\-\+]+@[\w\.\-]+",
    r"\b(?:to|sent to|email to)\s+[\w\.\-\+]+@[\w\.\-]+",
    r"\b(?:from|by)\s+[A-Z][a-z]+\s+[A-Z][a-z]+",
    r"\b(?:subject|titled|called|named)\s*[:\"\']\s*.+[\"\']?",
    r"\bRE:\s*.+",
    r"\bFW:\s*.+",
    r"\b(?:on|from|dated)\s+(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\w+\s+\d{1,2})",
    r"\b(?:last|this)\s+(?:week|month|monday|tuesday|wednesday|thursday|friday)",
    r"\byesterday\b",
    r"\btoday\b",
    r"\b(?:find|show|get|retrieve)\s+(?:the|my|that)\s+email",
    r"\bthread\s+(?:about|regarding|with)\b",
    r"\b(?:attachment|file)\s+(?:called|named|titled)\b",
]
QUERY_FLAGS = {
    "time_sensitive": [r"\burgent\b", r"\basap\b", r"\bimmediately\b", r"\bdeadline\b", r"\bby\s+(?:today|tomorrow|monday|tuesday|wednesday|thursday|friday|end of day|eod|cob)"],
    "followup": [r"\bfollow.?up\b", r"\bprevious\b", r"\bearlier\b", r"\bcontinuing\b", r"\bregarding\s+(?:my|our|the)\s+(?:last|previous)\b"],
    "requires_grounding_check": [
        r"\b(?:policy|policies|regulation|regulations|compliance|legal)\b",
        r"\b(?:allowed|prohibited|permitted|forbidden|required)\b",
        r"\b(?:must|shall|may not|cannot)\b",
        r"\b(?:confirm|verify|validate)\s+(?:that|if|whether)\b",
    ],
}
# ---- end of fixed values ----


def any_of(patterns: list[str]) -> str:
    return "(?i)(?:" + "|".join(patterns) + ")"


SIGNATURE_ON = r"^(?:" + "|".join(SIGNATURES) + r")[\s\S]*"


def strip_control_chars(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL_CHARS, "")


def remove_header_lines(text: Column) -> Column:
    return F.regexp_replace(text, "(?imd)" + HEADER_LINE, "")


def remove_forward_lines(text: Column) -> Column:
    return F.regexp_replace(text, "(?imd)" + FORWARD_LINE, "")


def remove_quote_marks(text: Column) -> Column:
    return F.regexp_replace(text, "(?md)" + QUOTE_MARK, "$1")


def strip_signature(text: Column) -> Column:
    """Cuts a text of some length at the earliest signature in its tail; the first match of all patterns together is that."""
    tail = F.right(text, F.lit(SIGNATURE_TAIL))
    kept = F.regexp_replace(tail, "(?imd)" + SIGNATURE_ON, "")
    head = F.left(text, F.greatest(F.length(text) - SIGNATURE_TAIL, F.lit(0)))
    cut = F.regexp_replace(F.concat(head, kept), r"\s+\z", "")
    return F.when((F.length(text) >= SIGNATURE_LEAST) & (kept != tail), cut).otherwise(text)


BOILERPLATE_ANY = "|".join(re.escape(k).replace("\\ ", " ").replace("'", "\\x27") for k in BOILERPLATE)


def drop_boilerplate_lines(text: Column, own_phrases: Sequence[str] = (), own_lines: Sequence[str] = ()) -> Column:
    """Without lines that are a sole URL, a known notice, or a long run of separated address parts. An organisation's own
    notices (lower-case phrases) and noise lines (upper-case) are parameters. Each line's bare form is made once, as
    lambdas share no expressions, and cheap tests come before patterns."""
    any_phrase = BOILERPLATE_ANY + "".join("|" + re.escape(p).replace("\\ ", " ") for p in own_phrases)
    bare = F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("line"), trimmed(x).alias("bare")))

    def kept(x: Column) -> Column:
        b = x["bare"]
        parts = (F.length(b) > BOILERPLATE_LENGTH) & ~F.contains(b, F.lit("@")) & (F.regexp_count(b, F.lit(SEPARATOR_RUN)) >= 2)
        url = F.contains(b, F.lit("://")) & F.rlike(b, F.lit(SOLE_URL))
        www = F.startswith(b, F.lit("www.")) & F.rlike(b, F.lit(SOLE_WWW))
        gone = url | www | F.rlike(F.lower(b), F.lit(any_phrase)) | parts
        return (b == "") | ~(gone | F.upper(b).isin(list(own_lines)) if own_lines else gone)

    return F.array_join(F.transform(F.filter(bare, kept), lambda x: x["line"]), "\n")


def _once(value: Column, use) -> Column:
    """use(value) with value made once, however often it is used: a lambda's variable is a value."""
    return F.transform(F.array(value), use)[0]


def redact_contacts(text: Column) -> Column:
    """Addresses and links replaced; a pattern only runs over texts that hold its mark."""

    def where_marked(mark: str, pattern: str, new: str):
        return lambda t: F.when(F.contains(F.lower(t), F.lit(mark)), F.regexp_replace(t, pattern, new)).otherwise(t)

    out = text
    for mark, pattern, new in (("@", EMAIL, "[EMAIL_REDACTED]"), ("://", URL, "[URL_REDACTED]"), ("www.", WWW, "[URL_REDACTED]")):
        out = _once(out, where_marked(mark, pattern, new))
    return out


def collapse_punctuation(text: Column) -> Column:
    return reduce(lambda c, rule: F.regexp_replace(c, *rule), PUNCTUATION, text)


def collapse_white_space(text: Column) -> Column:
    return reduce(lambda c, rule: F.regexp_replace(c, *rule), WHITE_SPACE, text)


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+\z", "")


def clean_email_text(text: Column) -> Column:
    """The cleaning steps in their order: mark, headers, signature, separators, quote marks, boilerplate, contacts,
    punctuation, white space, ends. Null gives the empty text."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), "^﻿", "")
    for step in (remove_header_lines, strip_signature, remove_forward_lines, remove_quote_marks, drop_boilerplate_lines, redact_contacts, collapse_punctuation, collapse_white_space, trimmed):
        out = step(out)
    return out


def normalize_subject(subject: Column) -> Column:
    """Reply and forward prefixes off, bracketed parts out, white space collapsed, lower case."""
    out = F.regexp_replace(F.coalesce(subject, F.lit("")), SUBJECT_PREFIX, "")
    out = F.regexp_replace(F.regexp_replace(out, r"\[.*?\]", ""), r"\s+", " ")
    return F.lower(F.trim(out))


def first_filled(*columns: Column) -> Column:
    """The first column that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def html_to_text(html: Column) -> Column:
    """Scripts, styles and tags out, white space collapsed."""
    out = html
    for tag in ("script", "style", "noscript"):
        out = F.regexp_replace(out, rf"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, "(?s)<[^>]+>", " "), r"\s+", " "))


def escape_like(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\%_])", r"\\$1")


def preview(names: Column, most: int = 3) -> Column:
    """The first names, and how many more there are."""
    more = F.size(names) - most
    return F.concat(F.array_join(F.slice(names, 1, most), ", "), F.when(more > 0, F.concat(F.lit(" +"), more.cast("string"), F.lit(" more"))).otherwise(""))


def rerank_text(sender: Column, date: Column, subject: Column, content: Column) -> Column:
    """The parts that are there, each with its name, between bars."""
    named = lambda name, c: F.concat(F.lit(f"{name}: "), F.nullif(c, F.lit("")))
    return F.concat_ws(" | ", named("From", sender), named("Date", date), named("Subject", subject), named("Content", content))


def query_type(query: Column) -> Column:
    return F.when(F.rlike(query, F.lit(any_of(DRAFTING))), "drafting").when(F.rlike(query, F.lit(any_of(NAVIGATIONAL))), "navigational").otherwise("semantic")


def query_flags(query: Column) -> Column:
    return F.array_compact(F.array(*(F.when(F.rlike(query, F.lit(any_of(p))), F.lit(name)) for name, p in QUERY_FLAGS.items())))


def distinct_by_lower(values: Column) -> Column:
    """Values without those that equal an earlier one but for case."""
    lower = F.transform(values, F.lower)
    return F.transform(F.filter(F.arrays_zip(values.alias("v"), lower.alias("l"), F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1))).alias("n")), lambda x: F.array_position(lower, x["l"]) == x["n"]), lambda x: x["v"])


def document_mentions(text: Column) -> Column:
    """File names in a text: by extension, in quotes, and after `attached`; each once but for case, in that order."""
    strip = lambda c: F.transform(c, lambda x: trimmed(x))
    quoted = F.filter(strip(F.regexp_extract_all(text, F.lit(QUOTED_NAME), F.lit(1))), lambda x: F.contains(x, F.lit("_")) | F.rlike(x, F.lit("[A-Z]")) | F.contains(x, F.lit(".")))
    attached = F.filter(strip(F.regexp_extract_all(text, F.lit(ATTACHED_NAME), F.lit(1))), lambda x: F.length(x) > 2)
    return distinct_by_lower(F.concat(F.regexp_extract_all(text, F.lit(DOCUMENT_NAME), F.lit(1)), quoted, attached))


def entity_mentions(text: Column) -> Column:
    """Quoted strings, capitalised phrases and words of a query, without stop words, each once but for case, by name."""
    found = F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in (ENTITY_QUOTED, ENTITY_PHRASE, ENTITY_WORD)))
    bare = F.transform(found, lambda x: F.regexp_replace(trimmed(x), r"^[.,!?;:]+|[.,!?;:]+\z", ""))
    kept = distinct_by_lower(F.filter(bare, lambda x: (x != "") & ~F.lower(x).isin(ENTITY_STOP_WORDS)))
    return F.transform(F.array_sort(F.transform(kept, lambda x: F.struct(F.lower(x).alias("k"), x.alias("v")))), lambda x: x["v"])
