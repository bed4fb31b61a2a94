"""The search filter grammar: a query string's `name:value` terms as a filter on chunks and conversations."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import UTC, datetime
from email.utils import parsedate_to_datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The grammar's names, and the roles under which people are kept.
ROLES = {"from": "sender", "to": "recipient", "cc": "cc"}
TERM = re.compile(r'(?<!\S)(from|to|cc|subject|after|before|has|type):(?:"([^"]*)"|(\S+))', re.IGNORECASE)
EXCLUDED = re.compile(r"(?<!\S)-(\w[\w-]*)")
MOST_IDS = 1000


@dataclass
class Filters:
    people: dict[str, set[str]] = field(default_factory=dict)  # by role
    subject: list[str] = field(default_factory=list)
    after: datetime | None = None
    before: datetime | None = None
    has_attachment: bool | None = None
    types: set[str] = field(default_factory=set)
    exclude: list[str] = field(default_factory=list)

    def is_empty(self) -> bool:
        return self == Filters()


def parse_date(value: str) -> datetime | None:
    """An ISO or mail date in UTC; None for what is neither."""
    for read in (lambda v: datetime.fromisoformat(v.replace("Z", "+00:00")), parsedate_to_datetime):
        try:
            d = read(value)
        except (ValueError, TypeError):
            continue
        return d.replace(tzinfo=UTC) if d.tzinfo is None else d.astimezone(UTC)
    return None


def parse(query: str) -> tuple[Filters, str]:
    """The filters of a query string and what is left of it."""
    out = Filters()

    def take(m: re.Match) -> str:
        name, value = m.group(1).lower(), (m.group(2) if m.group(2) is not None else m.group(3)).strip()
        low = value.lower()
        if name in ROLES:
            out.people.setdefault(ROLES[name], set()).add(low)
        elif name == "subject":
            out.subject.append(low)
        elif name in ("after", "before"):
            if (d := parse_date(value)) is not None:
                setattr(out, name, d)
        elif name == "type":
            out.types |= {t.strip().lstrip(".") for t in low.split(",") if t.strip()}
        elif low in ("attachment", "attachments"):
            out.has_attachment = True
        elif low in ("noattachment", "noattachments"):
            out.has_attachment = False
        else:
            return m.group(0)
        return " "

    rest = TERM.sub(take, query or "")
    out.exclude = [m.lower() for m in EXCLUDED.findall(rest)]
    return out, " ".join(EXCLUDED.sub(" ", rest).split())


def _all(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def _has(participants: Column, role: str, people: list[str]) -> Column:
    return F.exists(participants, lambda p: (p["role"] == role) & F.lower(p["smtp"]).isin(people))


def chunk_filter(f: Filters, text: Column, is_attachment: Column, file_type: Column) -> Column:
    """What a filter asks of a chunk."""
    tests = [~F.contains(F.lower(text), F.lit(t)) for t in f.exclude]
    if f.has_attachment is not None:
        tests.append(is_attachment == f.has_attachment)
    if f.types:
        tests.append(F.lower(file_type).isin(sorted(f.types)))
    return _all(tests)


def conversation_filter(f: Filters, subject: Column, latest: Column, participants: Column) -> Column:
    """What a filter asks of a conversation; participants: array<struct<role, smtp>>. Any address of a role will do, every
    role must."""
    tests = [F.contains(F.lower(subject), F.lit(t)) for t in f.subject]
    if f.after:
        tests.append(latest >= F.lit(f.after.replace(tzinfo=None)))
    if f.before:
        tests.append(latest <= F.lit(f.before.replace(tzinfo=None)))
    for role, people in sorted(f.people.items()):
        tests.append(_has(participants, role, sorted(people)))
    return _all(tests)


def resolve(f: Filters, conversations: DataFrame) -> DataFrame | None:
    """The ids of the conversations that a filter leaves, as a frame for a semi join; None where it asks nothing of them."""
    if not (f.subject or f.after or f.before or f.people):
        return None
    return conversations.where(conversation_filter(f, F.col("subject"), F.col("latest_date"), F.col("participants"))).select("conversation_id")


def merged_ids(conversation_ids: Column, thread_ids: Column) -> Column:
    """Both id lists as one, in order, each id once and none empty; null where neither is given."""
    none = F.array().cast("array<string>")
    both = F.concat(F.coalesce(conversation_ids, none), F.coalesce(thread_ids, none))
    out = F.array_distinct(F.filter(both, lambda x: F.coalesce(x, F.lit("")) != ""))
    return F.when(conversation_ids.isNull() & thread_ids.isNull(), F.lit(None)).otherwise(out)


def narrowed(rows: DataFrame, ids: DataFrame | None, key: str) -> DataFrame:
    """rows of the ids: all of them where ids is None, none of them where ids is empty."""
    return rows if ids is None else rows.join(ids.select(key), key, "left_semi")


def subject_filter(f: Filters, subject: Column, attachment: Column, file_type: Column, date: Column) -> Column:
    """The older variant on rows of messages: excluded words are looked for in the subject, and a row without a file type
    passes any type filter."""
    low, kind = F.lower(F.coalesce(subject, F.lit(""))), F.regexp_replace(F.lower(F.coalesce(file_type, F.lit(""))), r"^\.+", "")
    tests = [F.contains(low, F.lit(t)) for t in f.subject] + [~F.contains(low, F.lit(t)) for t in f.exclude]
    if f.has_attachment is not None:
        held = F.coalesce(attachment, F.lit("")) != ""
        tests.append(held if f.has_attachment else ~held)
    if f.types:
        tests.append((kind == "") | kind.isin(sorted(f.types)))
    if f.after:
        tests.append(F.coalesce(date >= F.lit(f.after.replace(tzinfo=None)), F.lit(False)))
    if f.before:
        tests.append(F.coalesce(date <= F.lit(f.before.replace(tzinfo=None)), F.lit(False)))
    return _all(tests)
