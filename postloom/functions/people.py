"""People of a message as Column expressions: header fields in a text, names, addresses and roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.functions.text import trimmed

# ---- fixed values: where people stand in a text ----
HEADER_LINES = r"(?im)^(\d{4}-\d{2}-\d{2}[^|\n]+\|\s*From:.+)$"
FIELDS = r"(?i)(?:^|\|)\s*((?:From|To|Cc|Bcc):\s*[^|\n\r]+)"
RECIPIENTS = r"((?:\"[^\"]*\"|[^,;\"])+)"
ADDRESS = r"(?i)([a-z0-9._%+-]+@(?:[a-z0-9-]+\.)+[a-z]{2,})"
DIRECTORY_NAME = r"(?i)^(?:EX:|X500:|/?O=|/?OU=|/?CN=)|/CN="
LAST_COMMON_NAME = r"(?i).*CN=([^/]+).*"
DIRECTORY_HOST = "@exchange.local"
# ---- end of fixed values ----


def _role(field: Column) -> Column:
    name = F.lower(F.regexp_extract(field, r"^\s*(\w+):", 1))
    return F.when(name == "from", "sender").when(name == "to", "recipient").otherwise(name)


def _address(raw: Column) -> Column:
    """A raw recipient's address; a directory name gives one at a host of its own, from its last common name."""
    common = F.lower(F.regexp_replace(F.regexp_extract(raw, LAST_COMMON_NAME, 1), r"\s+$", ""))
    local = F.regexp_replace(F.regexp_replace(F.regexp_replace(common, r"[^a-z0-9!#$%&'*+/=?^_`{|}~.-]", "."), r"\.+", "."), r"^\.|\.$", "")
    plain = F.lower(F.regexp_extract(raw, ADDRESS, 1))
    return F.when(F.rlike(raw, F.lit(DIRECTORY_NAME)), F.concat(F.when(local == "", "unknown").otherwise(local), F.lit(DIRECTORY_HOST))).otherwise(F.nullif(plain, F.lit("")))


def _name(raw: Column, smtp: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(raw, ADDRESS, ""), "[<>]", "")
    bare = F.when(F.rlike(raw, F.lit(DIRECTORY_NAME)), "").otherwise(F.regexp_replace(bare, r"^[\" ]+|[\" ]+$", ""))
    return F.initcap(F.when(bare == "", F.substring_index(smtp, "@", 1)).otherwise(bare))


def people_in_text(text: Column) -> Column:
    """array<struct<smtp, name, role>> of the header lines of a text, each address in the role it is first seen in, by
    address."""
    lines = F.regexp_extract_all(text, F.lit(HEADER_LINES), F.lit(1))
    fields = F.flatten(F.transform(lines, lambda x: F.regexp_extract_all(x, F.lit(FIELDS), F.lit(1))))
    found = F.flatten(
        F.transform(
            fields,
            lambda f: F.transform(F.regexp_extract_all(F.regexp_replace(f, r"^\s*\w+:\s*", ""), F.lit(RECIPIENTS), F.lit(1)), lambda r: F.struct(_address(trimmed(r)).alias("smtp"), trimmed(r).alias("raw"), _role(f).alias("role"))),
        )
    )
    known = F.filter(found, lambda p: p["smtp"].isNotNull())
    keys = F.transform(known, lambda p: p["smtp"])
    first = F.filter(F.transform(known, lambda p, i: F.struct(p.alias("p"), i.alias("i"))), lambda x: F.array_position(keys, x["p"]["smtp"]) == x["i"] + 1)
    return F.array_sort(F.transform(first, lambda x: F.struct(x["p"]["smtp"].alias("smtp"), _name(x["p"]["raw"], x["p"]["smtp"]).alias("name"), x["p"]["role"].alias("role"))))


def backfilled(conversations: DataFrame) -> DataFrame:
    """conversations with participants from their text where they have none, null or empty; all other rows as they are."""
    none = F.coalesce(F.size("participants"), F.lit(0)) <= 0
    return conversations.withColumn("participants", F.when(none, people_in_text(F.col("text"))).otherwise(F.col("participants")))
