"""Content-addressed WARC archive: payload bytes once, exact record headers apart, records rebuilt by a join.

write_archive() makes a WARC/1.1 record for each page and writes two tables into the archive's folder: payloads
(sha256, sha1, payload, first_id, n), one row per distinct payload, and records (page_id, header, sha256, part), one row
per record with the header's exact bytes. Payloads are told apart by SHA-256, and what shares one is verified to share its
length and SHA-1 too. read_archive() checks every stored payload against its digests once, parses the headers and joins
the two again: responses get their block, revisits the length of the payload that they stand for.

Of records with equal payloads of at least min_revisit bytes that with the smallest id is the response and the others
revisit it; smaller ones are all responses. Headers hold a fixed date, so that a page always gives the same record.

A payload that very many pages share is no hot key: pages meet their payload's first id by digest and one of SALTS salts,
and records of a digest are dealt over one part for each DEAL of them, which the stored payload's length (and, where
there are several responses, its bytes) is handed to.

Edge cases: a null payload is empty; a null id makes a response record without id of its own (it never becomes the
record others refer to while another has an id); a null url has no WARC-Target-URI line. Control characters, spaces and
characters beyond ASCII of a url are percent-encoded. Rows that repeat an id and payload are all responses of that id.
Extra columns are ignored. An empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm.common import work_path

DATE = "2024-01-01T00:00:00Z"
SALTS = 256  # that the pages of a digest are spread over
DEAL = 100_000  # records of a digest in a part, about
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """The bare upper-case base32 SHA-1 of binary data: five hex digits make four characters."""
    hexed = F.sha1(payload)
    parts = []
    for k in range(8):
        value = F.conv(F.substring(hexed, 5 * k + 1, 5), 16, 10).cast("int")
        parts += [F.substring(F.lit(_BASE32), F.shiftright(value, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*parts)


def _uri(url: Column) -> Column:
    """A url with everything but printing ASCII percent-encoded, character by character in UTF-8."""
    plain = F.regexp_replace(F.url_encode(url), r"\+", "%20")
    kept = reduce(lambda c, x: F.replace(c, F.lit(f"%{ord(x):02X}"), F.lit(x)), "!#$%&'()*+,/:;=?@[]~", plain)
    return F.when(F.rlike(url, F.lit(r"[^\x21-\x7E]")), kept).otherwise(url)


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit: int = 0) -> None:
    """Writes path/payloads and path/records."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "sha256": F.unhex(F.sha2("payload", 256)), "sha1": base32_sha1(F.col("payload"))})
    # the payload's bytes are dealt out once for each distinct payload and task: the aggregate combines them first
    store = rows.groupBy("sha256").agg(
        F.min("page_id").alias("first_id"),
        F.count("*").alias("n"),
        F.min("payload_bytes").alias("least"),
        F.max("payload_bytes").alias("most"),
        F.min("sha1").alias("sha1"),
        F.max("sha1").alias("sha1_last"),
        F.any_value("payload").alias("payload"),
    )
    same = (F.col("least") == F.col("most")) & (F.col("sha1") == F.col("sha1_last"))
    store = store.withColumn("sha1", F.when(same, F.col("sha1")).otherwise(F.raise_error(F.lit("two payloads share a SHA-256 digest"))))
    store.select("sha256", "sha1", "payload", "first_id", "n", (F.col("least") < min_revisit).alias("small")).write.parquet(f"{path}/payloads")
    light = rows.drop("payload").withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)))
    first = pages.sparkSession.read.parquet(f"{path}/payloads").select("sha256", "first_id", "n")
    salted = light.select("sha256", "salt").distinct().join(first, "sha256")
    parts = F.greatest(F.ceil(F.col("n") / DEAL), F.lit(1))
    records = light.join(salted, ["sha256", "salt"]).withColumn("part", F.pmod(F.xxhash64("page_id", "url", F.lit(1)), parts).cast("int"))
    revisit = (F.col("payload_bytes") >= min_revisit) & F.coalesce(F.col("page_id") != F.col("first_id"), F.col("first_id").isNotNull())
    name = lambda c: F.concat(F.lit("<urn:postloom:record:"), c.cast("string"), F.lit(">"))
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value)
    header = F.concat(
        F.concat_ws(
            "\r\n",
            F.lit("WARC/1.1"),
            line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
            line("WARC-Record-ID", name(F.coalesce(F.col("page_id").cast("string"), F.lit("none")))),
            F.lit(f"WARC-Date: {DATE}"),
            line("WARC-Target-URI", _uri(F.col("url"))),
            line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
            F.when(revisit, line("WARC-Refers-To", name(F.col("first_id")))),
            F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            F.lit("Content-Type: text/html; charset=utf-8"),
            line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
        ),
        F.lit("\r\n\r\n"),
    )
    # what answers alone for its payload needs no dealing
    alone = F.when(revisit | (F.col("payload_bytes") < min_revisit), F.col("part")).otherwise(F.lit(0))
    records.select("page_id", header.cast("binary").alias("header"), "sha256", alone.alias("part")).write.parquet(f"{path}/records")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archive, rebuilt: page_id, header, block (empty for revisits), record_type, refers_to,
    payload_digest, payload_bytes. A stored payload that does not have its digests is an error."""
    payloads = spark.read.parquet(f"{path}/payloads")
    sound = (F.unhex(F.sha2("payload", 256)) == F.col("sha256")) & (base32_sha1(F.col("payload")) == F.col("sha1"))
    # checked once for each stored payload, before any join
    checked = payloads.withColumn("payload", F.when(sound, F.col("payload")).otherwise(F.raise_error(F.lit("a payload differs from its digest")).cast("binary")))
    every = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / DEAL), F.lit(1)).cast("int") - 1)
    bodies = checked.select("sha256", F.explode(F.when(F.col("small"), every).otherwise(F.array(F.lit(0)))).alias("part"), "payload")
    facts = checked.select("sha256", F.explode(every).alias("part"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    text = F.col("header").cast("string")
    field = lambda key: F.nullif(F.regexp_extract(text, rf"(?m)^{key}: ?([^\r\n]*)", 1), F.lit(""))
    number = lambda c: F.regexp_extract(c, r":record:(-?\d+)>$", 1)
    records = spark.read.parquet(f"{path}/records").select(
        F.nullif(number(field("WARC-Record-ID")), F.lit("")).cast("long").alias("page_id"),
        "header",
        "sha256",
        "part",
        field("WARC-Type").alias("record_type"),
        number(field("WARC-Refers-To")).try_cast("long").alias("refers_to"),
        F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("payload_digest"),
        field("Content-Length").cast("long").alias("content_length"),
    )
    responses = records.where("record_type = 'response'").join(bodies, ["sha256", "part"])
    responses = responses.select(*_FIELDS, F.col("payload").alias("block"), F.octet_length("payload").cast("long").alias("payload_bytes"), "content_length")
    whole = F.col("payload_bytes") == F.col("content_length")
    responses = responses.withColumn("block", F.when(whole, F.col("block")).otherwise(F.raise_error(F.lit("a block differs from its header's length")).cast("binary"))).drop("content_length")
    revisits = records.where("record_type = 'revisit'").join(facts, ["sha256", "part"])
    return responses.unionByName(revisits.select(*_FIELDS, F.lit("").cast("binary").alias("block"), "payload_bytes"))


_FIELDS = ["page_id", "header", "record_type", "refers_to", "payload_digest"]


def record_bytes(records: DataFrame) -> DataFrame:
    """Rows of read_archive() with record, the bytes that a WARC file holds: header, block, two line ends."""
    return records.withColumn("record", F.concat("header", "block", F.lit("\r\n\r\n").cast("binary")))


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of one WARC record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(re.match(r"([^:]+): ?(.*)", x).groups() for x in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def page_records(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the archive of pages, reads it back and returns a row per page: page_id, payload_bytes, payload_digest,
    record_type, refers_to. Every record's bytes are put together, and what is returned is read from them: a record that
    is not its header, its block and two line ends is an error."""
    path = path or work_path(pages.sparkSession, "warc")
    write_archive(pages, path)
    back = record_bytes(read_archive(pages.sparkSession, path))
    size = F.octet_length("header") + F.octet_length("block") + 4
    length = F.when(F.octet_length("record") == size, F.col("payload_bytes")).otherwise(F.raise_error(F.lit("a record is not whole")).cast("long"))
    return back.select("page_id", length.alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def reference_digest(payload: bytes) -> str:
    """What base32_sha1() gives, by the standard library (for tests)."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()
