"""Stable ids: name-based UUIDs (version 5) as a native expression over SHA-1."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F


def uuid5(namespace: uuid.UUID, name: Column) -> Column:
    """What uuid.uuid5(namespace, name) gives."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    part = lambda a, n: F.substring(h, a, n)
    variant = F.lower(F.hex(F.conv(part(17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def tenant_namespace(tenant: str) -> uuid.UUID:
    return uuid.uuid5(uuid.NAMESPACE_DNS, f"tenant:{tenant}")


def stable_id(tenant: str, *parts: Column) -> Column:
    """An id that depends on the tenant and the parts alone."""
    return uuid5(tenant_namespace(tenant), F.concat_ws(":", *(p.cast("string") for p in parts)))


def content_hash(text: Column) -> Column:
    """SHA-256 of a text whose line ends are made one."""
    return F.sha2(F.regexp_replace(text, "\r\n", "\n"), 256)
