"""Merge semantics over plain tables: each takes what is stored and what comes in and returns what is to be stored. A
writer then puts that in a new folder and swaps, or overwrites the partitions it touches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.sources.tables import spare


def upsert(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], version: str, dealt: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The newest row of each key; of equal versions the incoming one. dealt: puts the rows of both into partitions, by
    columns that it may add and that are among the keys, where they are to stay."""
    new = spare("_new", stored)
    both = stored.withColumn(new, F.lit(0)).unionByName(incoming.withColumn(new, F.lit(1)))
    return first_of(dealt(both) if dealt else both, keys, [F.desc(version), F.desc(new)]).drop(new)


def first_of(rows: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """The first row of each key in an order."""
    n = spare("_n", rows)
    return rows.withColumn(n, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(n) == 1).drop(n)


def without_stale(stored: DataFrame, incoming: DataFrame, group: str, key: str) -> DataFrame:
    """stored less the rows of groups that come in again and whose key does not."""
    touched = incoming.select(group).distinct()
    keys = incoming.select(group, key).distinct()
    other = stored.join(touched, group, "left_anti")
    return other.unionByName(stored.join(keys, [group, key], "left_semi"))


def split_known(stored: DataFrame, incoming: DataFrame, group: str, content: str) -> tuple[DataFrame, DataFrame]:
    """(to write, to skip): rows whose content the group has stored are skipped; repeats within incoming all stay."""
    known = stored.select(group, content).distinct()
    return incoming.join(known, [group, content], "left_anti"), incoming.join(known, [group, content], "left_semi")


def insert_missing(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """stored and, for keys that it has not, the first incoming row in the order given."""
    fresh = incoming.join(stored.select(*keys).distinct(), list(keys), "left_anti")
    return stored.unionByName(first_of(fresh, keys, order))


def replace_groups(stored: DataFrame, incoming: DataFrame, group: str) -> DataFrame:
    """stored with the incoming groups' rows in the place of their old ones."""
    return stored.join(incoming.select(group).distinct(), group, "left_anti").unionByName(incoming)


def resolved_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges by name (source, target) as edges by id; those without both ends are dropped."""
    named = nodes.select("name", "node_id")
    one = edges.join(named.select(F.col("name").alias("source"), F.col("node_id").alias("source_id")), "source")
    return one.join(named.select(F.col("name").alias("target"), F.col("node_id").alias("target_id")), "target").drop("source", "target")


def changed(stored: DataFrame, incoming: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Rows (key, status): created, deleted, updated or unchanged, by a full outer join; nulls compare as values."""
    had, has = spare("_had", stored, incoming), spare("_has", stored, incoming)
    old = stored.select(key, *(F.col(c).alias(f"{c}_old") for c in fields), F.lit(True).alias(had))
    new = incoming.select(key, *(F.col(c).alias(f"{c}_new") for c in fields), F.lit(True).alias(has))
    same: Column = F.lit(True)
    for c in fields:
        same = same & F.col(f"{c}_old").eqNullSafe(F.col(f"{c}_new"))
    status = F.when(F.col(had).isNull(), "created").when(F.col(has).isNull(), "deleted").when(same, "unchanged").otherwise("updated")
    return old.join(new, key, "full_outer").select(key, status.alias("status"))


def stale_folders(folders: DataFrame, saved: DataFrame, key: str, modified: str, stamp: str) -> DataFrame:
    """The folders to read again: never saved, or saved before they were last modified."""
    return folders.join(saved.select(key, stamp), key, "left").where(F.col(stamp).isNull() | (F.col(stamp) < F.col(modified)))
