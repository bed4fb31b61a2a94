"""Incremental indexing: two snapshots give a feed of changes, and only what changed is chunked and embedded."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.operators import chunking, embedding
from postloom.sources.sink import KeyedTable
from postloom.sources.tables import stored


def change_feed(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Rows of new and of what old has besides, with `change`: insert, update (one of the fields differs) or delete (with
    the old row). Rows that are the same are left out; nulls compare as values."""
    names = new.columns
    a = old.select(F.struct(*names).alias("old_"), F.col(key).alias("key_"))
    b = new.select(F.struct(*names).alias("new_"), F.col(key).alias("key_"))
    differs = F.lit(False)
    for f in fields:
        differs = differs | ~F.col(f"old_.{f}").eqNullSafe(F.col(f"new_.{f}"))
    change = F.when(F.col("old_").isNull(), "insert").when(F.col("new_").isNull(), "delete").when(differs, "update")
    rows = a.join(b, "key_", "full_outer").withColumn("change", change).where("change IS NOT NULL")
    return rows.select(F.coalesce("new_", "old_").alias("row"), "change").select("row.*", "change")


class IncrementalIndex:
    """Documents (key, text and what tells a change) and their chunks with embeddings, both as keyed tables."""

    def __init__(self, spark, path: str, kind: str = "long", embed: embedding.Embedder = embedding.hashed, chars: int = 800, stride: int = 600, buckets: int = 16):
        self.embed, self.chars, self.stride = embed, chars, stride
        self.documents = KeyedTable(spark, f"{path}/documents", f"key {kind}, text string, hash string, modified timestamp", ["key"], buckets=buckets)
        self.chunks = KeyedTable(spark, f"{path}/chunks", f"key {kind}, position int, text string, embedding array<float>, status string", ["key", "position"], by=["key"], buckets=buckets)

    def run(self, snapshot: DataFrame, number: int) -> DataFrame:
        """Brings the index to a snapshot (key, text, modified) and returns the feed (key, change). The chunks of changed
        documents take the place of all of theirs before the documents do, so that a run that died is simply run again: it
        finds the same changes, and what it had done is done anew or skipped by its number."""
        rows = snapshot.select("key", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"), "modified")
        # old texts stay where they are: digests tell what changed, and what is deleted goes by its key
        old = self.documents.rows().select("key", F.lit(None).cast("string").alias("text"), "hash", F.lit(None).cast("timestamp").alias("modified"))
        feed = stored(change_feed(old, rows, "key", ["hash"]) if self.documents.commits() else rows.withColumn("change", F.lit("insert")))
        text = feed.where("change <> 'delete'").select("key", "text")
        cut = chunking.fixed_stride(text, "key", "text", self.chars, self.stride).select(F.col("id").alias("key"), "position", "text")
        self.chunks.replace(embedding.with_embeddings(cut, "text", self.embed), feed.select("key"), "index", number)
        self.documents.upsert(feed.withColumn("gone", F.col("change") == "delete"), "index", number, "gone")
        return feed.select("key", "change")
