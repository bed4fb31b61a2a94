"""Embedding of texts by a pluggable model, in Arrow batches: filling, backfilling and re-embedding."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from postloom.sources.tables import small_batches, spare, stored

Embedder = Callable[[list[str]], np.ndarray]
DIM, BATCH = 64, 256


def hashed(texts: list[str], dim: int = DIM) -> np.ndarray:
    """A deterministic embedder for tests and for where no model is at hand: signed word hashes at length 1."""
    import zlib

    out = np.zeros((len(texts), dim))
    for k, text in enumerate(texts):
        for w in text.lower().split():
            h = zlib.crc32(w.encode())
            out[k, h % dim] += 1 if h & 0x10000 else -1
    n = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(n == 0, 1, n)).astype("float32")


def lengths(texts: list[str], dim: int = DIM) -> np.ndarray:
    """An embedder that only tells lengths, for tests of what surrounds a model."""
    return np.array([[len(t)] * dim for t in texts], "float32").reshape(-1, dim)


def embedded(rows: DataFrame, key: str, text_col: str, embed: Embedder = hashed) -> DataFrame:
    """Rows (key, embedding, status) of the rows whose text is not blank. A batch that fails is tried row by row; rows
    that fail, or whose first components are all 0, are `skipped`."""
    wanted = rows.select(key, F.col(text_col).alias("text")).where("text is not null and trim(text) <> ''")
    return with_embeddings(wanted, "text", embed).drop("text")


def with_embeddings(rows: DataFrame, text_col: str, embed: Embedder = hashed) -> DataFrame:
    """rows with embedding and status, as embedded() gives them, in one pass; rows whose text is blank are `blank`."""

    def safely(texts: list[str]) -> list:
        try:
            return list(embed(texts))
        except Exception:  # noqa: BLE001  whatever the model raises for a row is that row's status
            return [None] if len(texts) == 1 else [v for t in texts for v in safely([t])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), BATCH):
                part = pdf.iloc[at : at + BATCH]
                some = np.array([isinstance(t, str) and t.strip(" ") != "" for t in part[text_col]], bool)
                found = iter(safely(part[text_col][some].tolist()) if some.any() else [])
                each = [next(found) if s else None for s in some]
                good = [v is not None and bool(np.any(v[:10])) for v in each]
                status = ["embedded" if g else "skipped" if s else "blank" for g, s in zip(good, some, strict=True)]
                yield part.assign(embedding=pd.Series([v if g else None for v, g in zip(each, good, strict=True)], index=part.index, dtype=object), status=status)

    schema = T.StructType([*rows.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("status", T.StringType())])
    return small_batches(rows).mapInPandas(run, schema)


def reembedded(chunks: DataFrame, key: str, text_col: str, embed: Embedder = hashed, force: bool = False) -> DataFrame:
    """chunks with every text embedded anew (force), or only where an embedding is missing, whatever the status was."""
    e, s = spare("_e", chunks), spare("_s", chunks)
    todo = F.lit(True) if force else F.col("embedding").isNull()
    fresh = embedded(chunks.where(todo), key, text_col, embed).select(key, F.col("embedding").alias(e), F.col("status").alias(s))
    joined = chunks.join(fresh, key, "left")
    return joined.select(*(c for c in chunks.columns if c not in ("embedding", "status")), F.coalesce(e, "embedding").alias("embedding"), F.coalesce(s, "status").alias("status"))


def embedded_with_retries(rows: DataFrame, key: str, text_col: str, embed: Embedder = hashed, retries: int = 2) -> DataFrame:
    """As embedded(), one row a key, with what failed tried again up to `retries` times in jobs of its own (a model may
    fail for a while); `attempts` says how often. Each job's rows are stored, so that no text that is done is embedded again."""
    asked = rows.select(key, text_col).dropDuplicates([key])
    found = stored(embedded(asked, key, text_col, embed).withColumn("attempts", F.lit(1)))
    done = found.where("status = 'embedded'")
    for k in range(retries):
        failed = found.where("status <> 'embedded'")
        if failed.isEmpty():
            break
        found = stored(embedded(asked.join(failed.select(key), key), key, text_col, embed).withColumn("attempts", F.lit(k + 2)))
        done = done.unionByName(found.where("status = 'embedded'"))
    return done.unionByName(found.where("status <> 'embedded'"))


def backfill(chunks: DataFrame, key: str, text_col: str, embed: Embedder = hashed) -> DataFrame:
    """chunks (key, text, embedding, status) with what lacks an embedding and is not skipped embedded, the rest as it is."""
    todo = (F.col("embedding").isNull()) & (F.coalesce("status", F.lit("")) != "skipped") & (F.trim(F.coalesce(F.col(text_col), F.lit(""))) != "")
    fresh = embedded(chunks.where(todo), key, text_col, embed)
    e, s = spare("_e", chunks), spare("_s", chunks)
    joined = chunks.join(fresh.select(key, F.col("embedding").alias(e), F.col("status").alias(s)), key, "left")
    return joined.select(*(c for c in chunks.columns if c not in ("embedding", "status")), F.coalesce(e, "embedding").alias("embedding"), F.coalesce(s, "status").alias("status"))


def reindex_stream(stream: DataFrame, key: str, text_col: str, path: str, checkpoint: str, embed: Embedder = hashed) -> StreamingQuery:
    """Embeds a stream of texts into Parquet, a batch at a time; what a failed run has not committed is done again."""
    return embedded(stream, key, text_col, embed).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
