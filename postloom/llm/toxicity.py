"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document's features are the distinct hash slots of its words (letters and digits, A-Z lower-cased), the words' heads
(their first 5 and 7 bytes, which stand for a word in all its endings), word pairs and pairs with one word between.
FTRL-proximal (McMahan et al. 2013) has a learning rate for each coordinate and an L1 penalty that leaves few weights;
those are broadcast, and every whole text is scored in one pass without a shuffle.

The model is fitted on a bounded sample of labelled rows: at most MAX_ROWS of them, in the order of a hash of doc_id.
One task fits it: the rows of all epochs stream through it in order, so that it holds one batch and the coordinates,
however long the texts are. Only labelled rows that learnable() admits are seen.

Edge cases: null and empty texts have no features and get the bias alone. A null doc_id is scored, not learned from, and
not held out. Where labels disagree on a document it counts as toxic; null labels count as none. Of rows that repeat a
doc_id one text is learned from, all are scored. With no labelled rows every score is 0.5 less a little (predicted 0).
Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.llm import kernels as K
from postloom.llm.common import small_batches, stored

BITS = 20
HEADS = (5, 7)
MAX_ROWS = 16000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 6.0, 0.1
BIAS_WITHOUT_LABELS = -1e-6


@dataclass(frozen=True)
class Weights:
    """The weights that are not 0, by slot, and the bias."""

    slots: np.ndarray
    values: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.slots] = self.values
        return out


def learnable(doc_id: Column) -> Column:
    """Whether a document's label may be learned: crc32 of its id as text leaves a remainder by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0, F.lit(False))


def _slots(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all features of the rows, repeated ones too, and the row of each."""
    if len(offsets) == 2 and len(data) > 4 * K.SLICE_BYTES:
        slots = _long_row(data)
        return slots, np.zeros(len(slots), np.int64)
    h, first = K.word_hashes(data, offsets, fold=True, gaps=K.PUNCTUATION)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    grams, rows = [K.mix(h, 1)], [row]
    for k in HEADS:
        grams.append(K.mix(K.word_hashes(data, offsets, fold=True, gaps=K.PUNCTUATION, head=k)[0], 10 + k))
        rows.append(row)
    for gap in (1, 2):
        if len(h) > gap:
            same = row[:-gap] == row[gap:]
            grams.append(K.mix(h[:-gap] * np.uint64(0x9E3779B97F4A7C15) + h[gap:], 1 + gap)[same])
            rows.append(row[gap:][same])
    return np.concatenate(grams) >> np.uint64(64 - BITS), np.concatenate(rows)


def _long_row(data: np.ndarray) -> np.ndarray:
    """Distinct slots of one long row, part by part; a part begins with the two words before it, for the pairs."""
    seen, before = np.zeros(1 << BITS, bool), np.zeros(0, np.uint8)
    for _, part, _ in K.word_pieces(data, np.array([0, len(data)]), K.PUNCTUATION):
        part = np.concatenate([before, part])
        seen[_slots(part, np.array([0, len(part)]))[0].astype(np.int64)] = True
        starts, _, _ = K.words(part, np.array([0, len(part)]), K.PUNCTUATION)
        before = part[starts[-2] :] if len(starts) > 1 else part
        if len(before) > K.SLICE_BYTES:  # two words of such length: their pair with the next one is out of reach
            before = before[:0]
    return np.flatnonzero(seen).astype(np.uint64)


def _features(batches):
    """(doc_id, y, text) to (doc_id, y, slots)."""
    for batch in batches:
        data, offsets, _ = K.binary(batch.column(2))
        lists = []
        for i, j in K.row_slices(offsets):
            a, b = offsets[i], offsets[j]
            slot, row = _slots(data[a:b], offsets[i : j + 1] - a)
            both = np.unique((row.astype(np.uint64) << np.uint64(BITS)) | slot)
            cuts = np.searchsorted(both >> np.uint64(BITS), np.arange(1, j - i))
            lists += np.split((both & np.uint64((1 << BITS) - 1)).astype(np.int32), cuts)
        ends = np.cumsum([0] + [len(x) for x in lists]).astype(np.int32)
        flat = np.concatenate(lists) if lists else np.zeros(0, np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(ends, pa.array(flat))], ["doc_id", "y", "slots"])


class Fit:
    """The coordinates of an FTRL-proximal fit; each row of distinct slots is one update. The bias is the log odds of the
    labels' share (at most 0.45) and is not fitted, so that a text without any known feature, such as an empty one, is
    not found toxic."""

    def __init__(self, share: float):
        self.z, self.n = np.zeros(1 << BITS), np.zeros(1 << BITS)
        share = min(max(share, 0.001), 0.45)
        self.bias = float(np.log(share / (1 - share)))

    def _weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        w[np.abs(z) <= L1] = 0
        return w

    def update(self, at: np.ndarray, y: float) -> None:
        z, n = self.z[at], self.n[at]
        w = self._weights(z, n)
        g = 1 / (1 + np.exp(-np.clip(self.bias + w.sum(), -35, 35))) - y
        self.z[at] = z + g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g

    def weights(self) -> Weights:
        every = self._weights(self.z, self.n)
        held = np.flatnonzero(every)
        return Weights(held, every[held].astype(np.float32), self.bias)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", max_rows: int = MAX_ROWS) -> Weights:
    """Weights from the labelled rows (doc_id, label) that learnable() admits."""
    small_batches(docs.sparkSession)
    marked = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
        .where(learnable(F.col("doc_id")) & F.col("y").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
    )
    total = marked.count()
    part = min(1.0, 2 * max_rows / max(1, total))  # leaves the sort few rows at any size
    near = marked.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) < int(part * (1 << 30)))
    sample = near.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).where("text is not null")
    found = texts.join(F.broadcast(sample), "doc_id").select("doc_id", "y", "text").mapInArrow(_features, "doc_id long, y int, slots array<int>")
    rows = stored(found.groupBy("doc_id").agg(F.min(F.struct("slots", "y")).alias("x")).select("doc_id", "x.slots", "x.y"))
    share = rows.agg(F.avg(F.col("y").cast("double"))).first()[0]
    if share is None:
        return Weights(np.zeros(0, np.int64), np.zeros(0, np.float32), BIAS_WITHOUT_LABELS)
    epochs = EPOCHS

    def fitted(batches):
        fit = Fit(share)
        for batch in batches:
            slots = batch.column(0)
            flat, ends, y = np.asarray(slots.flatten()), np.asarray(slots.value_lengths()).cumsum(), np.asarray(batch.column(1)).astype(float)
            for k, end in enumerate(ends.tolist()):
                fit.update(flat[ends[k - 1] if k else 0 : end], y[k])
        w = fit.weights()
        yield pa.RecordBatch.from_arrays([pa.array(w.slots), pa.array(w.values)], ["slot", "value"])

    order = F.xxhash64("doc_id", F.lit(7))
    streamed = rows.repartition(1).withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs)))).sortWithinPartitions("epoch", order, "doc_id")
    table = streamed.select("slots", "y").mapInArrow(fitted, "slot long, value float").toArrow()
    return Weights(table["slot"].to_numpy(), table["value"].to_numpy(), Fit(share).bias)


def _margins(table: np.ndarray, bias: float, texts: pa.Array) -> np.ndarray:
    """The sum of each text's weights: each slot counts once."""
    data, offsets, _ = K.binary(texts)
    out = np.full(len(texts), bias)
    for i, j in K.row_slices(offsets):
        a, b = offsets[i], offsets[j]
        slot, row = _slots(data[a:b], offsets[i : j + 1] - a)
        hit = table[slot.astype(np.int64)] != 0
        both = np.unique((row[hit].astype(np.uint64) << np.uint64(BITS)) | slot[hit])
        out[i:j] += np.bincount((both >> np.uint64(BITS)).astype(np.int64), table[(both & np.uint64((1 << BITS) - 1)).astype(np.int64)], j - i)
    return out


def score(docs: DataFrame, weights: Weights) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, score."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def scored(batches):
        table = shared.value.table()
        for batch in batches:
            margin = np.clip(_margins(table, shared.value.bias, batch.column(1)), -35, 35)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-margin)))], ["doc_id", "score"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return texts.mapInArrow(scored, "doc_id long, score double")


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return score(docs, train(docs, labels)).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, weights: Weights, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text is not predicted toxic."""
    small_batches(docs.sparkSession)
    shared, at = docs.sparkSession.sparkContext.broadcast(weights), docs.columns.index(text_col)

    def clean(batches):
        table = shared.value.table()
        for batch in batches:
            yield batch.filter(pa.array(_margins(table, shared.value.bias, batch.column(at)) < 0))

    return docs.mapInArrow(clean, docs.schema)
