"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

A text's features are its 1- to 3-grams of characters (case folded; runs of anything but letters count as spaces), hashed
into 2**BITS slots: the share of its n-grams that falls into a slot, times the slot's inverse document frequency. The
model is fitted by FTRL-proximal (follow the regularised leader with per-coordinate rates, L1 and L2 penalties), then one
temperature is fitted on rows that the fit did not see, so that the scores are calibrated.

Document frequencies are counted over all learnable documents, by task first. The model is fitted on a bounded sample of
rows: MAX_ROWS of them shared by the languages (at least one each), those of the smallest hashes of doc_id and text, of
texts of any length. Every whole text is scored in one pass, without a shuffle.

Edge cases: null texts and those without a letter are `und` with score 0; so is everything where nothing can be learned.
A null doc_id is neither learned from nor held out. Of rows that repeat a doc_id and text one is learned from; all are
scored. Every language that has a learnable row is learned. Extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.llm import kernels as K
from postloom.llm.common import small_batches

BITS = 16
ORDERS = (1, 2, 3)  # each builds on the one before
MAX_ROWS = 6000
SCALE = 64.0
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.01
STEP = 1 << 17  # bytes looked at together: what fits a core's cache


def _letters() -> np.ndarray:
    """For code points up to 0x2FFF whether they are letters; those beyond count as letters but for punctuation blocks."""
    return np.array([chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(0x3000)])


_LETTERS = _letters()


@dataclass(frozen=True)
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # slots x languages, mostly 0
    bias: np.ndarray
    temperature: float

    def packed(self) -> tuple:
        """What is broadcast: the slots that have a weight."""
        at = np.flatnonzero(self.weights.any(1))
        return self.languages, at, (self.weights[at] * (SCALE * self.idf[at])[:, None]).astype(np.float32), self.bias, self.temperature


def learnable(doc_id: Column) -> Column:
    """Whether a document may be learned from: crc32 of its id as text leaves no remainder of 2 by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2, F.lit(False))


def _pieces(data: np.ndarray, offsets: np.ndarray):
    """(first row, slots of the n-grams, each row's first n-gram) for rows in parts of bounded size; a row of more than
    a part comes in several, each with the characters before it that its first n-grams need."""
    for i, j in K.row_slices(offsets, STEP):
        a, b = int(offsets[i]), int(offsets[j])
        before = a
        while b - a > 2 * STEP:  # one long row
            c = a + STEP
            while (data[c] & 0xC0) == 0x80:
                c -= 1
            yield i, *_rest(data, before, a, c)
            before = _back(data, a, c)
            a = c
        if before < a or a > int(offsets[i]):
            yield i, *_rest(data, before, a, b)
        else:
            yield i, *_slots(data[a:b], np.maximum(offsets[i : j + 1] - a, 0))


def _back(data: np.ndarray, low: int, at: int) -> int:
    """The byte where the last characters before a place begin, as many as an n-gram reaches back to."""
    for _ in range(max(ORDERS) - 1):
        at -= 1
        while at > low and (data[at] & 0xC0) == 0x80:
            at -= 1
    return max(at, low)


def _rest(data: np.ndarray, before: int, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the n-grams that end at the characters of a piece of one row."""
    slots, first = _slots(data[before:b], np.array([0, b - before]))
    extra = int(((data[before:a] & 0xC0) != 0x80).sum()) * len(ORDERS)
    return slots[extra:], first - np.array([0, extra])


def _slots(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all n-grams of each row, by the character that they end at, and each row's first one. The n-grams at a
    row's start see spaces before it."""
    cp, first = K.code_points(data, offsets)
    cp = K.folded(cp)
    letter = _LETTERS[np.minimum(cp, 0x2FFF)] | (cp >= 0x3400)
    c = np.where(letter, cp, 32).astype(np.uint64)
    cuts = first[:-1][first[:-1] < len(c)]
    x = c * np.uint64(0x9E3779B97F4A7C15)
    out = np.empty((len(c), len(ORDERS)), np.int64)
    gram = np.zeros(len(c), np.uint64)
    for k, n in enumerate(ORDERS):
        before = np.full(len(c), n, np.uint64)  # what the n-gram has before its last character
        if n > 1:
            before[1:] += gram[:-1]
            before[cuts] = n
        gram = before * np.uint64(0xC2B2AE3D27D4EB4F) + x
        out[:, k] = ((gram ^ (gram >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)
    return out.ravel(), first * len(ORDERS)


def _frequencies(batches):
    """Documents of the task by slot, and their number under slot -1."""
    counts, docs = np.zeros(1 << BITS, np.int64), 0
    seen = np.zeros(1 << BITS, bool)
    for batch in batches:
        data, offsets, _ = K.binary(batch.column(0))
        docs += len(batch)
        last = None
        for i, slots, first in _pieces(data, offsets):
            for k in range(len(first) - 1):
                if last is not None and i + k != last:
                    counts += seen
                    seen[:] = False
                last = i + k
                seen[slots[first[k] : first[k + 1]]] = True
        counts += seen
        seen[:] = False
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(counts[at], docs))], ["slot", "docs"])


def _features(batches):
    """(y, place, text) to (y, place, slots, shares)."""
    for batch in batches:
        data, offsets, _ = K.binary(batch.column(2))
        lists, shares = [np.zeros(0, np.int32)] * len(batch), [np.zeros(0, np.float32)] * len(batch)
        sums, row = np.zeros(1 << BITS, np.int64), None  # of the row that the last piece ended in

        def close(row, sums, lists=lists, shares=shares):
            at = np.flatnonzero(sums)
            lists[row], shares[row] = at.astype(np.int32), (sums[at] / max(1, sums.sum())).astype(np.float32)
            sums[at] = 0

        for i, slots, first in _pieces(data, offsets):
            for k in range(len(first) - 1):
                if row is not None and row != i + k:
                    close(row, sums)
                row = i + k
                at, n = np.unique(slots[first[k] : first[k + 1]], return_counts=True)
                sums[at] += n
        if row is not None:
            close(row, sums)
        ends = np.cumsum([0] + [len(x) for x in lists]).astype(np.int32)
        flat = lambda parts, kind: pa.array(np.concatenate(parts) if parts else np.zeros(0, kind))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.ListArray.from_arrays(ends, flat(lists, np.int32)), pa.ListArray.from_arrays(ends, flat(shares, np.float32))],
            ["y", "place", "slots", "shares"],
        )


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Weights (slots x classes) and bias fitted to rows of (slots, values)."""
    size = 1 << BITS
    z, n = np.zeros((size + 1, classes)), np.zeros((size + 1, classes))

    def weights(z, n):
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        w[np.abs(z) <= L1] = 0
        return w

    order = np.random.default_rng(11).permutation(len(rows))
    for _ in range(epochs):
        for r in order.tolist():
            at, x = np.append(rows[r][0], size), np.append(rows[r][1], 1.0)
            zr, nr = z[at], n[at]
            w = weights(zr, nr)
            p = _softmax(x @ w)
            p[y[r]] -= 1
            g = x[:, None] * p
            step = (np.sqrt(nr + g * g) - np.sqrt(nr)) / ALPHA
            z[at] = zr + g - step * w
            n[at] = nr + g * g
    every = weights(z, n)
    return every[:-1], every[-1]


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of the highest likelihood, by golden section over its logarithm."""
    if not len(y):
        return 1.0

    def loss(t):
        p = _softmax(logits / np.exp(t))
        return -np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).mean()

    a, b, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(50):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def train(docs: DataFrame, max_rows: int = MAX_ROWS) -> Model | None:
    """A model of the documents (doc_id, text, lang) that learnable() admits."""
    small_batches(docs.sparkSession)
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    known = known.where(learnable(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    # one row a language comes to the driver, as do the model's weights for each
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).toArrow()
    if not len(counts):
        return None
    totals = dict(zip(counts["lang"].to_pylist(), counts["n"].to_pylist(), strict=True))
    languages = sorted(totals)
    each = max(1, max_rows // len(languages))
    # of every language some more rows than needed, drawn by a hash, then those of the smallest hashes
    limits = docs.sparkSession.createDataFrame([(lang, k, int(min(1.0, (2 * each + 32) / totals[lang]) * (1 << 30))) for k, lang in enumerate(languages)], "lang string, y int, below int")
    place = F.xxhash64("doc_id", "text")
    drawn = known.join(F.broadcast(limits), "lang").withColumn("place", place).where(F.pmod("place", F.lit(1 << 30)) < F.col("below"))
    first = Window.partitionBy("y").orderBy(F.pmod("place", F.lit(1 << 30)), "place")
    chosen = drawn.select("y", "place").distinct().withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= each).select("y", "place")
    featured = drawn.select("y", "place", F.col("text").cast("binary").alias("text")).mapInArrow(_features, "y int, place long, slots array<int>, shares array<float>")
    once = featured.groupBy("y", "place").agg(F.first(F.struct("slots", "shares")).alias("x"))
    table = once.join(F.broadcast(chosen), ["y", "place"]).select("y", "place", "x.slots", "x.shares").toArrow().sort_by([("place", "ascending"), ("y", "ascending")]).combine_chunks()
    frequency = known.select(F.col("text").cast("binary").alias("text")).mapInArrow(_frequencies, "slot long, docs long").groupBy("slot").agg(F.sum("docs").alias("docs")).toArrow()
    slot, docs_with = np.asarray(frequency["slot"]), np.asarray(frequency["docs"]).astype(float)
    total = docs_with[slot == -1].sum()
    idf = np.full(1 << BITS, np.log(1 + total))
    idf[slot[slot >= 0]] = np.log((1 + total) / (1 + docs_with[slot >= 0])) + 0.05
    slots, shares = table["slots"].combine_chunks(), table["shares"].combine_chunks()
    cuts = np.asarray(slots.value_lengths()).cumsum()[:-1] if len(table) else np.zeros(0, int)
    rows = [(s, SCALE * v * idf[s]) for s, v in zip(np.split(np.asarray(slots.flatten()), cuts), np.split(np.asarray(shares.flatten()).astype(float), cuts), strict=True)]
    y = np.asarray(table["y"])
    if not len(y):
        return None
    aside = np.arange(len(y)) % 5 == 4
    w, bias = ftrl([r for r, a in zip(rows, aside, strict=True) if not a], y[~aside], len(languages))
    logits = np.array([v @ w[s] + bias for (s, v), a in zip(rows, aside, strict=True) if a]).reshape(-1, len(languages))
    return Model(languages, idf, w, bias, temperature(logits, y[aside]))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, lang_pred, score."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("written"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    if model is None:
        return texts.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model.packed())

    def predicted(batches):
        languages, at, values, bias, t = shared.value
        row_of = np.zeros(1 << BITS, np.int32)  # row 0 has no weight
        row_of[at] = np.arange(1, len(at) + 1)
        values = np.vstack([np.zeros((1, len(languages)), np.float32), values])
        names = pa.array([*languages, "und"])
        for batch in batches:
            data, offsets, _ = K.binary(batch.column(2))
            sums, grams = np.zeros((len(batch), len(languages))), np.zeros(len(batch))
            for i, slots, first in _pieces(data, offsets):
                rows, part = row_of[slots], np.zeros((len(first) - 1, len(languages)))
                full = np.flatnonzero(np.diff(first))
                if len(full):
                    for k in range(len(languages)):
                        part[full, k] = np.add.reduceat(values[:, k][rows], first[full], dtype=np.float64)
                sums[i : i + len(first) - 1] += part
                grams[i : i + len(first) - 1] += np.diff(first)
            p = _softmax((sums / np.maximum(grams, 1)[:, None] + bias) / t)
            best = np.where(np.asarray(batch.column(1)), p.argmax(1) if len(p) else np.zeros(0, int), len(languages))
            score = np.where(best < len(languages), p.max(1) if len(p) else np.zeros(0), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), names.take(pa.array(best, pa.int64())), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return texts.mapInArrow(predicted, "doc_id long, lang_pred string, score double")


def languages(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return predict(docs, train(docs)).select("doc_id", held.alias("held_out"), "lang_pred", "score")
