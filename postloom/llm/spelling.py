"""Spelling variant grouping: a rare-first prefix filter over positional bigrams, then verification.

Words are counted over whole texts. A word of n code points has n - 1 bigrams with their positions; one edit spoils at most
two of them and moves the others by at most one place. So two words that are one edit apart share one of the three bigrams
of each that come first when bigrams are ordered by their frequency among the words, rare ones first, and equal ones by
position. Only those three are joined, with what one edit allows as further parts of the key: the words' lengths, the
position (the same, or one further on in the longer word) and the half of the word that the edit has not touched. Pairs that
meet are verified by edit distance.

Sizes: there are at most 90 * 90 bigrams, so that their frequencies are broadcast; words are dealt out by key, each some
18 short rows; no pair is made that does not share a rare bigram and a half.

Edge cases: null and empty texts have no words. A null doc_id is written as an empty one in the hashed string. Equal rows
count each. Runs of any length are taken whole. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm import kernels as K
from postloom.llm.common import small_batches, stored
from postloom.llm.suffix_counts import packed_runs

SHORTEST = 6
LEAST = 5
RARE = 3
TIMES = 5
EVERY = 199
_LETTERS = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_GAPS = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])
_PART_BYTES = 4 << 20
_LEAD = 0xC3  # the first of the two bytes of U+00C0 to U+00FF
_LONG = 64


def _crc_table() -> np.ndarray:
    """One step of CRC-32 for each byte."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()


def crc32s(data: np.ndarray, offsets: np.ndarray, begun: np.ndarray) -> np.ndarray:
    """CRC-32 of each string, each going on from a CRC of what stands before it."""
    lengths = np.diff(offsets)
    state = begun.astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    order = np.argsort(-lengths, kind="stable")
    order = order[int((lengths > _LONG).sum()) :]
    left = lengths[order]
    for k in range(int(left.max(initial=0))):
        now = order[: int(np.searchsorted(-left, -k, "left"))]
        state[now] = _CRC[(state[now] ^ data[offsets[now] + k]) & 255] ^ (state[now] >> np.uint32(8))
    state ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(lengths > _LONG).tolist():
        state[i] = zlib.crc32(data[offsets[i] : offsets[i + 1]], int(begun[i]))
    return state


def _counted(ids: list, data: np.ndarray, offsets: np.ndarray, every: int, shortest: int) -> pa.RecordBatch:
    """The words of some texts with their number."""
    letters = _LETTERS[data]
    lead = data == _LEAD
    letters |= lead
    letters[1:] |= lead[:-1]
    if not letters.any():
        return pa.RecordBatch.from_arrays([pa.array([], pa.string()), pa.array([], pa.int64())], ["word", "n"])
    starts, runs = packed_runs(_FOLD[data], offsets, letters)
    packed, ends, _ = K.binary(runs)
    rows = np.searchsorted(offsets, starts, "right") - 1
    begun = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
    h = crc32s(packed, ends, begun[rows])
    before = np.append(0, np.cumsum(packed == _LEAD))
    length = np.diff(ends) - (before[ends[1:]] - before[ends[:-1]])
    hit = h % np.uint32(every) == 0
    texts = [runs.filter(pa.array(~hit & (length >= shortest)))]
    cut = []
    for i in np.flatnonzero(hit & (length > shortest)).tolist():
        run, at = runs[i].as_py(), int(h[i]) % int(length[i])
        cut.append(run[:at] + run[at + 1 :])
    texts.append(pa.array(cut, pa.string()))
    coded = pa.concat_arrays(texts).dictionary_encode()
    counts = np.bincount(np.asarray(coded.indices), minlength=len(coded.dictionary))
    return pa.RecordBatch.from_arrays([coded.dictionary, pa.array(counts.astype(np.int64))], ["word", "n"])


def _parts(batch: pa.RecordBatch):
    """The ids, bytes and offsets of rows of some _PART_BYTES together; a longer text is cut where no letter is."""
    ids = batch.column(0).to_pylist()
    data, offsets, _ = K.binary(batch.column(1))
    for i, j in K.row_slices(offsets, _PART_BYTES):
        part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        if j == i + 1:
            for _, piece, ends in K.word_pieces(part, own, _GAPS):
                yield ids[i:j], piece, ends
        elif len(part):
            yield ids[i:j], part, own


def vocabulary(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, every: int = EVERY) -> DataFrame:
    """Rows (word, n): runs [A-Za-z\\u00C0-\\u00FF]+ with A-Z lower-cased, of at least `shortest` code points and with at
    least `least` occurrences. Where `every` divides h, the CRC-32 of `<doc_id>:<run>`, code point h % length is deleted."""
    small_batches(docs.sparkSession)

    def counted(batches):
        for batch in batches:
            for ids, data, offsets in _parts(batch):
                yield _counted(ids, data, offsets, every, shortest)

    parts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(counted, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _latin(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of words, all below 256, and where each word's begin."""
    data, offsets, _ = K.binary(words)
    points, begins = K.code_points(data[offsets[0] : offsets[-1]], offsets - offsets[0])
    return points.astype(np.uint8), begins


def _bigrams(points: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code of each bigram of each word and the place of its first code point."""
    inside = np.ones(len(points), bool)
    inside[begins[1:][np.diff(begins) > 0] - 1] = False
    at = np.flatnonzero(inside)
    return points[at].astype(np.int64) * 256 + points[np.minimum(at + 1, len(points) - 1)], at


def _bigram_order(words: DataFrame) -> np.ndarray:
    """The rank of each bigram by its number among the words, rare ones first (at most 90 * 90 occur)."""

    def counted(batches):
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            total += np.bincount(_bigrams(*_latin(batch.column(0)))[0], minlength=1 << 16)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["gram", "n"])

    rows = words.select("word").mapInArrow(counted, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    rank = np.zeros(1 << 16, np.int64)
    for k, r in enumerate(sorted(rows, key=lambda r: (r["n"], r["gram"]))):
        rank[r["gram"]] = k
    return rank


def _half_keys(points: np.ndarray, begins: np.ndarray, word: np.ndarray, gram: np.ndarray, place: np.ndarray, base: np.ndarray, side: int) -> np.ndarray:
    """64-bit keys of a bigram, its place, the shorter word's length and one half of a word: its first base // 2 code
    points, or its last base - base // 2."""
    half = base // 2
    if side:
        ends = begins[word + 1]
        text = K.span_hashes(points, ends - (base - half), ends)
    else:
        text = K.span_hashes(points, begins[word], begins[word] + half)
    with np.errstate(over="ignore"):
        return K.mix(text * np.uint64(0x9E3779B97F4A7C15) + ((gram * 2 + side).astype(np.uint64) << np.uint64(32)) + (place * 131_071 + base).astype(np.uint64), 5)


def _meeting(words: DataFrame, rank: np.ndarray, rare: int, longer: bool) -> DataFrame:
    """The rows (key, word, n) by which words meet: as the longer of two words, or else as one of equal length or the
    shorter."""
    shared = words.sparkSession.sparkContext.broadcast(rank)

    def keyed(batches):
        rank = shared.value
        for batch in batches:
            points, begins = _latin(batch.column(0))
            codes, at = _bigrams(points, begins)
            owner = np.searchsorted(begins, at, "right") - 1
            order = np.lexsort((at, rank[codes], owner))
            first = np.searchsorted(owner[order], np.arange(len(begins) - 1))
            chosen = order[np.arange(len(order)) - first[owner[order]] < rare]
            word, gram, place = owner[chosen], codes[chosen], at[chosen] - begins[owner[chosen]]
            length = np.diff(begins)[word]
            keys, owners = [], []
            for side in (0, 1):
                for back in (0, 1) if longer else (0,):
                    keys.append(_half_keys(points, begins, word, gram, place - back, length - 1 if longer else length, side))
                    owners.append(word)
            rows = pa.array(np.concatenate(owners))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), batch.column(0).take(rows), batch.column(1).take(rows)], ["key", "word", "n"])

    return words.select("word", "n").mapInArrow(keyed, "key long, word string, n long")


def near_pairs(words: DataFrame, rare: int = RARE) -> DataFrame:
    """Pairs of words (word, n, near, near_n), each in both directions, that one inserted, deleted or replaced code point
    makes equal. words: distinct words of at least 6 code points from U+0000 to U+00FF."""
    rank = _bigram_order(words)
    short, long = _meeting(words, rank, rare, False), _meeting(words, rank, rare, True)
    other = short.withColumn("same", F.lit(True)).union(long.withColumn("same", F.lit(False))).select("key", F.col("word").alias("near"), F.col("n").alias("near_n"), "same")
    close = F.levenshtein(F.col("word"), F.col("near"), 1) == 1
    pairs = short.join(other, "key").where((~F.col("same") | (F.col("word") < F.col("near"))) & close).select("word", "n", "near", "near_n").distinct()
    pairs = stored(pairs)
    return pairs.union(pairs.select("near", "near_n", "word", "n"))


def _roots(forms: DataFrame) -> DataFrame:
    """The last word that following forms (word, form) reaches, by doubling: rows (word, root)."""
    reach = forms.select("word", F.col("form").alias("root"))
    while True:
        further = reach.select(F.col("word").alias("root"), F.col("root").alias("further"))
        reach = stored(reach.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if reach.where("moved").isEmpty():
            return reach.select("word", "root")
        reach = reach.select("word", "root")


def variants(docs: DataFrame, times: int = TIMES) -> DataFrame:
    """One row for each word of vocabulary(): word, form (its near word of largest n, ties to the smallest in code-point
    order, if that n is at least `times` the word's; else null), root (where following forms ends), n, n_near, form_n."""
    words = stored(vocabulary(docs))
    best = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    rows = words.join(best, "word", "left")
    found = F.coalesce(-F.col("best.less") >= times * F.col("n"), F.lit(False))
    rows = stored(rows.select("word", F.when(found, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(found, -F.col("best.less")).alias("form_n")))
    roots = _roots(rows.where("form IS NOT NULL"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
