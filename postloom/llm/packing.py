"""Best-fit packing of tokenized documents into sequences: pattern packing by non-negative least squares.

1. Every document becomes its token ids and a closing id 0; longer ones than a sequence are cut into whole sequences, of
   which the first piece may be shorter. Lengths are counted (the histogram has at most `capacity` rows).
2. All patterns of two or three lengths that fill a sequence exactly are enumerated (some capacity ** 2 / 12 at most), and
   their repeat counts are fitted to the histogram by non-negative least squares, long pieces weighing more, until no
   count would change by more than TOLERANCE. The counts are rounded to what the histogram has; the residual pieces are
   packed by best fit, longest first, a whole count of a length at a time.
3. The plan is a list of patterns with repeat counts, whose size does not grow with the data. Pieces are ranked within
   their length (by a window over bounded groups), and the rank gives sequence and offset.

Texts with white space of LONG_GAP characters or more on end go through the tokenizer itself, as its fast equal has no room
for them. Edge cases: null and empty texts are one piece of length 1 (the closing id). Null ids and repeated rows are packed like
others. A special token's string in a text is that token, as the tokenizer has it. Extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postloom.llm.common import small_batches, stored

CAPACITY = 2048
END = 0
STEPS = 1 << 13  # of the fit: patterns updated between two looks at all of them
TOLERANCE, RELATIVE = 0.1, 1e-4  # the fit ends where no repeat count would change by more, or by that part of the longest
GROUP = 256  # pieces of a length that are ranked together, at least
GROUPS = 20_000  # and into so many groups at most
LONG_GAP = 10_000
_GAP = re.compile(r"(?<!\s)\s{%d}" % LONG_GAP)  # tried once a run of white space
_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Vocabulary:
    """Byte-level BPE ids from a tokenizer file. Plain texts go through tiktoken, which merges by the same ranks some
    times faster; texts with a special token's string through the tokenizer itself."""

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN

        self.path = path
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.special = [t["content"] for t in model.get("added_tokens", [])]
        # the bytes that stand for themselves in a byte-level vocabulary; the others have the characters from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in self.special}
        self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def tokenizer(self):
        """The tokenizer itself, loaded where a text needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def ids(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special) or _GAP.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode_ordinary(text), np.uint32)


_held: dict[str, Vocabulary] = {}


def _vocabulary(path: str) -> Vocabulary:
    if path not in _held:
        _held[path] = Vocabulary(path)
    return _held[path]


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    first = (length - 1) % capacity + 1
    return [(0, first)] + [(s, capacity) for s in range(first, length, capacity)]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32) of the documents (doc_id, text)."""

    small_batches(docs.sparkSession)

    def tokenized(batches):
        vocabulary = _vocabulary(tokenizer)
        for batch in batches:
            rows, out = [], []
            for row, text in enumerate(batch.column(1)):
                ids = np.append(vocabulary.ids(text.as_py()), np.uint32(END)).astype("<u4")
                for k, (start, n) in enumerate(cut(len(ids), capacity)):
                    rows.append(row)
                    out.append((k, start, n, zlib.crc32(ids[start : start + n].tobytes())))
            table = np.array(out, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(table[:, 0].astype(np.int32)), *(pa.array(table[:, c]) for c in (1, 2, 3))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(tokenized, _SCHEMA)


def full_patterns(lengths: list[int], capacity: int) -> np.ndarray:
    """All rows of two or three of the lengths (descending, 0 where there is no third) that sum to the capacity; the ones
    with the longest piece first."""
    have = np.zeros(capacity + 1, bool)
    have[lengths] = True
    have[capacity] = False
    at = np.flatnonzero(have)
    found = [np.zeros((0, 3), np.int32)]
    for c in [0, *at.tolist()]:  # the shortest piece of the pattern
        b = at[(at >= c) & (2 * at <= capacity - c)]
        a = capacity - c - b
        keep = have[a]
        found.append(np.stack([a[keep], b[keep], np.full(keep.sum(), c)], 1).astype(np.int32))
    out = np.concatenate(found)
    return out[np.lexsort((out[:, 1], -out[:, 0]))]


def fitted(histogram: dict[int, int], patterns: np.ndarray) -> np.ndarray:
    """Repeat counts x >= 0 of the least weighted squares |histogram - sum of x * pattern|, by coordinate descent: the
    patterns that would change most are updated one by one, then all are looked at again, until none would change by more
    than TOLERANCE or RELATIVE times the histogram's highest count. A length weighs as much as it is long."""
    rest = np.zeros(int(patterns.max(initial=0)) + 1)
    for v, n in histogram.items():
        if v < len(rest):
            rest[v] = n
    rest[0] = 0
    least = max(TOLERANCE, RELATIVE * rest.max(initial=0))
    weight = patterns.astype(float)
    a, b, c = patterns.T
    size = weight.sum(1) + np.where(a == b, 2 * a, 0) + np.where((b == c) & (c > 0), 2 * b, 0) + np.where((a == c) & (c > 0), 2 * a, 0)
    x = np.zeros(len(patterns))
    while True:
        change = np.maximum((weight * rest[patterns]).sum(1) / size, -x)
        off = np.flatnonzero(np.abs(change) > least)
        if not len(off):
            return x
        if len(off) > STEPS:
            off = off[np.argpartition(-np.abs(change[off]), STEPS)[:STEPS]]
        off = np.sort(off)
        for k, p, s in zip(off.tolist(), patterns[off].tolist(), size[off].tolist(), strict=True):
            p = p if p[2] else p[:2]
            step = sum(v * rest[v] for v in p) / s
            step = max(step, -x[k])
            x[k] += step
            for v in p:
                rest[v] -= step


def rounded(histogram: dict[int, int], patterns: np.ndarray, counts: np.ndarray) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Whole repeat counts that the histogram can serve, most frequent pattern first, and what it has left. A count under
    one that is likelier than not to be one serves one."""
    left = dict(histogram)
    used = []
    some = np.flatnonzero(counts > 0.25)
    for k in some[np.argsort(-counts[some], kind="stable")].tolist():
        p = tuple(v for v in patterns[k].tolist()[::-1] if v)
        n = min(max(1, round(counts[k])), *(left[v] // p.count(v) for v in set(p)))
        if n > 0:
            used.append((p, n))
            for v in p:
                left[v] -= n
    return used, {v: c for v, c in left.items() if c}


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns with counts that hold all pieces: longest first, each into the fullest open sequences that have room."""
    gaps: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            gap = min((g for g, held in gaps.items() if g >= length and held), default=None)
            if gap is None:
                n = left // (capacity // length) or 1
                m = min(left, capacity // length)
                gaps[capacity - m * length].append(((length,) * m, n))
                left -= n * m
                continue
            pattern, count = gaps[gap].pop()
            m = min(gap // length, left)
            n = min(count, left // m)
            gaps[gap - m * length].append((pattern + (length,) * m, n))
            if count > n:
                gaps[gap].append((pattern, count - n))
            left -= n * m
    return [x for held in gaps.values() for x in held]


@dataclass(frozen=True)
class Plan:
    """Where the pieces of each length go, by their rank: parallel arrays in order of (length, first rank)."""

    length: np.ndarray
    rank: np.ndarray
    each: np.ndarray  # pieces of the length in one sequence
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces."""
        begin = np.searchsorted(self.length, length)
        end = np.searchsorted(self.length, length, "right")
        while (wide := end - begin > 1).any():  # the last entry of the length that starts at the rank or before
            middle = (begin + end) // 2
            low = self.rank[np.minimum(middle, len(self.rank) - 1)] <= rank
            begin, end = np.where(wide & low, middle, begin), np.where(wide & ~low, middle, end)
        nth = rank - self.rank[begin]
        return self.sequence[begin] + nth // self.each[begin], self.offset[begin] + nth % self.each[begin] * length


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """A plan for pieces of 1 to capacity tokens, counted by length."""
    short = {k: v for k, v in histogram.items() if k < capacity and v}
    patterns = full_patterns(sorted(short), capacity)
    used, left = rounded(short, patterns, fitted(short, patterns))
    used += best_fit(left, capacity)
    if histogram.get(capacity):
        used.append(((capacity,), histogram[capacity]))
    rows, ranks, sequence = [], defaultdict(int), 0
    for pattern, count in used:
        offset = 0
        for v in sorted(set(pattern), reverse=True):
            m = pattern.count(v)
            rows.append((v, ranks[v], m, sequence, offset))
            ranks[v] += count * m
            offset += m * v
        sequence += count
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return Plan(*(table[:, c] for c in range(5)), sequence)


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset) of the documents (doc_id, text)."""
    # the numbering deals equal rows out to different groups; it is part of the stored table and so does not change
    cuts = stored(pieces(docs, tokenizer, capacity).withColumn("number", F.monotonically_increasing_id()))
    counted = cuts.groupBy("length").count().toArrow()
    histogram = dict(zip(counted["length"].to_pylist(), counted["count"].to_pylist(), strict=True))
    shared = docs.sparkSession.sparkContext.broadcast(plan(histogram, capacity))
    groups = docs.sparkSession.createDataFrame([(v, max(1, min(GROUPS, c // GROUP))) for v, c in sorted(histogram.items())], "length long, groups long")
    dealt = cuts.join(F.broadcast(groups), "length").withColumn("part", F.pmod(F.xxhash64("number"), F.col("groups"))).drop("groups")
    sizes = dealt.groupBy("length", "part").count()
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    nth = F.row_number().over(Window.partitionBy("length", "part").orderBy("number")) - 1
    ranked = dealt.withColumn("nth", nth).join(starts, ["length", "part"]).withColumn("rank", F.col("base") + F.col("nth"))

    def placed(batches):
        for batch in batches:
            sequence, offset = shared.value.place(np.asarray(batch.column("length")), np.asarray(batch.column("rank")))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(placed, f"{_SCHEMA}, sequence_id long, offset long")
