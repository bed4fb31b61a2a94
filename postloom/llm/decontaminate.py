"""Benchmark decontamination: q-gram lemma filtering in overlapping diagonal bands, then banded alignment.

A benchmark item of m characters is found in a document where some stretch of the text is within the edit budget
k = floor(rate * m) of the whole item. Such a stretch shares at least t = m + 1 - q - k * q of the item's character
q-grams, all on diagonals (place in text less place in item) at most k apart. With s the power of two above k, bands of
s + k diagonals start at every s-th diagonal, so that one band holds them all; bands with fewer than t shared q-grams
are dropped, and the regions of the others are verified by a banded alignment. Case and the kind of white space do not count (one character for one).

The items' q-grams are broadcast in chunks of bounded size, one pass over the documents each; a document is looked at
in pieces that overlap by the longest region.

Items of fewer than min_chars characters have a budget of 0 and are looked for as they are, between word borders (an item
of "and" is no hit within "hand"); for them windows of their lengths are hashed in place of q-grams.

Edge cases: null and empty texts match nothing, and null, empty and blank items are in no text. Where t would be under 1,
the budget is the largest with t of 1. Rows with a null doc_id are matched like others, and items with a null item_id are
found under a null id. Rows that repeat an item_id count for that id, each with its text. Of copies of one item that
overlap in a text, the one with the fewest edits is given. Rows that repeat a doc_id are each looked at. Extra columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm.common import small_batches, union
from postloom.llm.kernels import folded, ngrams

Q = 7  # with a rate of 0.1, t is 1 or more for every item of 24 characters or more
RATE = 0.1
MIN_CHARS = 24
CHUNK_CHARS = 8 << 20  # bound of the item characters broadcast at a time
SLICE_CHARS = 1 << 17  # small enough for a core's cache
FILTER_BITS = 22
DENSE = 1 << 22  # counters kept as an array up to so many


def characters(text: str) -> np.ndarray:
    """Code points, with case and white space folded one for one."""
    return folded(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32))


def qgrams(cp: np.ndarray) -> np.ndarray:
    """A 64-bit word for the 7 characters from each place on (8 bits of each; equal q-grams are equal words)."""
    if len(cp) < Q:
        return np.zeros(0, np.uint64)
    b = np.append((cp ^ (cp >> np.uint32(8))).astype(np.uint8), np.uint8(0))
    two = b[:-1].astype(np.uint16) | (b[1:].astype(np.uint16) << np.uint16(8))
    four = two[:-2].astype(np.uint32) | (two[2:].astype(np.uint32) << np.uint32(16))
    return (four[:-4].astype(np.uint64) | (four[4:].astype(np.uint64) << np.uint64(32))) & np.uint64((1 << 8 * Q) - 1)


def _windows(cp: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of n characters."""
    return ngrams(cp.astype(np.uint64) + np.uint64(1), n)


def max_length(items: list[tuple[int | None, np.ndarray]]) -> int:
    return max((len(c) for _, c in items), default=0)


class ItemIndex:
    """The q-grams of benchmark items with their places, and a bit filter before them."""

    def __init__(self, ids: list[int], texts: list[str], rate: float, min_chars: int):
        every = [(i, characters(t)) for i, t in zip(ids, texts, strict=True) if t is not None]
        kept = [(i, c) for i, c in every if len(c) >= max(min_chars, Q)]
        brief = [(i, c) for i, c in every if len(c) < max(min_chars, Q) and (c != 32).any()]
        self.names: list[int | None] = [i for i, _ in kept] + [i for i, _ in brief]
        self.brief: dict[int, dict[int, list[tuple[int, np.ndarray]]]] = {}  # length, hash of a window, items
        for k, (_, c) in enumerate(brief, len(kept)):
            self.brief.setdefault(len(c), {}).setdefault(int(_windows(c, len(c))[0]), []).append((k, c))
        self.items = [c for _, c in kept]
        m = np.array([len(c) for c in self.items], np.int64)
        self.budget = np.minimum(np.floor(rate * m).astype(np.int64), (m - Q) // Q)
        self.least = m + 1 - Q - self.budget * Q
        self.shift = np.array([int(k).bit_length() for k in self.budget], np.int64)  # log2 of the diagonals between bands
        self.longest = max(int((m + 2 * self.budget + (2 << self.shift)).max(initial=0)), max_length(brief) + 2)
        grams = [qgrams(c) for c in self.items]
        flat = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.grams, flat = np.unique(flat), flat[order]
        self.first = np.searchsorted(flat, self.grams)
        self.count = np.diff(np.append(self.first, len(flat)))
        self.item, self.place = item[order], place[order]
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self._slot(self.grams)] = True

    @staticmethod
    def _slot(grams: np.ndarray) -> np.ndarray:
        return ((grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)

    def regions(self, cp: np.ndarray) -> list[tuple[int, int]]:
        """(item, band) pairs of a piece of text that share at least the item's least number of q-grams."""
        grams = qgrams(cp)
        at = np.flatnonzero(self.filter[self._slot(grams)])
        if not len(at) or not len(self.grams):
            return []
        found = np.minimum(np.searchsorted(self.grams, grams[at]), len(self.grams) - 1)
        same = self.grams[found] == grams[at]
        at, found = at[same], found[same]
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        bands = ((len(cp) + self.longest) >> self.shift) + 4
        base = np.cumsum(bands) - bands
        dense = np.zeros(int(bands.sum()), np.int64) if bands.sum() <= DENSE else None
        ends = np.cumsum(self.count[found])
        done = 0
        while done < len(at):  # a bounded number of hits at a time
            upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + (1 << 21), "right")))
            a, f = at[done:upto], found[done:upto]
            n = self.count[f]
            entry = np.repeat(self.first[f] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            item = self.item[entry]
            diagonal = np.repeat(a, n) - self.place[entry] + self.longest
            shift = self.shift[item]
            band = diagonal >> shift
            also = diagonal - (band << shift) < self.budget[item]  # is in the band before it too
            band += base[item]
            key = np.concatenate([band, band[also] - 1])
            if dense is not None:
                dense += np.bincount(key, minlength=len(dense))
            else:
                k, c = np.unique(key, return_counts=True)
                keys, back = np.unique(np.concatenate([keys, k]), return_inverse=True)
                counts = np.bincount(back, np.concatenate([counts, c])).astype(np.int64)
            done = upto
        if dense is not None:
            keys = np.flatnonzero(dense)
            counts = dense[keys]
        item = np.searchsorted(base, keys, "right") - 1
        keep = counts >= self.least[item]
        return list(zip(item[keep].tolist(), (keys[keep] - base[item[keep]]).tolist(), strict=True))

    def exact(self, text: np.ndarray, whole: bool) -> list[tuple[int, int, int]]:
        """(item, start, end) of the brief items that stand between word borders of a piece of text; a piece that goes on
        (not whole) is not looked at in its last character."""
        if not self.brief or not len(text):
            return []
        word = _letter_or_digit(text)
        inner = np.zeros(len(text) + 1, bool)  # between two characters of a word
        inner[1:-1] = word[1:] & word[:-1]
        out = []
        for n, items in self.brief.items():
            hashes = _windows(text, n)
            for at in np.flatnonzero(np.isin(hashes, np.fromiter(items, np.uint64, len(items)))).tolist():
                if inner[at] or inner[at + n] or (not whole and at + n == len(text)):
                    continue
                out += [(k, at, at + n) for k, c in items[int(hashes[at])] if (text[at : at + n] == c).all()]
        return out

    def matches(self, pieces: list[np.ndarray]) -> list[tuple[int, int, int, int, int]]:
        """(piece, item, start, end, edits) of the verified stretches of pieces of text: the pieces are filtered laid end
        to end, and every piece that a kept band touches is aligned within the band."""
        gap = np.zeros(Q, np.uint32)
        joined = np.concatenate([x for c in pieces for x in (c, gap)])
        starts = np.cumsum([0] + [len(c) + Q for c in pieces])
        out = []
        for item, band in self.regions(joined):
            k, pattern = int(self.budget[item]), self.items[item]
            step = 1 << int(self.shift[item])
            low = band * step - self.longest - k
            high = low + step + 3 * k + len(pattern)
            for g in range(max(0, int(np.searchsorted(starts, low, "right")) - 1), min(len(pieces), int(np.searchsorted(starts, high, "left")))):
                begin = max(0, low - int(starts[g]))
                text = pieces[g][begin : max(0, high - int(starts[g]))]
                if len(text) >= len(pattern) - k and (hit := align(pattern, text, k)):
                    out.append((g, item, begin + hit[0], begin + hit[1], hit[2]))
        return out


def _letter_or_digit(cp: np.ndarray) -> np.ndarray:
    """Which code points belong to words; all beyond the table do."""
    return (cp >= len(_WORD)) | _WORD[np.minimum(cp, len(_WORD) - 1)]


_WORD = np.array([chr(c).isalnum() for c in range(0x3000)])


def _apart(hits: set[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Of stretches (row, item, start, end, edits) of an item that overlap in a row, the one with the fewest edits."""
    out, taken = [], {}
    for row, item, s, e, edits in sorted(hits, key=lambda x: (x[0], x[1], x[4], x[2])):
        held = taken.setdefault((row, item), [])
        if all(e <= a or s >= b for a, b in held):
            held.append((s, e))
            out.append((row, item, s, e, edits))
    return out


def _ends(pattern: list[int], text: list[int], anchored: bool) -> list[int]:
    """Edit distance of the pattern to the stretch of text that ends after each character (and starts anywhere, or with
    the text where anchored). A column of the alignment is a pair of bit vectors (Myers 1999, Hyyro 2003), so that the
    region of a band costs one step a character."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    places: dict[int, int] = {}
    for i, c in enumerate(pattern):
        places[c] = places.get(c, 0) | 1 << i
    up, down, score, first = full, 0, m, int(anchored)
    out = []
    for c in text:
        same = places.get(c, 0)
        vertical = same | down
        across = (((same & up) + up) ^ up) | same
        plus = down | (~(across | up) & full)
        minus = up & across
        score += bool(plus & top) - bool(minus & top)
        plus = ((plus << 1) | first) & full
        minus = (minus << 1) & full
        up = minus | (~(vertical | plus) & full)
        down = plus & vertical
        out.append(score)
    return out


def align(pattern: np.ndarray, text: np.ndarray, k: int) -> tuple[int, int, int] | None:
    """Start, end and edits of the stretch of text nearest to the pattern, if at most k edits away."""
    p, t = pattern.astype(np.uint32).tobytes(), text.astype(np.uint32).tobytes()
    at = t.find(p)
    while at >= 0 and at % 4:
        at = t.find(p, at + 1)
    if at >= 0:
        return at // 4, at // 4 + len(pattern), 0
    if not k or not len(text):
        return None
    wanted, held = pattern.tolist(), text.tolist()
    ends = _ends(wanted, held, False)
    edits = min(ends)
    if edits > k:
        return None
    end = ends.index(edits) + 1
    back = _ends(wanted[::-1], held[max(0, end - len(wanted) - k) : end][::-1], True)
    return end - 1 - back.index(min(back)), end, edits


def _chunks(benchmark: DataFrame) -> list[DataFrame]:
    chars = int(benchmark.agg(F.coalesce(F.sum(F.length("text") + 64), F.lit(0))).first()[0])
    n = max(1, -(-chars // CHUNK_CHARS))
    return [benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == c) for c in range(n)]


def find_items(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, min_chars: int = MIN_CHARS) -> DataFrame:
    """Rows (doc_id, item_id, start, end, edits): every place where a document (doc_id, text) holds a benchmark item
    (item_id, text); code points, end exclusive."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text <> ''")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return union([_matches(texts, chunk, rate, min_chars) for chunk in _chunks(items)])


def _matches(texts: DataFrame, items: DataFrame, rate: float, min_chars: int) -> DataFrame:
    rows = items.toArrow().to_pydict()
    shared = texts.sparkSession.sparkContext.broadcast(ItemIndex(rows["item_id"], rows["text"], rate, min_chars))

    def match(batches):
        index = shared.value
        for batch in batches:
            out: set[tuple[int, int, int, int, int]] = set()
            group: list[tuple[int, int, np.ndarray, bool]] = []
            size = 0

            def flush():
                nonlocal group, size
                for g, item, start, end, edits in index.matches([c for _, _, c, _ in group]):
                    row, shift, *_ = group[g]
                    out.add((row, item, shift + start, shift + end, edits))
                for row, shift, c, last in group:
                    # an item that begins with a piece may begin within a word; the piece before holds it too
                    out.update((row, item, shift + s, shift + e, 0) for item, s, e in index.exact(c, last) if s or not shift)
                group, size = [], 0

            for row, text in enumerate(batch.column(1)):
                c = characters(text.as_py())
                step = SLICE_CHARS
                for shift in range(0, max(1, len(c) - index.longest) if len(c) > step else 1, step):
                    piece = c[shift : shift + step + 2 * index.longest] if len(c) > step else c
                    group.append((row, shift, piece, shift + len(piece) == len(c)))
                    size += len(group[-1][2])
                    if size >= SLICE_CHARS:
                        flush()
            if group:
                flush()
            found = _apart(out)
            doc = batch.column(0).take(pa.array([x[0] for x in found], pa.int64()))
            yield pa.RecordBatch.from_arrays([doc, pa.array([index.names[x[1]] for x in found], pa.int64()), *(pa.array([x[k] for x in found], pa.int64()) for k in (2, 3, 4))], ["doc_id", "item_id", "start", "end", "edits"])

    return texts.mapInArrow(match, "doc_id long, item_id long, start long, end long, edits long")


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The doc_ids of documents that hold a benchmark item."""
    return find_items(docs, benchmark, rate).select("doc_id").distinct()

