"""Word-id suffix arrays of shards of text, and the n-gram counts that their LCP intervals give."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_PIECE_ENDS = np.zeros(256, bool)
_PIECE_ENDS[[ord(c) for c in ".,;:!?\n\v\f\r"]] = True
_GAPS = _PIECE_ENDS.copy()
_GAPS[[0x20, 0x09]] = True


def packed_runs(data: np.ndarray, offsets: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, pa.StringArray]:
    """The maximal runs of kept bytes of rows laid end to end: where they start, and the runs as strings."""
    first = keep.copy()
    first[1:] &= ~keep[:-1]
    rows = offsets[:-1][np.diff(offsets) > 0]
    first[rows] = keep[rows]
    packed = data[keep]
    ends = np.append(np.flatnonzero(first[keep]), len(packed)).astype(np.int32)
    return np.flatnonzero(first), pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(packed))


class Shard:
    """The words of some texts as ids from 1 (0 stands after the last word of each piece). Words that start at or after
    `own` bytes belong to the next slice of a long text and only lengthen n-grams that start before."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, own: int | None = None):
        data = _FOLD[data]
        starts, runs = packed_runs(data, offsets, ~_GAPS[data])
        coded = runs.dictionary_encode()
        self.words = coded.dictionary
        piece = np.searchsorted(np.flatnonzero(_PIECE_ENDS[data]), starts) + np.searchsorted(offsets, starts, "right")
        last = np.append(piece[1:] != piece[:-1], True) if len(piece) else np.zeros(0, bool)
        place = np.arange(len(starts)) + np.append(0, np.cumsum(last)[:-1]) if len(starts) else np.zeros(0, np.int64)
        self.ids = np.zeros(len(starts) + int(last.sum()), np.int64)
        self.ids[place] = np.asarray(coded.indices) + 1
        self.mine = np.zeros(len(self.ids), bool)
        self.mine[place] = starts < (len(data) if own is None else own)

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.ids[self.mine], minlength=len(self.words) + 1)[1:]

    def keep_words(self, kept: np.ndarray) -> None:
        """Ends pieces at words that are not kept (one flag for each of self.words)."""
        self.ids[~np.append(False, kept)[self.ids]] = 0

    def texts(self, places: np.ndarray, n: int) -> pa.StringArray:
        """The n words from each place on, joined by a space."""
        import pyarrow.compute as pc

        parts = [self.words.take(pa.array(self.ids[places + k] - 1)) for k in range(n)]
        return pc.binary_join_element_wise(*parts, " ") if n > 1 else parts[0]


def shifted(x: np.ndarray, by: int) -> np.ndarray:
    """x from `by` places on, 0 after its end."""
    out = np.zeros_like(x)
    if by < len(x):
        out[: len(x) - by] = x[by:]
    return out


def suffix_array(ids: np.ndarray, depth: int | None = None, places: np.ndarray | None = None) -> np.ndarray:
    """The suffixes' places (all, or those given) in the order of their first `depth` ids (of all of them, if None), by
    prefix doubling: ranks by the first h ids and those of the places h further on are keys for ranks by 2h."""
    rank, h = ids.astype(np.int64), 1
    while (h < depth if depth else h < 2 * len(ids)):
        key = rank * (int(rank.max(initial=0)) + 2) + np.append(rank[h:] + 1, np.zeros(min(h, len(rank)), np.int64))
        if depth and 2 * h >= depth:  # these keys order as far as is asked: no ranks are needed
            rank = key
            break
        distinct, rank = np.unique(key, return_inverse=True)
        if len(distinct) == len(ids):
            break
        h *= 2
    places = np.arange(len(ids)) if places is None else places
    return places[np.argsort(rank[places], kind="stable")]


def common_prefixes(ids: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """How many ids, up to depth, each suffix shares with the one before it in order (0 for the first)."""
    out = np.zeros(len(order), np.int64)
    same = np.ones(max(0, len(order) - 1), bool)
    for k in range(depth):
        inside = np.maximum(order[1:], order[:-1]) + k < len(ids)
        step = np.minimum(order + k, len(ids) - 1)
        same &= inside & (ids[step[1:]] == ids[step[:-1]])
        out[1:] += same
    return out


def ngram_counts(shard: Shard, low: int, high: int, lengths: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each n from low to high: n, a place of each distinct n-gram and its count. lengths: how many words each place's
    n-gram may have at most. The n-grams are the LCP intervals of depth n of the suffix array."""
    places = np.flatnonzero(lengths >= low)
    if not len(places):
        return
    order = suffix_array(shard.ids, high, places)
    shared = common_prefixes(shard.ids, order, high)
    for n in range(low, high + 1):
        heads = np.flatnonzero(shared < n)
        held = (shard.mine[order] & (lengths[order] >= n)).astype(np.int64)
        counts = np.add.reduceat(held, heads)
        some = counts > 0
        # of an interval whose suffixes differ in what they may hold, none holds n words or all do: they share n words
        yield n, order[heads[some]], counts[some]


def run_lengths(good: np.ndarray, most: int) -> np.ndarray:
    """How many places in a row, up to most, are good from each place on."""
    out = np.zeros(len(good), np.int64)
    run = np.ones(len(good), bool)
    for k in range(most):
        run &= shifted(good, k)
        out += run
    return out


def text_shards(batches, limit: int, overlap: int) -> Iterator[tuple[str, Shard]]:
    """(lang, shard) of Arrow batches of (lang, text): texts of some `limit` bytes together, by language. A text longer
    than that is cut between words into slices, each of which sees the `overlap` words after it."""
    held: dict[str, list[np.ndarray]] = {}
    size = 0
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        names, text = langs.dictionary.to_pylist(), batch.column(1).cast(pa.large_binary())
        codes = np.asarray(langs.indices)
        for row in np.flatnonzero(np.asarray(text.is_valid())).tolist():
            one = np.frombuffer(text[row].as_buffer(), np.uint8)
            if len(one) > limit:
                for a, own, b in _slices(one, limit, overlap):
                    yield names[codes[row]], Shard(one[a:b], np.array([0, b - a]), own - a)
            elif len(one):
                held.setdefault(names[codes[row]], []).append(one.copy())
                size += len(one)
        if size >= limit:
            full, held, size = held, {}, 0
            yield from _shards(full)
            pa.default_memory_pool().release_unused()
    yield from _shards(held)


def _shards(held: dict[str, list[np.ndarray]]) -> Iterator[tuple[str, Shard]]:
    while held:
        lang, texts = held.popitem()
        yield lang, Shard(np.concatenate(texts), np.append(0, np.cumsum([len(t) for t in texts])))


def _slices(text: np.ndarray, limit: int, overlap: int) -> Iterator[tuple[int, int, int]]:
    """Start and end of each slice of a text, and the end of what it sees."""
    a = 0
    while a < len(text):
        own = _gap_after(text, min(a + limit, len(text)))
        b = own
        for _ in range(overlap):
            b = _gap_after(text, _word_after(text, b))
        yield a, own, b
        a = own


def _gap_after(text: np.ndarray, at: int, block: int = 1 << 12) -> int:
    return _seek(text, at, block, True)


def _word_after(text: np.ndarray, at: int, block: int = 1 << 12) -> int:
    return _seek(text, at, block, False)


def _seek(text: np.ndarray, at: int, block: int, gap: bool) -> int:
    """The first place from at on that is a gap between words, or is none; the text's end without one."""
    while at < len(text):
        found = np.flatnonzero(_GAPS[text[at : at + block]] == gap)
        if len(found):
            return at + int(found[0])
        at += block
    return len(text)
