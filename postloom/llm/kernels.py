"""Vectorised text helpers that run inside Arrow batches: words, their hashes, word n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that a helper looks at together; temporaries are a small multiple of it.
SLICE_BYTES = 1 << 19

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: Bytes between words of letters and digits (all bytes of characters beyond ASCII belong to words).
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_powers: list[np.ndarray] = []


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser (the published splitmix64 steps)."""
    x = x + np.uint64((seed * 0xD1342543DE82EF95 + 0x9E3779B97F4A7C15) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        both = []
        for base in (_BASE, _INVERSE):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _powers[:] = both
    return _powers[0], _powers[1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans that depend on the bytes alone."""
    p, inverse = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets (one more than rows) and validity of a binary or string column."""
    n = len(column)
    if pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        kind = np.int32
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], kind, n + 1, column.offset * kind().itemsize).astype(np.int64) if n else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    valid = np.asarray(column.is_valid()) if n else np.zeros(0, bool)
    return data, offsets, valid


def row_slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes each (a longer single row stands alone)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ of rows laid end to end, and each row's first word. gaps: which
    bytes stand between words, if not those."""
    solid = ~gaps[data]
    before = np.zeros(len(data), bool)
    before[1:] = solid[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    before[cuts] = False
    after = np.zeros(len(data), bool)
    after[:-1] = solid[1:]
    after[cuts[cuts > 0] - 1] = False
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_pieces(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = _SPACE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, bytes and offsets of parts of the rows that keep temporaries small: rows of any length are cut where
    words are (a piece of a row goes on with the next part's first row)."""
    if len(data) <= 4 * SLICE_BYTES:
        yield 0, data, offsets
        return
    for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        while a < b:
            c = min(a + SLICE_BYTES, b)
            while c < b and not gaps[data[c]]:
                nxt = np.flatnonzero(gaps[data[c : min(b, c + SLICE_BYTES)]])
                c = c + int(nxt[0]) if len(nxt) else min(b, c + SLICE_BYTES)
            yield row, data[a:c], np.array([0, c - a])
            a = c


def word_hashes(data: np.ndarray, offsets: np.ndarray, fold: bool, gaps: np.ndarray = _SPACE, head: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the rows, and each row's first word; fold lower-cases A-Z, head takes only so many of a
    word's first bytes."""
    out, counts = [np.zeros(0, np.uint64)], np.zeros(len(offsets) - 1, np.int64)
    for row, part, own in word_pieces(data, offsets, gaps):
        part = _FOLD[part] if fold else part
        starts, ends, first = words(part, own, gaps)
        out.append(span_hashes(part, starts, np.minimum(ends, starts + head) if head else ends))
        counts[row : row + len(own) - 1] += np.diff(first)
    return np.concatenate(out), np.append(0, np.cumsum(counts))


def _lower_table() -> np.ndarray:
    table = np.arange(0x3000, dtype=np.uint32)
    for c in range(1, 0x3000):
        low = chr(c).lower()
        table[c] = ord(low) if len(low) == 1 and not 0xD800 <= c < 0xE000 else c
        if chr(c).isspace():
            table[c] = 32
    return table


_LOWER = _lower_table()


def folded(cp: np.ndarray) -> np.ndarray:
    """Code points with case and the kinds of white space folded, one for one."""
    return _LOWER[cp] if not len(cp) or cp.max() < len(_LOWER) else np.where(cp < len(_LOWER), _LOWER[np.minimum(cp, len(_LOWER) - 1)], cp)


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 rows laid end to end, and each row's first one. Bytes that are no UTF-8 give one for each that
    could begin a character."""
    cp = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    begins = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=begins[1:])
    if len(cp) != begins[-1]:
        cp = data[(data & 0xC0) != 0x80].astype(np.uint32)
    return cp, begins[offsets]


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive entries; the caller leaves out those that cross rows."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    base = np.uint64(0xC2B2AE3D27D4EB4F)
    for k in range(n):
        out = out * base + hashes[k : k + len(out)]
    return mix(out, n)


def in_bitmap(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bit of each 64-bit hash is set; len(bitmap) is a power of two of 64-bit words."""
    bits = int(len(bitmap) * 64).bit_length() - 1
    slot = hashes >> np.uint64(64 - bits)
    return (bitmap[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
