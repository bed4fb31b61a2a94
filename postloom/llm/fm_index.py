"""A small FM-index over word symbols, with a wavelet tree for rank, for use inside one Spark task."""

from __future__ import annotations

import numpy as np

#: Rotations are sorted by this many symbols, which is enough for patterns of fewer symbols.
ORDER = 16


class WaveletTree:
    """Rank over a symbol sequence: one packed bit vector a level, with a count for every 64 bits."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.levels = bits, []
        for level in range(bits - 1, -1, -1):
            ones = (symbols >> level) & 1 == 1
            padded = np.zeros((len(symbols) // 64 + 1) * 64, bool)
            padded[: len(symbols)] = ones
            packed = np.packbits(padded, bitorder="little").view(np.uint64)
            before = np.zeros(len(packed) + 1, np.int64)
            np.cumsum(np.bitwise_count(packed), out=before[1:])
            zeros = len(symbols) - int(before[-1])
            self.levels.append((packed, before, zeros))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])
        self.below = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)

    def rank(self, symbol: np.ndarray, at: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before position at; base: where its run starts on the last level."""
        for depth, (packed, before, zeros) in enumerate(self.levels):
            word = at >> 6
            ones = before[word] + np.bitwise_count(packed[word] & self.below[at & 63])
            at = np.where((symbol >> (self.bits - 1 - depth)) & 1 == 1, zeros + ones, at - ones)
        return at - base


class FmIndex:
    """Index of a symbol sequence (symbols from 1; 0 separates pieces and ends the sequence)."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        rank, step = symbols.astype(np.int64), 1
        while step < ORDER:
            key = rank * (n + 2) + np.roll(rank, -step)
            order = np.argsort(key, kind="stable")
            changed = np.concatenate([[0], np.diff(key[order]) != 0]).cumsum()
            rank = np.empty(n, np.int64)
            rank[order] = changed
            step *= 2
        self.order = np.argsort(rank, kind="stable")
        self.row = np.empty(n, np.int64)
        self.row[self.order] = np.arange(n)
        last = symbols[self.order - 1].astype(np.int64)
        size = int(symbols.max()) + 1
        self.before = np.concatenate([[0], np.bincount(symbols, minlength=size).cumsum()])
        bits = max(1, int(size - 1).bit_length())
        self.tree = WaveletTree(last, bits)
        every = np.arange(size)
        self.base = self.tree.rank(every, np.zeros(size, np.int64), np.zeros(size, np.int64))

    def windows(self, symbols: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals of the windows of so many symbols that end before ends, by backward search from the last
        symbol. A window that occurs once is left at the interval of the suffix that already occurs once."""
        low = self.before[symbols[ends - 1]]
        high = self.before[symbols[ends - 1] + 1]
        active = np.flatnonzero(high - low > 1)
        for k in range(2, length + 1):
            c = symbols[ends[active] - k].astype(np.int64)
            both = self.tree.rank(np.concatenate([c, c]), np.concatenate([low[active], high[active]]), np.concatenate([self.base[c]] * 2))
            low[active] = self.before[c] + both[: len(c)]
            high[active] = self.before[c] + both[len(c) :]
            active = active[high[active] - low[active] > 1]
        return low, high
