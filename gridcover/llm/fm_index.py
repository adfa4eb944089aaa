"""An FM-index over integer sequences, in numpy: suffix array by prefix doubling, wavelet matrix, sampled positions.

The text is a collection of sequences, each ended by a separator of its own, so that no pattern runs across two of them.
All queries work on many patterns or rows at once.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector with rank in constant time."""

    def __init__(self, flags: np.ndarray):
        n = len(flags)
        packed = np.packbits(flags, bitorder="little")
        self.words = np.frombuffer(np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).tobytes(), np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).astype(np.int64))])
        self.zeros = n - int(self.before[-1])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        w = i >> 6
        low = self.words[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[w] + np.bitwise_count(low)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64)


class WaveletMatrix:
    """rank and access over a sequence of small integers."""

    def __init__(self, values: np.ndarray, most: int):
        self.levels = []
        for k in reversed(range(max(1, int(most).bit_length()))):
            flags = (values >> k & 1).astype(bool)
            self.levels.append((k, Bits(flags)))
            values = np.concatenate([values[~flags], values[flags]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often the symbol stands among the first i values."""
        start = np.zeros_like(i)
        for k, bits in self.levels:
            one = (symbol >> k & 1).astype(bool)
            r, s = bits.rank(i), bits.rank(start)
            i = np.where(one, bits.zeros + r, i - r)
            start = np.where(one, bits.zeros + s, start - s)
        return i - start

    def access_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value at i, and how often it stands before i."""
        start, symbol = np.zeros_like(i), np.zeros_like(i)
        for k, bits in self.levels:
            one = bits.get(i).astype(bool)
            symbol |= one.astype(np.int64) << k
            r, s = bits.rank(i), bits.rank(start)
            i = np.where(one, bits.zeros + r, i - r)
            start = np.where(one, bits.zeros + s, start - s)
        return symbol, i - start


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Of a text whose zeros are separators, each smaller than the next one and than all symbols."""
    n = len(text)
    cut = np.flatnonzero(text == 0)
    key = text.astype(np.int64) + len(cut)
    key[cut] = np.arange(len(cut))
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    step = 1
    while True:
        k = key[order]
        new = np.concatenate([[0], np.cumsum(k[1:] != k[:-1])])
        rank[order] = new
        if new[-1] == n - 1:
            return order
        ahead = np.zeros(n, np.int64)
        ahead[:-step] = rank[step:] + 1
        key = rank * (n + 1) + ahead
        order = np.argsort(key)
        step *= 2


class FMIndex:
    def __init__(self, text: np.ndarray, sample: int = 8):
        """text: symbols from 1 on, with a 0 after each sequence. Every sample-th position and each sequence's first are sampled."""
        n = len(text)
        order = suffix_array(text)
        bwt = text[order - 1].astype(np.int64)
        most = int(text.max()) if n else 0
        self.tree = WaveletMatrix(bwt, most)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=most + 1))])
        begins = np.ones(n, bool)
        begins[1:] = text[:-1] == 0
        marked = (order % sample == 0) | begins[order]
        self.marked, self.samples, self.size, self.most = Bits(marked), order[marked], n, most

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the rows [lo, hi) of the suffixes that begin with each pattern (a row of symbols, left-aligned)."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.size, np.int64)
        if not len(patterns):
            return lo, hi
        for k in range(int(lengths.max())):
            live = np.flatnonzero((lengths > k) & (hi > lo))
            if not len(live):
                break
            c = patterns[live, lengths[live] - 1 - k].astype(np.int64)
            known = c <= self.most
            hi[live[~known]] = lo[live[~known]]
            live, c = live[known], c[known]
            lo[live] = self.first[c] + self.tree.rank(c, lo[live])
            hi[live] = self.first[c] + self.tree.rank(c, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: steps back in the text until a sampled position."""
        steps, at = np.zeros(len(rows), np.int64), rows.copy()
        live = np.flatnonzero(self.marked.get(at) == 0)
        while len(live):
            c, r = self.tree.access_rank(at[live])
            at[live] = self.first[c] + r
            steps[live] += 1
            live = live[self.marked.get(at[live]) == 0]
        return self.samples[self.marked.rank(at)] + steps
