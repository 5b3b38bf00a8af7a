"""FM-index over a sequence of word numbers, in numpy.

Suffix array by prefix doubling (only tied suffixes are sorted again), its
Burrows-Wheeler transform in a wavelet matrix (a bit vector with rank per
bit of the alphabet), and every ``SAMPLE``-th text position kept for
locating. All searches run on arrays of patterns or rows at once.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 16
_CHUNK = 1 << 18  # rows located at once


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Order of the suffixes of ``s`` (symbols are small non-negative ints;
    a suffix that is a prefix of another comes first)."""
    n = len(s)
    bits = int(max(int(s.max(initial=0)) + 1, n)).bit_length()
    depth = max(1, 63 // bits)
    key = np.zeros(n, np.uint64)
    for j in range(depth):
        key <<= np.uint64(bits)
        if j < n:
            key[: n - j] |= s[j:].astype(np.uint64) + np.uint64(1)
    sa = np.argsort(key).astype(np.int64)
    key = key[sa]
    rank = np.empty(n, np.int64)
    slots, h = np.arange(n), depth
    while True:
        first = np.empty(len(slots), bool)
        first[:1] = True
        np.not_equal(key[1:], key[:-1], out=first[1:])
        head = np.maximum.accumulate(np.where(first, slots, 0))
        rank[sa[slots]] = head
        tied = ~first
        tied[:-1] |= ~first[1:]
        slots = slots[tied]
        if not len(slots):
            return sa
        at = sa[slots]
        ahead = at + h
        follow = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        key = (rank[at].astype(np.uint64) << np.uint64(32)) | follow.astype(np.uint64)
        order = np.argsort(key)
        sa[slots] = at[order]
        key = key[order]
        h *= 2


class BitVector:
    """Bits with constant-time rank."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.zeros((n // 64 + 1) * 8, np.uint8)
        own = np.packbits(bits, bitorder="little")
        packed[: len(own)] = own
        self.words = packed.view(np.uint64)
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])
        self.ones = int(self.before[-1])
        self.zeros = n - self.ones

    def rank1(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        w = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & low)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1


class WaveletMatrix:
    def __init__(self, values: np.ndarray, symbols: int):
        self.levels = list(range(max(1, (symbols - 1).bit_length()) - 1, -1, -1))
        self.vectors = []
        for b in self.levels:
            bit = (values >> b) & 1 == 1
            self.vectors.append(BitVector(bit))
            values = np.concatenate([values[~bit], values[bit]])
        self.start = self._descend(np.arange(symbols), np.zeros(symbols, np.int64))

    def _descend(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for b, v in zip(self.levels, self.vectors):
            ones = v.rank1(i)
            i = np.where((c >> b) & 1 == 1, v.zeros + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of symbol c among the first i values."""
        return self._descend(c, i) - self.start[c]

    def access_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value at i, and its occurrences before i."""
        c = np.zeros(len(i), np.int64)
        for b, v in zip(self.levels, self.vectors):
            bit, ones = v.get(i), v.rank1(i)
            c |= bit.astype(np.int64) << b
            i = np.where(bit, v.zeros + ones, i - ones)
        return c, i - self.start[c]


class FMIndex:
    """``s`` must end with a symbol that occurs nowhere else in it."""

    def __init__(self, s: np.ndarray):
        symbols = int(s.max()) + 1
        sa = suffix_array(s)
        self.tree = WaveletMatrix(s[sa - 1].astype(np.int64), symbols)
        self.smaller = np.zeros(symbols + 1, np.int64)
        np.cumsum(np.bincount(s, minlength=symbols), out=self.smaller[1:])
        marked = sa % SAMPLE == 0
        self.marked, self.sample = BitVector(marked), sa[marked]
        self.n = len(s)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [lo, hi) of the suffixes that start with each pattern
        (a row of symbols), by backward search."""
        lo = np.zeros(len(patterns), np.int64)
        hi = np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for j in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, j]
            lo[live] = self.smaller[c] + self.tree.rank(c, lo[live])
            hi[live] = self.smaller[c] + self.tree.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
        hi = np.maximum(lo, hi)
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: step back to a sampled one."""
        out = np.empty(len(rows), np.int64)
        left, at, steps = np.arange(len(rows)), rows, 0
        while len(left):
            hit = self.marked.get(at)
            out[left[hit]] = self.sample[self.marked.rank1(at[hit])] + steps
            left, at = left[~hit], at[~hit]
            c, r = self.tree.access_rank(at)
            at = self.smaller[c] + r
            steps += 1
        return out

    def occurrences(self, patterns: np.ndarray):
        """(pattern number, text position) arrays, in bounded pieces."""
        lo, hi = self.search(patterns)
        count = hi - lo
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        for a in range(0, total, _CHUNK):
            k = np.arange(a, min(a + _CHUNK, total))
            p = np.searchsorted(ends, k, side="right")
            yield p, self.locate(lo[p] + (k - (ends[p] - count[p])))
