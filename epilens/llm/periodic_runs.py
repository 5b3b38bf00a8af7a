"""Periodic runs of words over a Re-Pair grammar.

A run is a stretch of words with smallest period q and length of at least
``max(MIN_LENGTH, MIN_EXPONENT * q)`` that no neighbouring word extends
keeping the period. The words of a batch of texts become numbers. In a run every
pair of neighbouring words occurs three times or more, so rarer pairs part the
texts into segments; what is left outside holds no run.

The segments are compressed by Re-Pair in rounds: each round counts all pairs
of neighbouring symbols and replaces, all at once, every pair that occurs twice
or more and is at least as frequent as the pairs that overlap it; a pair has one
nonterminal, X -> YZ, wherever it is found. Rounds end when no pair occurs
twice. What the batch repeats is then looked at once: for every nonterminal
the runs of its expansion that cross the boundary of Y and Z, and for every
segment those that cross a boundary of the symbols it is left with.

A run of four periods has two of them on one side of any boundary inside it, so
a square of period q begins or ends at the boundary. For K = 1, 2, 4, ...,
squares with K <= q < 2K come from words K apart that start equal K-grams
(hashes, looked up in one sorted list); two overlapping K-grams cover the whole
period. The run is then extended word by word to both sides within the
expansion, which also confirms it exactly.

Every run of a text crosses the boundary of the lowest derivation node that
holds it whole, and is found there in full. The runs of a nonterminal are
carried to all places that derive it, and intervals inside a longer one of the
same period, which are parts of it, are dropped.

Work and memory of a task are those of one Arrow batch (bounded in rows and
bytes) or of one text, if that is longer; there is no shuffle.

Cases: null, empty and short texts have no runs; null texts collapse to null; a
text of one word over and over is one run of period 1; texts of any length are
taken whole; repeated rows and rows without id are handled alike, each for
itself; an empty table gives an empty result; columns named ``runs`` or
``collapsed`` are replaced, all others stay.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epilens.llm.common import fresh, mix64, prepare, to_bytes

MIN_LENGTH, MIN_EXPONENT = 6, 4
_ODD = np.uint64(0x9E3779B97F4A7C15)
_RUNS = "array<struct<start: long, length: long, period: long>>"


def _segments(x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches [from, to) of words in which every pair of neighbours may
    occur three times in its text: equal hashes count together, which only
    makes stretches longer. starts: where each text begins, and the end."""
    n = len(x)
    if n < MIN_LENGTH:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    h = mix64((x[:-1].astype(np.uint64) * _ODD + x[1:].astype(np.uint64)) * _ODD + text[:-1].astype(np.uint64))
    bits = max(10, int(n).bit_length() + 3)
    slot = (h >> np.uint64(64 - bits)).astype(np.int64)
    often = np.bincount(slot, minlength=1 << bits)[slot] >= 3
    often &= text[:-1] == text[1:]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], often.astype(np.int8), [0]])))
    a, b = edge[::2], edge[1::2] + 1
    long = b - a >= MIN_LENGTH
    return a[long], b[long]


class Grammar:
    """Re-Pair of the sequence y in segments that begin at ``starts``."""

    def __init__(self, y: np.ndarray, starts: np.ndarray):
        base = int(y.max(initial=0)) + 1
        self.base, self.left, self.right, self.at, self.rounds = base, [], [], [], []
        sym, pos = y.astype(np.int64), np.arange(len(y))
        seg = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        known, names = np.empty(0, np.int64), np.empty(0, np.int64)  # sorted pairs and their nonterminals
        made = 0
        while len(sym) > 1:
            key = sym[:-1] << 32 | sym[1:]
            key[seg[:-1] != seg[1:]] = -1
            pair, inverse, many = np.unique(key, return_inverse=True, return_counts=True)
            rank = np.empty(len(pair), np.int64)
            rank[np.lexsort((pair, many))] = np.arange(len(pair))
            rank[(pair < 0) | (many < 2)] = -1
            pick = _peaks(rank[inverse])
            if not len(pick):
                break
            used, which = np.unique(inverse[pick], return_inverse=True)
            own = pair[used]
            place = np.searchsorted(known, own)
            old = np.zeros(len(own), bool)
            inside = place < len(known)
            old[inside] = known[place[inside]] == own[inside]
            name = np.empty(len(own), np.int64)
            name[old] = names[place[old]]
            name[~old] = base + made + np.arange((~old).sum())
            first = np.full(len(own), len(y))
            np.minimum.at(first, which, pos[pick])
            self.left.append(own[~old] >> 32)
            self.right.append(own[~old] & 0xFFFFFFFF)
            self.at.append(first[~old])
            self.rounds.append((made, made + int((~old).sum())))
            made = self.rounds[-1][1]
            known, names = np.concatenate([known, own[~old]]), np.concatenate([names, name[~old]])
            order = np.argsort(known)
            known, names = known[order], names[order]
            sym[pick] = name[which]
            stay = np.ones(len(sym), bool)
            stay[pick + 1] = False
            sym, pos, seg = sym[stay], pos[stay], seg[stay]
        empty = [np.empty(0, np.int64)]
        self.left, self.right, self.at = (np.concatenate(p or empty) for p in (self.left, self.right, self.at))
        self.sym, self.pos, self.seg = sym, pos, seg
        self.length = np.ones(made, np.int64)
        for a, b in self.rounds:
            self.length[a:b] = self.size(self.left[a:b]) + self.size(self.right[a:b])

    def size(self, sym: np.ndarray) -> np.ndarray:
        """Words that a symbol stands for."""
        return np.where(sym < self.base, 1, self.length[np.maximum(sym - self.base, 0)] if len(self.length) else 1)

    def derived(self, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(nonterminal, place) of all derivation nodes whose nonterminal is
        marked, top down and only where a marked one lies below."""
        below = marked.copy()
        for a, b in self.rounds:
            for child in (self.left[a:b], self.right[a:b]):
                below[a:b] |= (child >= self.base) & below[np.maximum(child - self.base, 0)]
        rule, place, out = self.sym - self.base, self.pos, []
        while len(rule):
            good = rule >= 0
            good[good] = below[rule[good]]
            rule, place = rule[good], place[good]
            own = marked[rule]
            out.append((rule[own], place[own]))
            second = place + self.size(self.left[rule])
            rule, place = np.concatenate([self.left[rule], self.right[rule]]) - self.base, np.concatenate([place, second])
        return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.empty(0, np.int64),) * 2


def _peaks(rank: np.ndarray) -> np.ndarray:
    """Positions to replace, no two of them next to each other: those with at
    least the rank of their neighbours; of a chain of equal ranks (one word over
    and over) every second one. Negative ranks are not replaced."""
    n = len(rank)
    new = np.append(True, rank[1:] != rank[:-1])[:n]
    begin = np.flatnonzero(new)
    chain = np.cumsum(new) - 1
    value, stop = rank[begin], np.append(begin[1:], n)
    before, after = np.append(-1, value[:-1]), np.append(value[1:], -1)
    held_left, held_right = before > value, after > value
    offset = np.arange(n) - begin[chain] - held_left[chain]
    good = (rank >= 0) & (offset >= 0) & (offset % 2 == 0)
    good &= ~(held_right[chain] & (np.arange(n) == stop[chain] - 1))
    return np.flatnonzero(good)


def _ranges(low: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All values low[i] + 0 .. low[i] + many[i] - 1, with their i."""
    row = np.repeat(np.arange(len(low)), many)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + low[row]


def _crossing(y: np.ndarray, low: np.ndarray, cut: np.ndarray, high: np.ndarray):
    """(window, start, stop, period): the runs of y[low:high] that cross the
    cut, of every window [low, high).

    A square that lies in a stretch found with a smaller period has that period
    too, so only longer ones are looked up: ``reach`` is how far such stretches
    go from the cut to either side."""
    n, k, h = len(y), 1, y.astype(np.uint64)
    none = [np.empty(0, np.int64)] * 3
    found = [(*none, none[0])]
    live = np.flatnonzero(high - low >= MIN_LENGTH)
    reach = [np.zeros(len(cut), np.int64), np.zeros(len(cut), np.int64)]
    while len(live):
        values, group = np.unique(h, return_inverse=True)
        if len(values) == len(h):
            break  # no k-gram occurs twice
        order = np.sort(group * (n + 1) + np.arange(len(h)))
        level = [none]
        for side in (0, 1):  # the square begins, or ends, at the cut
            room = (high[live] - cut[live] if side == 0 else cut[live] - low[live]) // 2
            least = np.maximum(k, reach[side][live] // 2 + 1)
            most = np.minimum(np.minimum(2 * k - 1, room), (high[live] - low[live]) // MIN_EXPONENT)
            some = least <= most
            own, least, most = live[some], least[some], most[some]
            start = cut[own] if side == 0 else cut[own] - k
            near, far = (start + least, start + most) if side == 0 else (start - most, start - least)
            g = group[start] * (n + 1)
            first = np.searchsorted(order, g + np.maximum(near, 0))
            many = np.searchsorted(order, g + np.maximum(far, 0), side="right") - first
            for a in _pieces(many):
                row, at = _ranges(first[a], many[a])
                w = own[a][row]
                q = np.abs(order[at] % (n + 1) - start[a][row])
                one = cut[w] if side == 0 else cut[w] - 2 * q
                # the period's first and last k words, which cover it
                good = (h[one] == h[one + q]) & (h[one + q - k] == h[one + 2 * q - k])
                level.append((w[good], one[good], q[good]))
        w, one, q = (np.concatenate(c) for c in zip(*level))
        right = _matching(y, one, one + q, high[w] - one - q, 1)
        left = _matching(y, one - 1, one - 1 + q, one - low[w], -1)
        start, stop = one - left, one + q + right
        square = stop - start >= 2 * q  # else the hashes deceive
        w, start, stop, q = w[square], start[square], stop[square], q[square]
        np.maximum.at(reach[0], w, stop - cut[w])
        np.maximum.at(reach[1], w, cut[w] - start)
        found.append((w, start, stop, q))
        h = mix64(h[: len(h) - k] * _ODD + h[k:]) if len(h) > k else h[:0]
        k *= 2
        live = live[high[live] - low[live] >= MIN_EXPONENT * k]
    w, start, stop, q = (np.concatenate(c) for c in zip(*found))
    good = (start < cut[w]) & (cut[w] < stop) & (stop - start >= np.maximum(MIN_LENGTH, MIN_EXPONENT * q))
    w, start, stop, q = w[good], start[good], stop[good], q[good]
    order = np.lexsort((q, stop, start, w))
    w, start, stop, q = w[order], start[order], stop[order], q[order]
    # the smallest period of an interval
    new = np.append(True, (w[1:] != w[:-1]) | (start[1:] != start[:-1]) | (stop[1:] != stop[:-1]))[: len(w)]
    return w[new], start[new], stop[new], q[new]


def _pieces(many: np.ndarray, most: int = 1 << 20) -> list[slice]:
    """Slices of rows with about ``most`` candidates together."""
    cuts = np.flatnonzero(np.diff(np.cumsum(many) // most)) + 1 if len(many) else []
    return [slice(a, b) for a, b in zip([0, *cuts], [*cuts, len(many)]) if b > a]


def _matching(y: np.ndarray, i: np.ndarray, j: np.ndarray, room: np.ndarray, step: int) -> np.ndarray:
    """How many words from i and j on are equal, walking by ``step``, up to
    ``room`` words."""
    out, live, width = np.zeros(len(i), np.int64), np.flatnonzero(room > 0), 16
    while len(live):
        left = []
        size = max(1, (1 << 20) // width)
        for a in range(0, len(live), size):
            own = live[a : a + size]
            t = out[own][:, None] + np.arange(width)
            inside = t < room[own][:, None]
            t = np.where(inside, t, 0) * step
            same = inside & (y[i[own][:, None] + t] == y[j[own][:, None] + t])
            got = np.where(same.all(axis=1), width, same.argmin(axis=1))
            out[own] += got
            left.append(own[(got == width) & (out[own] < room[own])])
        live, width = np.concatenate(left), min(4 * width, 1 << 16)
    return out


def _maximal(start: np.ndarray, stop: np.ndarray, q: np.ndarray):
    """Intervals that lie in no other one of the same period."""
    order = np.lexsort((-stop, start, q))
    start, stop, q = start[order], stop[order], q[order]
    wide = int(stop.max(initial=0)) + 1
    reach = np.maximum.accumulate(q * wide + stop) if len(q) else q
    keep = np.append(True, (q * wide + stop)[1:] > reach[:-1])[: len(q)]
    return start[keep], stop[keep], q[keep]


def runs_of(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """Per text (word numbers) its runs (start, length, period) by start, then
    period."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    starts = np.cumsum([0, *map(len, texts)])
    x = np.concatenate([np.empty(0, np.int64), *texts])
    a, b = _segments(x, starts)
    if not len(a):
        return found
    y = np.concatenate([x[i:j] for i, j in zip(a, b)])
    edges = np.cumsum([0, *(b - a)])
    g = Grammar(y, edges)

    rules = np.flatnonzero(g.length >= MIN_LENGTH)
    low = g.at[rules]
    w, s, e, q = _crossing(y, low, low + g.size(g.left[rules]), low + g.length[rules])
    rule, s, e = rules[w], s - low[w], e - low[w]
    marked = np.zeros(len(g.length), bool)
    marked[rule] = True
    node, place = g.derived(marked)
    first = np.searchsorted(rule, node)
    row, at = _ranges(first, np.searchsorted(rule, node, side="right") - first)
    inner = (s[at] + place[row], e[at] + place[row], q[at])

    inside = np.flatnonzero(g.seg[1:] == g.seg[:-1]) + 1
    k = g.seg[inside]
    _, s, e, q = _crossing(y, edges[k], g.pos[inside], edges[k + 1])
    s, e, q = _maximal(*(np.concatenate(c) for c in zip(inner, (s, e, q))))

    k = np.searchsorted(edges, s, side="right") - 1
    s, e = s - edges[k] + a[k], e - edges[k] + a[k]
    text = np.searchsorted(starts, s, side="right") - 1
    order = np.lexsort((q, s, text))
    for t, i, j, p in zip(*(c[order].tolist() for c in (text, s - starts[text], e - s, q))):
        found[t].append((i, j, p))
    return found


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """``words`` without those that some run holds after its first period."""
    if not runs:
        return words
    stay = np.ones(len(words), bool)
    for start, length, period in runs:
        stay[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(stay)]


def find_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``runs`` (start and length in words, period; by start, then
    period) and ``collapsed``: the words that stay, joined by one space."""
    prepare(docs.sparkSession)

    @F.arrow_udf(f"runs {_RUNS}, collapsed string")
    def of(texts: pa.Array) -> pa.Array:
        words = [to_bytes(t.as_py()).split() for t in texts]
        number = defaultdict(count(1).__next__)
        runs = runs_of([np.fromiter(map(number.__getitem__, w), np.int64, len(w)) for w in words])
        flat = [r for own in runs for r in own]
        columns = [pa.array([r[k] for r in flat], pa.int64()) for k in range(3)]
        lists = pa.ListArray.from_arrays(
            pa.array(np.cumsum([0, *map(len, runs)]), pa.int32()), pa.StructArray.from_arrays(columns, names=["start", "length", "period"])
        )
        kept = [b" ".join(collapse(w, r)).decode("utf-8", "surrogatepass") if t.is_valid else None for t, w, r in zip(texts, words, runs)]
        return pa.StructArray.from_arrays([lists, pa.array(kept, pa.string())], names=["runs", "collapsed"])

    found = fresh(docs, "_found")
    keep = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("runs", "collapsed")]
    rows = docs.withColumn(found, of(F.col(f"`{text}`")))
    return rows.select(*keep, F.col(f"{found}.runs").alias("runs"), F.col(f"{found}.collapsed").alias("collapsed"))


def strongest(runs: Column) -> Column:
    """The run with the greatest exact length / period; the first on ties."""
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    return F.aggregate(
        runs,
        none,
        lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best),
    )
