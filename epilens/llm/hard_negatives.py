"""Hard negatives by a secondary-sort shuffle.

Components are quantized to floor(scale * x); a row's score is its integer
inner product with the anchor. An anchor's positives are its best rows of the
same label. A positive of score p opens the window of scores from
``low_percent`` % of p up to p; its negatives are the best rows of other labels
in that window. Better means the higher score, then the smaller id.

The anchors are a stated set, compared with all rows in blocks: rows and
anchors are dealt by hash over a grid of cells of bounded size, so no label and
no anchor makes a cell large. A cell sends its best few positives of an anchor;
the best of all cells are the anchor's positives, which hold for the second
pass, in which a cell sends the first few rows of each of the anchor's windows.
What a cell holds back cannot be among the first of all cells, so nothing is
lost and no more than a few rows per anchor and cell are shuffled.

Every pair score that is left is packed into one key (anchor, descending score,
id), 24 bytes that sort as they are to be read. The rows are partitioned by the
anchor and sorted within the partitions by that key in one shuffle (the
DataFrame's ``repartition`` and ``sortWithinPartitions``, Spark's
``repartitionAndSortWithinPartitions`` for rows that stay in the JVM). A
streaming iterator then reads each partition once: a positive opens its window,
a row of another label goes to all open windows, a window closes when it is
full or the score falls below it. It holds an anchor's open windows and the
first few ids of the score at hand (a row with a smaller id than a positive of
the same score comes before the window that it belongs to), never an anchor's
rows.

Cases: rows with a null id, label or vector, or with null or non-finite
components, take no part; an id given several times counts once, with its
smallest label and vector; rows of the anchor's own id are neither positive nor
negative; vectors of another length are never compared (empty vectors score 0
with each other); an anchor without positives, and a positive whose window is
empty (any of a negative score), gives no rows; labels are compared as text; an
empty table gives an empty result; other columns are ignored. Scores beyond 64
bits are clipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from epilens.llm.common import inner_products, prepare, stage, usable, whole_numbers

CELL_ROWS, CELL_ANCHORS, CELL_NUMBERS = 2048, 4096, 1 << 21
_SCORED = "anchor long, key binary, id long, score long, positive boolean"
_MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
_SIGN = np.uint64(1 << 63)


def taking_part(vectors: DataFrame, vec_id: str, vector: str, label: str, scale: int) -> DataFrame:
    """(id, label, dim, v) with one row per id."""
    key, own, x = F.col(f"`{vec_id}`"), F.col(f"`{label}`"), F.col(f"`{vector}`")
    rows = vectors.where(key.isNotNull() & own.isNotNull() & usable(x))
    rows = rows.select(key.cast("long").alias("id"), F.struct(own.cast("string").alias("label"), whole_numbers(x, scale).alias("v")).alias("r"))
    rows = rows.groupBy("id").agg(F.min("r").alias("r"))
    return rows.select("id", "r.label", F.size("r.v").alias("dim"), "r.v")


def packed(anchor: int, score: np.ndarray, ids: np.ndarray) -> pa.Array:
    """Keys whose bytes sort by anchor, then descending score, then id."""
    parts = np.empty((len(ids), 3), ">u8")
    parts[:, 0] = np.uint64(anchor & (2**64 - 1)) ^ _SIGN
    parts[:, 1] = ~(score.view(np.uint64) ^ _SIGN)
    parts[:, 2] = ids.view(np.uint64) ^ _SIGN
    offsets = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * 24)
    return pa.Array.from_buffers(pa.binary(), len(ids), [None, offsets.buffers()[1], pa.py_buffer(parts.tobytes())])


def _scored(found: list[tuple[int, np.ndarray, np.ndarray]], positive: bool) -> pa.Table:
    """found: per anchor its ids and scores."""
    found = [f for f in found if len(f[1])]
    ids, scores = (np.concatenate([np.empty(0, np.int64), *[f[k] for f in found]]) for k in (1, 2))
    keys = [packed(a, s, i) for a, i, s in found]
    return pa.table(
        {"anchor": pa.array(np.repeat(np.array([f[0] for f in found], np.int64), [len(f[1]) for f in found])),
         "key": pa.concat_arrays(keys) if keys else pa.array([], pa.binary()),
         "id": ids, "score": scores, "positive": np.full(len(ids), positive)}
    )


def _matrix(t: pa.Table) -> np.ndarray:
    v = t["v"].combine_chunks()
    return v.flatten().to_numpy().reshape(len(v), -1) if len(v.flatten()) else np.zeros((len(v), 0))


class _Cell:
    """Rows of a cell by ascending id, and their scores with its anchors."""

    def __init__(self, rows: pa.Table, anchors: pa.Table):
        rows = rows.sort_by("id")
        self.ids = rows["id"].to_numpy()
        self.anchors = anchors["anchor"].to_pylist()
        x, q = _matrix(rows), _matrix(anchors)
        names, code = np.unique(np.concatenate([rows["label"].to_numpy(), anchors["label"].to_numpy()]).astype(str), return_inverse=True)
        self.label, self.wanted = code[: len(self.ids)], code[len(self.ids) :]
        self.scores = np.concatenate([inner_products(x, q[a : a + 512]) for a in range(0, len(q), 512)], axis=1)

    def best(self, k: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
        out = []
        for j, a in enumerate(self.anchors):
            own = np.flatnonzero((self.label == self.wanted[j]) & (self.ids != a))
            own = own[np.argsort(-self.scores[own, j], kind="stable")[:k]]
            out.append((a, self.ids[own], self.scores[own, j]))
        return out

    def windows(self, positives: list[list[int]], k: int, low_percent: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
        out = []
        for j, (a, tops) in enumerate(zip(self.anchors, positives)):
            s = self.scores[:, j]
            own = np.flatnonzero((self.label != self.wanted[j]) & (self.ids != a) & (s <= max(tops)) & (s >= lowest(min(tops), low_percent)))
            own = own[np.argsort(-s[own], kind="stable")]
            first = np.searchsorted(-s[own], [-p for p in tops])
            pick = np.zeros(len(own), bool)
            for i, p in zip(first, tops):
                pick[i : i + k] |= s[own[i : i + k]] >= lowest(p, low_percent)
            own = own[pick]
            out.append((a, self.ids[own], s[own]))
        return out


def lowest(positive_score: int, low_percent: int) -> int:
    """The smallest whole score s with low_percent * positive <= 100 * s."""
    return -(-low_percent * positive_score // 100)


def _in_cells(rows: DataFrame, anchors: DataFrame, grid: tuple[int, int], kernel) -> DataFrame:
    """``kernel(rows, anchors)`` of every cell of the grid, per vector length."""
    n_rows, n_anchors = grid
    key = ["dim", "block", "chunk"]
    # of one type on both sides: Spark deals an int and an equal long to different partitions
    block, chunk = (F.pmod(F.xxhash64(c), F.lit(n)).cast("int") for c, n in (("id", n_rows), ("anchor", n_anchors)))
    left = rows.withColumn("block", block).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(n_anchors - 1))))
    right = anchors.withColumn("chunk", chunk).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        return kernel(a, b) if a.num_rows and b.num_rows else _scored([], False)

    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, _SCORED)


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    positives: int = 5,
    negatives: int = 5,
    low_percent: int = 80,
    scale: int = 256,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score). ``is_anchor`` is a condition on the id, as column ``id``."""
    prepare(vectors.sparkSession)
    rows = stage(taking_part(vectors, vec_id, vector, label, scale), "negatives-rows")
    # aliases: columns of their own beside those of ``rows`` in a cell
    anchors = rows.where(is_anchor).select(F.col("id").alias("anchor"), *[F.col(c).alias(c) for c in ("label", "dim", "v")])
    size = F.count("*").alias("n"), F.coalesce(F.sum("dim"), F.lit(0)).alias("numbers")
    of_rows, of_anchors = rows.agg(*size).first(), anchors.agg(*size).first()
    grid = tuple(
        max(1, -(-s["n"] // most), -(-s["numbers"] // CELL_NUMBERS)) for s, most in ((of_rows, CELL_ROWS), (of_anchors, CELL_ANCHORS))
    )

    best = _in_cells(rows, anchors, grid, lambda a, b: _scored(_Cell(a, b).best(positives), True))
    order = W.partitionBy("anchor").orderBy(F.col("score").desc(), "id")
    best = stage(best.withColumn("r", F.row_number().over(order)).where(F.col("r") <= positives).drop("r"), "negatives-positives")

    tops = best.groupBy("anchor").agg(F.sort_array(F.collect_set("score"), asc=False).alias("tops"))  # at most ``positives``
    known = anchors.join(tops, "anchor")

    def windows(a: pa.Table, b: pa.Table) -> pa.Table:
        return _scored(_Cell(a, b).windows(b["tops"].to_pylist(), negatives, low_percent), False)

    scored = _in_cells(rows, known, grid, windows).unionByName(best)
    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = scored.select("anchor", "key", "id", "score", "positive").repartition(n, "anchor").sortWithinPartitions("key")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = _Stream(negatives, low_percent)
        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("anchor", "id", "score", "positive")]
            out = [x for row in zip(*columns) for x in stream.take(*row)]
            if out:
                columns = [pa.array(c, pa.int32() if k == 2 else pa.int64()) for k, c in enumerate(zip(*out))]
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in _MINED.split(", ")])

    return dealt.mapInArrow(read, _MINED)


class _Stream:
    """Rows come by anchor, descending score and id; ``take`` gives the rows of
    the result that one row completes."""

    def __init__(self, k: int, low_percent: int):
        self.k, self.low_percent, self.anchor, self.score = k, low_percent, None, None
        self.open: list[list[int]] = []  # positive, its score, lowest score, negatives so far
        self.level: list[int] = []  # first ids of other labels with the score at hand

    def take(self, anchor: int, own: int, score: int, positive: bool) -> list[tuple]:
        if anchor != self.anchor:
            self.anchor, self.score, self.open = anchor, None, []
        if score != self.score:
            self.score, self.level = score, []
        if positive:
            window = [own, score, lowest(score, self.low_percent), 0]
            out = [self._give(window, i, score) for i in self.level if score >= window[2]]
            self.open.append(window)
            return out
        if len(self.level) < self.k:
            self.level.append(own)
        self.open = [w for w in self.open if w[3] < self.k and score >= w[2]]
        return [self._give(w, own, score) for w in self.open]

    def _give(self, window: list[int], negative: int, score: int) -> tuple:
        window[3] += 1
        return self.anchor, window[0], window[3], negative, window[1], score
