"""Exact top-k by integer inner product over a pivot-distance index.

Components are quantized to floor(scale * x). Every vector is keyed by its
nearest pivot (pivots come from a bounded sample: at most ``SAMPLE`` vectors,
``PIVOTS`` per dimension) and its distance to it. Per pivot the distances are
cut into annuli; neighbouring annuli are put together into blocks of about
``BLOCK`` vectors, and an annulus that is larger (one vector repeated very
often) is dealt over several blocks by hash.

A block is known by its largest norm and by the range of its vectors' distances
to every pivot. With |q - v| >= |d(q, p) - d(v, p)| for every pivot p, and
v = p + (v - p) for its own one, the score obeys
    q.v <= (|q|^2 + |v|^2 - max over p of (d(q, p) - d(v, p))^2) / 2
    q.v <= q.p + |q| d(v, p)
    q.v <= |q| |v|.
A query first searches the block of its best bound; its k-th score there is a
floor. It then goes to every other block whose bound reaches that floor, and
to no other. Inside a block vectors are sorted by distance; the query expands
from its own distance outwards, best bound first, and stops when the bound
falls below its k-th score. Equal bounds are searched, so ties are complete.

The queries are a stated set (here: ids divisible by ``every``) against all
rows. Queries with the same or neighbouring home blocks make a chunk of about
``QUERY_CHUNK``; a block is sent to a chunk only if one of its queries goes
there, so what is shuffled follows the visits. ``visits`` reports them.

Cases: vectors that are null or hold null or non-finite components, and rows
without id, take no part; vectors of another length than the query are no
candidates (empty vectors score 0 with each other); rows equal in id and
vector count once and rows of the query's own id are not its candidates; ties
go to the smaller id; fewer than k candidates give fewer rows; other columns
are ignored. Scores beyond a 64-bit integer are clipped to its range.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from epilens.llm.common import inner_products, prepare, stage, usable, whole_numbers

SAMPLE, PIVOTS, ANNULI = 4096, 48, 64
BLOCK, QUERY_CHUNK, STEP = 2048, 4096, 256
_INDEXED = "vec_id long, dim int, pivot int, dist double, norm2 double, annulus int, v array<double>"
_TOP = "query_id long, vec_id long, score long"  # a visit without vec_id has the number of vectors scored


def quantized(vectors: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """(vec_id, v array<double> of whole numbers) of the rows that take part."""
    key, x = F.col(f"`{vec_id}`"), F.col(f"`{vector}`")
    rows = vectors.where(key.isNotNull() & usable(x))
    return rows.select(key.cast("long").alias("vec_id"), whole_numbers(x, scale).alias("v")).distinct()


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((x[:, None, :] - pivots[None]) ** 2).sum(axis=2), 0))


def choose_pivots(sample: list[np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per dimension: pivots (farthest-first, then two rounds of means) and
    each pivot's largest distance in the sample."""
    out = {}
    for dim in {len(v) for v in sample if len(v)}:
        x = np.unique(np.array([v for v in sample if len(v) == dim], float), axis=0)
        pick, near = [0], None
        while len(pick) < min(PIVOTS, len(x)):
            d = ((x - x[pick[-1]]) ** 2).sum(axis=1)
            near = d if near is None else np.minimum(near, d)
            pick.append(int(near.argmax()))
        p = x[pick]
        for _ in range(2):
            own = np.array([_distances(x[i : i + 256], p).argmin(axis=1) for i in range(0, len(x), 256)], dtype=object)
            own = np.concatenate([np.asarray(o, int) for o in own])
            p = np.array([x[own == k].mean(axis=0) if (own == k).any() else p[k] for k in range(len(p))])
        d = np.concatenate([_distances(x[i : i + 256], p) for i in range(0, len(x), 256)])
        reach = np.array([d[d.argmin(axis=1) == k, k].max(initial=0) for k in range(len(p))])
        out[dim] = (p, np.maximum(reach, 1e-9))
    return out


def build_index(vectors: DataFrame, vec_id: str, vector: str, scale: int):
    """(indexed rows, pivots, blocks): blocks is a small table (at most
    dimensions x PIVOTS x ANNULI rows, counts only)."""
    spark = vectors.sparkSession
    prepare(spark)
    rows = quantized(vectors, vec_id, vector, scale)
    rows = stage(rows, "vectors")
    sample = [np.array(r[0]) for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").collect()]
    pivots = choose_pivots(sample)
    sent = spark.sparkContext.broadcast(pivots)

    def assign(frames):
        for f in frames:
            dims = f["v"].map(len)
            for dim, own in f.groupby(dims):
                x = np.array(own["v"].tolist(), float).reshape(len(own), dim)
                p, reach = sent.value.get(dim, (np.zeros((1, dim)), np.ones(1)))
                d = _distances(x, p)
                k = d.argmin(axis=1)
                dist = d[np.arange(len(x)), k]
                ring = np.clip((ANNULI - 1) * np.nan_to_num(dist / reach[k], posinf=1.0), 0, ANNULI - 1).astype(int)
                yield pd.DataFrame({"vec_id": own["vec_id"].to_numpy(), "dim": dim, "pivot": k, "dist": dist,
                                    "norm2": (x * x).sum(axis=1), "annulus": ring, "v": list(x)})

    def measure(frames):
        """Statistics of the annuli in a task: one row per annulus at most."""
        held: dict[int, tuple[np.ndarray, ...]] = {}
        for f in frames:
            for dim, own in f.groupby("dim"):
                x = np.array(own["v"].tolist(), float).reshape(len(own), dim)
                d = _distances(x, sent.value.get(dim, (np.zeros((1, dim)), None))[0])
                cells, width = d.shape[1] * ANNULI, d.shape[1]
                if dim not in held:
                    held[dim] = (np.zeros(cells, np.int64), np.zeros(cells), np.full((cells, width), np.inf), np.full((cells, width), -np.inf))
                n, norm2, near, far = held[dim]
                at = own["pivot"].to_numpy() * ANNULI + own["annulus"].to_numpy()
                np.add.at(n, at, 1)
                np.maximum.at(norm2, at, own["norm2"].to_numpy())
                np.minimum.at(near, at, d)
                np.maximum.at(far, at, d)
        for dim, (n, norm2, near, far) in held.items():
            at = np.flatnonzero(n)
            yield pd.DataFrame({"dim": dim, "pivot": at // ANNULI, "annulus": at % ANNULI, "n": n[at], "norm2": norm2[at],
                                "near": list(near[at]), "far": list(far[at])})

    index = stage(rows.mapInPandas(assign, _INDEXED), "vector-index")
    parts = index.mapInPandas(measure, "dim int, pivot int, annulus int, n long, norm2 double, near array<double>, far array<double>")
    most = max([1, *(len(p) for p, _ in pivots.values())])
    stats = parts.groupBy("dim", "pivot", "annulus").agg(
        F.sum("n").alias("n"),
        F.max("norm2").alias("norm2"),
        F.array(*[F.min(F.get("near", F.lit(i))) for i in range(most)]).alias("near"),
        F.array(*[F.max(F.get("far", F.lit(i))) for i in range(most)]).alias("far"),
    )
    return index, pivots, _blocks(stats.orderBy("dim", "pivot", "annulus").collect())


def _blocks(stats) -> pd.DataFrame:
    """One row per annulus with its block, and the block's bounds (near and
    far: distances to every pivot of the dimension)."""
    out, block, held, last = [], -1, 0, None
    for s in stats:
        cell = (s["dim"], s["pivot"])
        if cell != last or held + s["n"] > BLOCK:
            block, held, last = block + 1, 0, cell
        held += s["n"]
        out.append((block, *cell, s["annulus"], s["n"], s["norm2"], np.array(s["near"], float), np.array(s["far"], float)))
    t = pd.DataFrame(out, columns=["block", "dim", "pivot", "annulus", "n", "norm2", "near", "far"])
    if len(t):
        g = t.groupby("block")
        t["near"] = t["block"].map({b: np.min(np.stack(own.tolist()), axis=0) for b, own in g["near"]})
        t["far"] = t["block"].map({b: np.max(np.stack(own.tolist()), axis=0) for b, own in g["far"]})
        t["norm2"] = g["norm2"].transform("max")
        t["salts"] = -(-g["n"].transform("sum") // BLOCK)
    else:
        t["salts"] = []
    return t


def bound(q_norm2, gap, norm2, ball):
    """Largest score that a vector can have whose norm is at most norm2, whose
    distance to the query is at least gap, and which lies in a ball around a
    pivot that bounds the score by ``ball``; with slack for rounding."""
    gap = np.maximum(0, gap)
    top = np.minimum(np.minimum((q_norm2 + norm2 - gap * gap) / 2, np.sqrt(q_norm2 * norm2)), ball)
    return top + 1e-6 * (1 + q_norm2 + norm2)


def _search(x, ids, dist, norm2, q, query_id, q_dist, q_dot, floor, k):
    """The query's k best of a block sorted by distance to the pivot, and how
    many vectors were scored."""
    scores, found, n_scored = np.empty(0, np.int64), np.empty(0, np.int64), 0
    right = int(np.searchsorted(dist, q_dist))
    left, n = right, len(dist)
    most, q_norm2 = float(norm2.max()), float(q @ q)
    length = np.sqrt(q_norm2)
    while left > 0 or right < n:
        down = bound(q_norm2, q_dist - dist[left - 1], most, q_dot + length * dist[left - 1]) if left > 0 else -np.inf
        up = bound(q_norm2, dist[right] - q_dist, most, q_dot + length * dist[-1]) if right < n else -np.inf
        if max(down, up) < floor:
            break
        a, b = (max(0, left - STEP), left) if down >= up else (right, min(n, right + STEP))
        left, right = (a, right) if down >= up else (left, b)
        s, i = inner_products(x[a:b], q), ids[a:b]
        n_scored += b - a
        good = (i != query_id) & (s >= floor)
        scores, found = np.concatenate([scores, s[good]]), np.concatenate([found, i[good]])
        best = np.lexsort((found, -scores))[:k]
        scores, found = scores[best], found[best]
        if len(scores) == k:
            floor = max(floor, scores[-1])
    return found, scores, n_scored


def top_k(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    every: int = 20,
    k: int = 5,
    scale: int = 256,
) -> DataFrame:
    """(query_id, rank, vec_id, score) for the queries vec_id % every = 0."""
    found = _searched(vectors, vec_id, vector, every, k, scale).where("vec_id IS NOT NULL").distinct()
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )


def visits(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", every: int = 20, k: int = 5, scale: int = 256
) -> DataFrame:
    """(query_id, blocks, vectors): what each query of ``top_k`` looks at."""
    seen = _searched(vectors, vec_id, vector, every, k, scale).where("vec_id IS NULL")
    return seen.groupBy("query_id").agg(F.count("*").alias("blocks"), F.sum("score").alias("vectors"))


def _searched(vectors: DataFrame, vec_id: str, vector: str, every: int, k: int, scale: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of every block that a query
    visits, and a row without vec_id per visit."""
    spark = vectors.sparkSession
    index, pivots, table = build_index(vectors, vec_id, vector, scale)
    per_block = table.drop_duplicates("block")
    bounds = {}
    for dim, own in per_block.groupby("dim"):
        p = pivots.get(dim, (np.zeros((1, dim)), None))[0]
        near, far = (np.stack(own[c].tolist())[:, : len(p)] for c in ("near", "far"))
        bounds[dim] = (p, near, far, *(own[c].to_numpy() for c in ("block", "pivot", "norm2", "salts")))
    sent = spark.sparkContext.broadcast(bounds)
    places = spark.createDataFrame(
        [tuple(map(int, r)) for r in table[["dim", "pivot", "annulus", "block", "salts"]].itertuples(index=False)],
        "dim int, pivot int, annulus int, block int, salts int",
    )
    rows = index.join(F.broadcast(places), ["dim", "pivot", "annulus"])
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.col("salts")).cast("int"))
    rows = rows.select("block", "salt", "vec_id", "dist", "norm2", "v")
    queries = index.where(F.col("vec_id") % every == 0).select("vec_id", "v").distinct()

    def targets(q: np.ndarray):
        """Of all blocks: distance to and product with the pivot, and bound."""
        p, near, far, _, pivot, norm2, _ = sent.value[len(q)]
        d, dot = _distances(q[None], p)[0], p @ q
        own = np.arange(len(pivot)), pivot
        gap = np.maximum(near - d, d - far).max(axis=1)
        return d[pivot], dot[pivot], bound(float(q @ q), gap, norm2, dot[pivot] + np.sqrt(q @ q) * far[own])

    def home(frames):
        for f in frames:
            out = []
            for i, q in zip(f["vec_id"], f["v"]):
                q = np.asarray(q, float)
                d, dot, top = targets(q)
                b = int(top.argmax())
                block, salts = (sent.value[len(q)][c][b] for c in (3, 6))
                out.append((i, int(block), int(i) % int(salts), d[b], dot[b], -np.inf, q))
            yield pd.DataFrame(out, columns=["query_id", "block", "salt", "q_dist", "q_dot", "floor", "q"])

    def rest(frames):
        for f in frames:
            out = []
            for i, chunk, q, floor, at, at_salt in zip(*(f[c] for c in ("query_id", "chunk", "q", "floor", "block", "salt"))):
                q = np.asarray(q, float)
                d, dot, top = targets(q)
                block, salts = (sent.value[len(q)][c] for c in (3, 6))
                low = -np.inf if floor is None or np.isnan(floor) else floor
                for b in np.flatnonzero(top >= low):
                    for salt in range(int(salts[b])):
                        if (block[b], salt) != (at, at_salt):
                            out.append((i, int(block[b]), salt, chunk, d[b], dot[b], low, q))
            yield pd.DataFrame(out, columns=["query_id", "block", "salt", "chunk", "q_dist", "q_dot", "floor", "q"])

    def search(block: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found, none = [], pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="Int64")
        if not len(block) or not len(asked):
            return none
        block = block.sort_values("dist", kind="stable")
        x = np.array(block["v"].tolist(), float).reshape(len(block), len(block["v"].iloc[0]))
        ids, dist, norm2 = (block[c].to_numpy() for c in ("vec_id", "dist", "norm2"))
        for i, d, dot, low, q in zip(*(asked[c] for c in ("query_id", "q_dist", "q_dot", "floor", "q"))):
            best, scores, n = _search(x, ids, dist, norm2, np.asarray(q, float), i, d, dot, low, k)
            found.append((np.full(len(best) + 1, i), np.append(best, 0), np.append(scores, n), np.append(np.zeros(len(best), bool), True)))
        query, best, scores, visit = (np.concatenate(c) for c in zip(*found))
        vec_id = pd.arrays.IntegerArray(best.astype("int64"), visit)
        return pd.DataFrame({"query_id": query.astype("int64"), "vec_id": vec_id, "score": scores.astype("int64")})

    def answered(asked: DataFrame) -> DataFrame:
        """Only the blocks that are visited, once per chunk that does."""
        key = ["block", "salt", "chunk"]
        wanted = asked.select(*[F.col(c).alias(c) for c in key]).distinct()  # columns of its own
        sent_rows = rows.join(wanted, ["block", "salt"])
        return sent_rows.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(search, _TOP)

    visit = "query_id long, block int, salt int, q_dist double, q_dot double, floor double, q array<double>"
    at_home = stage(queries.mapInPandas(home, visit), "vector-homes")
    chunks = _chunks(at_home.groupBy("block").count().orderBy("block").collect())
    chunk_of = spark.createDataFrame(chunks, "block int, first int, parts int")
    chunk = (F.col("first") + F.pmod(F.xxhash64("query_id"), F.col("parts"))).cast("int")
    at_home = at_home.join(F.broadcast(chunk_of), "block").withColumn("chunk", chunk).drop("first", "parts")
    first = stage(answered(at_home), "vector-first")
    kth = first.where("vec_id IS NOT NULL").groupBy(F.col("query_id").alias("of")).agg(F.count("*").alias("n"), F.min("score").alias("low"))
    floors = at_home.drop("floor").join(kth, F.col("query_id") == F.col("of"), "left")
    floors = floors.withColumn("floor", F.when(F.col("n") >= k, F.col("low").cast("double")))
    asked = stage(floors.select("query_id", "chunk", "q", "floor", "block", "salt").mapInPandas(rest, visit + ", chunk int"), "vector-visits")
    return first.unionByName(answered(asked))


def _chunks(homes) -> list[tuple[int, int, int]]:
    """(block, first chunk, number of chunks): neighbouring home blocks share a
    chunk, one with many queries is dealt over several."""
    out, chunk, held = [], 0, 0
    for r in homes:
        n = r["count"]
        if held and held + n > QUERY_CHUNK:
            chunk, held = chunk + 1, 0
        parts = -(-n // QUERY_CHUNK)
        out.append((r["block"], chunk, parts))
        held += n
        if parts > 1:
            chunk, held = chunk + parts, 0
    return out
