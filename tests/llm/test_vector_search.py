import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from epilens.llm import vector_search

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, every, k, scale=256):
    clean = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            clean[i] = [math.floor(scale * float(np.float32(x))) for x in v]
    out = []
    for q, a in clean.items():
        if q % every == 0:
            own = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in clean.items() if i != q and len(a) == len(b))
            out += [(q, r, i, -s) for r, (s, i) in enumerate(own[:k], 1)]
    return sorted(out)


def test_equals_brute_force_with_ties_nulls_and_other_lengths(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "BLOCK", 40)
    monkeypatch.setattr(vector_search, "QUERY_CHUNK", 7)
    r = random.Random(1)
    centres = [[r.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [c + r.gauss(0, 0.05) for c in r.choice(centres)]) for i in range(400)]
    rows += [(400 + i, [0.5] * 6) for i in range(150)]  # one vector very often
    rows += [(600, None), (601, [None] * 6), (602, [float("nan")] * 6), (603, [float("inf")] + [0.0] * 5), (None, [1.0] * 6)]
    rows += [(620, [0.0] * 6), (640, [1e6, -1e6, 0.0, 0.0, 0.0, 0.0]), (660, [1.0, 2.0]), (661, [2.0, 1.0]), (680, []), (681, []), (700, [3.0] * 9)]
    rows += [rows[0], rows[405]]  # repeated rows
    df = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("x")).withColumn("pivot", F.lit(0))
    got = vector_search.top_k(df, every=20, k=5)
    assert sorted(map(tuple, got.collect())) == brute(rows, 20, 5)


@pytest.mark.parametrize("n", [0, 1, 2])
def test_small_tables(spark, n):
    rows = [(20 * i, [1.0, -1.0]) for i in range(n)]
    got = vector_search.top_k(spark.createDataFrame(rows, SCHEMA), every=20, k=5)
    assert sorted(map(tuple, got.collect())) == brute(rows, 20, 5)


def test_bound_holds():
    r = np.random.default_rng(2)
    x = np.floor(256 * r.normal(size=(500, 8)))
    p = x[:3]
    d = vector_search._distances(x, p)
    for q in x[:40]:
        qd = vector_search._distances(q[None], p)[0]
        gap, ball = np.abs(d - qd).max(axis=1), p[0] @ q + np.sqrt(q @ q) * d[:, 0]
        top = vector_search.bound(float(q @ q), gap, (x * x).sum(axis=1), ball)
        assert (top >= x @ q).all()
        assert (top <= vector_search.bound(float(q @ q), np.abs(d[:, 0] - qd[0]), (x * x).sum(axis=1), np.inf)).all()


def test_clustered_vectors_are_not_all_visited(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "BLOCK", 100)
    monkeypatch.setattr(vector_search, "QUERY_CHUNK", 16)
    r = np.random.default_rng(3)
    centres = r.normal(size=(40, 16))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    rows = [(i, [float(x) for x in centres[i % 40] + 0.05 * r.normal(size=16)]) for i in range(4000)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, vector_search.top_k(df, every=50, k=5).collect())) == brute(rows, 50, 5)
    seen = vector_search.visits(df, every=50, k=5).collect()
    assert len(seen) == 80
    assert sum(x.vectors for x in seen) < 0.34 * 80 * 4000 and all(x.vectors >= 5 for x in seen)


def test_chunks_of_neighbouring_homes(monkeypatch):
    monkeypatch.setattr(vector_search, "QUERY_CHUNK", 10)
    homes = [{"block": b, "count": n} for b, n in enumerate([4, 5, 3, 25, 2, 10])]
    assert vector_search._chunks(homes) == [(0, 0, 1), (1, 0, 1), (2, 1, 1), (3, 2, 3), (4, 5, 1), (5, 6, 1)]
