import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from epilens.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every, k=5, low=80, scale=256, most=2**63 - 1):
    clean = {}
    for i, v, y in rows:
        if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            own = (str(y), [math.floor(scale * float(np.float32(x))) for x in v])
            clean[i] = min(clean.get(i, own), own)
    out = []
    for a, (y, q) in clean.items():
        if a % every:
            continue
        ranked = sorted((-max(-most, min(most, sum(c * d for c, d in zip(q, v)))), i, z) for i, (z, v) in clean.items() if i != a and len(v) == len(q))
        for s, p, _ in [x for x in ranked if x[2] == y][:k]:
            fits = [x for x in ranked if x[2] != y and low * -s <= 100 * -x[0] <= 100 * -s]
            out += [(a, p, r, i, -s, -t) for r, (t, i, _) in enumerate(fits[:k], 1)]
    return sorted(out)


def mined(spark, rows, every=10, **options):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("x")).withColumn("block", F.lit(0)).withColumn("id", F.lit(3))
    got = H.mine(df, F.col("id") % every == 0, **options)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()))


def test_equals_brute_force_in_small_cells(spark, monkeypatch):
    monkeypatch.setattr(H, "CELL_ROWS", 60)
    monkeypatch.setattr(H, "CELL_ANCHORS", 9)
    r = random.Random(1)
    centres = [[r.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    rows = [(i, [c + r.gauss(0, 0.1) for c in r.choice(centres)], r.choice([1, 1, 1, 2, 3])) for i in range(300)]
    rows += [(300 + i, [0.5] * 6, i % 3) for i in range(120)]  # ties across labels
    rows += [(600, None, 1), (610, [None] * 6, 1), (620, [float("nan")] * 6, 1), (630, [float("inf")] + [0.0] * 5, 1)]
    rows += [(640, [1.0] * 6, None), (None, [1.0] * 6, 1), (650, [-1.0] * 6, 9), (651, [1.0] * 6, 9)]
    rows += [(660, [1e6, -1e6, 0.0, 0.0, 0.0, 0.0], 2), (670, [1.0, 2.0], 1), (671, [2.0, 1.0], 1), (672, [2.0, 0.9], 2)]
    rows += [(680, [], 1), (681, [], 1), (682, [], 2), rows[0], rows[310], (310, [9.0] * 6, 0), (300, [0.1] * 6, 7)]
    want = brute(rows, 10)
    assert len(want) > 500 and {x[0] for x in want} >= {670, 680}
    assert mined(spark, rows) == want
    assert mined(spark, rows, every=7, positives=2, negatives=3, low_percent=95)[0][0] >= 0
    few = [x for x in brute(rows, 10, k=1) if x[2] == 1]
    assert mined(spark, rows, positives=1, negatives=1) == few


def test_cells_meet_when_partitions_are_not_merged(spark, monkeypatch):
    monkeypatch.setattr(H, "CELL_ROWS", 40)
    monkeypatch.setattr(H, "CELL_ANCHORS", 5)
    r = random.Random(3)
    rows = [(i, [r.gauss(0, 1) for _ in range(5)], r.randrange(4)) for i in range(200)]
    conf = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        assert mined(spark, rows) == brute(rows, 10)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_scores_beyond_doubles(spark):
    rows = [(10 * i, [1e9 + 3 * i, 7.0 - i], i % 2) for i in range(8)]
    assert mined(spark, rows, scale=1 << 20) == brute(rows, 10, scale=1 << 20)  # all clipped to one value
    rows = [(10 * i, [float(2**24 + i), -float(2**22 - i)], i % 2) for i in range(12)]
    assert mined(spark, rows) == brute(rows, 10)


@pytest.mark.parametrize("n", [0, 1, 3])
def test_small_tables(spark, n):
    rows = [(10 * i, [1.0, 1.0 - i / 9], i // 2) for i in range(n)]
    assert mined(spark, rows) == brute(rows, 10)


def test_keys_sort_as_they_are_read():
    r = random.Random(2)
    rows = [(r.choice([-3, 0, 8]), r.choice([-(2**63), -5, 0, 7, 2**63 - 1]), r.choice([-1, 0, 2**40])) for _ in range(300)]
    keys = [H.packed(a, np.array([s]), np.array([i]))[0].as_py() for a, s, i in rows]
    assert [x for _, x in sorted(zip(keys, rows))] == sorted(rows, key=lambda x: (x[0], -x[1], x[2]))
    assert all(len(k) == 24 for k in keys)


def test_a_positive_after_an_equal_negative():
    stream = H._Stream(2, 80)
    read = [(1, 4, 10, False), (1, 5, 10, False), (1, 6, 10, False), (1, 7, 10, True), (1, 8, 9, True), (1, 9, 9, False), (1, 2, 7, False), (2, 3, 9, False)]
    assert [x for row in read for x in stream.take(*row)] == [(1, 7, 1, 4, 10, 10), (1, 7, 2, 5, 10, 10), (1, 8, 1, 9, 9, 9)]
