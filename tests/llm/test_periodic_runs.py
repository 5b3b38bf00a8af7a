import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from epilens.llm import periodic_runs as P
from util import DOCS, docs, words


def brute(w):
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)  # the smallest period comes first
            i = max(i + 1, j)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapsed(w):
    gone = {i for s, n, q in brute(w) for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def numbers(text):
    return np.array([x + 1 for x in text], np.int64)


def repeated(r, letters):
    out = []
    while len(out) < 100:
        unit = [r.randrange(letters) for _ in range(r.randrange(1, 8))]
        out += (unit * r.randrange(1, 9))[: r.randrange(1, 40)]
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), max_size=4))
def test_any_words(texts):
    assert P.runs_of([numbers(t) for t in texts]) == [brute(t) for t in texts]


def test_nested_repeats_and_copies():
    r = random.Random(3)
    for _ in range(200):
        unit = [r.randrange(3) for _ in range(r.randrange(1, 5))]
        texts = [repeated(r, 4), (unit * r.randrange(1, 7) + [9]) * r.randrange(1, 8), repeated(r, 2)]
        texts += [texts[0], [], [1]]
        assert P.runs_of([numbers(t) for t in texts]) == [brute(t) for t in texts]


@pytest.mark.parametrize("period", [1, 2, 50, 6000])
def test_long_texts(period):
    r = np.random.default_rng(1)
    unit, head = r.integers(5, 5000, period), r.integers(5, 5000, 3000)
    unit[-1] = 1
    text = np.concatenate([head, [2], np.resize(unit, 200_000), [3], head])
    assert P.runs_of([text]) == [[(3001, 200_000, period)]]
    assert P.runs_of([np.resize(unit, 4 * period + 2)[: 4 * period - 1]]) == [[]]


def test_grammar_derives_its_text():
    r = random.Random(5)
    y = numbers(repeated(r, 3) * 6)
    g = P.Grammar(y, np.array([0, 40, len(y)]))
    for k in range(len(g.length)):
        a, n = int(g.at[k]), int(g.size(g.left[k : k + 1])[0])
        for part, want in ((g.left[k], y[a : a + n]), (g.right[k], y[a + n : a + int(g.length[k])])):
            assert [part] == list(want) if part < g.base else list(y[g.at[part - g.base] :][: len(want)]) == list(want)
    node, place = g.derived(np.ones(len(g.length), bool))
    assert len(node) == len(y) - len(g.sym)  # every inner node of the binary derivations
    for k, a in zip(node, place):
        assert (y[a : a + g.length[k]] == y[g.at[k] :][: g.length[k]]).all()
    pairs = [(a, b) for a, b, s, t in zip(g.sym, g.sym[1:], g.seg, g.seg[1:]) if s == t]
    assert max(pairs.count(p) for p in pairs) <= 2  # only overlapping (a, a, a)


def test_documents(spark):
    r = random.Random(7)
    rows = [(i, " \t\n".join(f"w{x}" for x in repeated(r, 5))) for i in range(30)]
    rows += [(50, None), (51, ""), (52, " \n "), (53, "a a a a a"), (54, "a a a a a a"), (55, "A a A a A a A a"), (None, "b b b b b b b")]
    rows += [rows[0], (60, " ".join(words(5000, 1) + ["é", "z"] * 4)), (61, " ".join(["x"] * 30_000))]
    df = docs(spark, rows).withColumn("runs", F.lit(1)).withColumn("_found", F.lit("k"))
    got = P.find_runs(df)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "_found", "runs", "collapsed"]
    found = [(x.doc_id, [tuple(y) for y in x.runs], x.collapsed) for x in got.collect()]
    want = [(i, brute((t or "").split()), None if t is None else collapsed(t.split())) for i, t in rows]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    assert P.find_runs(spark.createDataFrame([], DOCS)).count() == 0


def test_strongest_run(spark):
    schema = "doc_id long, runs array<struct<start: long, length: long, period: long>>"
    rows = [(1, [(0, 12, 3), (20, 9, 2), (40, 18, 4)]), (2, []), (3, [(5, 8, 2), (9, 16, 4), (30, 41, 10)]), (4, None)]
    got = spark.createDataFrame(rows, schema).select("doc_id", P.strongest(F.col("runs")).alias("b")).collect()
    assert {x.doc_id: x.b and tuple(x.b) for x in got} == {1: (20, 9, 2), 2: None, 3: (30, 41, 10), 4: None}
