import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from epilens.llm import decontaminate as D
from epilens.llm import fm_index
from epilens.llm.common import alnum_words
from util import DOCS, docs, text, words


@pytest.mark.parametrize("n,v", [(1, 1), (6, 2), (300, 3), (3000, 5), (3000, 700)])
def test_index_equals_brute_force(n, v):
    r = np.random.default_rng(n)
    s = np.concatenate([r.integers(1, v + 1, n), [0]])
    plain = s.tolist()
    assert fm_index.suffix_array(s).tolist() == sorted(range(len(plain)), key=lambda i: plain[i:])
    index = fm_index.FMIndex(s)
    for m in (1, 2, 4):
        patterns = r.integers(1, v + 1, (40, m))
        got = {(int(p), int(i)) for ps, at in index.occurrences(patterns) for p, i in zip(ps, at)}
        want = {(k, i) for k in range(40) for i in range(len(plain) - m + 1) if plain[i : i + m] == patterns[k].tolist()}
        assert got == want


def test_wavelet_ranks():
    r = np.random.default_rng(1)
    x = r.integers(0, 37, 1000)
    tree = fm_index.WaveletMatrix(x, 37)
    c, i = r.integers(0, 37, 300), r.integers(0, 1001, 300)
    assert tree.rank(c, i).tolist() == [int((x[:b] == a).sum()) for a, b in zip(c, i)]
    at = r.integers(0, 1000, 300)
    symbol, before = tree.access_rank(at)
    assert symbol.tolist() == x[at].tolist() and before.tolist() == [int((x[:b] == x[b]).sum()) for b in at]


def brute(doc_rows, item_rows, width=10):
    found = []
    for i, t in doc_rows:
        w = alnum_words(t)
        hit, items = set(), set()
        for item, x in item_rows:
            y = alnum_words(x)
            n = min(width, len(y))
            own = {tuple(y[k : k + n]) for k in range(len(y) - n + 1)} if y else set()
            for k in range(len(w) - n + 1) if own else ():
                if tuple(w[k : k + n]) in own:
                    hit.update(range(k, k + n))
                    if item is not None:
                        items.add(item)
        found.append((i, len(w), len(hit), sorted(items)))
    return sorted(found, key=str)


def corpus():
    r = random.Random(2)
    items = [(i, text(30, 500 + i)) for i in range(12)] + [(20, "short one"), (21, ""), (22, None), (23, "...")]
    items += [(3, items[3][1]), (None, text(20, 900)), (30, "the " * 12), (31, items[5][1] + " tail words")]
    rows = []
    for i in range(60):
        w = words(r.randrange(1, 200), i)
        if i % 3 == 0:
            passage = (items[i % 12][1]).split()
            a = r.randrange(len(w) + 1)
            w[a:a] = passage[r.randrange(0, 15) :][: r.choice([9, 10, 14, 30])]
        rows.append((i, " ".join(w)))
    rows += [(100, None), (101, ""), (102, "Short, ONE!"), (103, "the " * 40), (104, "the " * 9), (105, rows[3][1]), (3, rows[3][1])]
    rows += [(None, items[2][1]), (106, " ".join(words(900, 7) + items[4][1].split() + words(900, 8)))]
    return rows, items


@pytest.mark.parametrize("shard,block", [(1 << 20, 1 << 25), (150, 1 << 25), (37, 1 << 25), (1 << 20, 2000)])
def test_equals_brute_force(spark, shard, block):
    rows, items = corpus()
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = docs(spark, rows).withColumn("spans", F.lit("x")).withColumn("items", F.lit(1))
    got = D.find_contamination(df, bench, shard_words=shard, block_bytes=block, cleaned=True).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got), key=str) == brute(rows, items)
    for r in got:
        assert sum(s.stop - s.start for s in r.spans) == r.n_hit
        assert len(alnum_words(r.cleaned)) == r.n_words - r.n_hit
    plain = {i: t for i, t in rows}
    assert all(r.cleaned == plain[r.doc_id] for r in got if not r.n_hit)


def test_removed_spans_leave_the_rest():
    assert D.remove_spans("Ä b, c! d--e", [(1, 3)]) == "Ä ! d--e"
    assert D.remove_spans("a b c", [(0, 1), (2, 3)]) == " b "


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    d = docs(spark, [(1, "a b c")])
    assert [(r.n_words, r.n_hit) for r in D.find_contamination(d, none).collect()] == [(3, 0)]
    assert D.find_contamination(spark.createDataFrame([], DOCS), none).count() == 0


def test_blocks_with_a_long_item_repeats_and_shuffled_rows(spark):
    """One item is most of the benchmark, another one stands in it many times,
    and the documents come out of a shuffle."""
    long = text(3000, 77).split()
    items = [(1, " ".join(long)), *[(2, text(25, 5)) for _ in range(400)], *[(100 + k, " ".join(long[40:55])) for k in range(60)], (3, "tiny item")]
    rows = [(i, " ".join(words(20, i) + long[13 * i : 13 * i + 9 + i % 5] + words(20, 90 + i))) for i in range(80)]
    rows += [(200, text(25, 5)), (201, "A tiny  ITEM here"), (None, " ".join(long[:30])), (200, text(25, 5)), (202, None)]
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(5)
    shuffled = docs(spark, rows).repartition(7, "text").withColumn("_row", F.lit("mine"))
    for block in (1 << 25, 60_000, 15_000):
        got = D.find_contamination(shuffled, bench, block_bytes=block, cleaned=True, keep=["doc_id", "_row"]).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got), key=str) == brute(rows, items)
        assert all(len(alnum_words(r.cleaned)) == r.n_words - r.n_hit and r._row == "mine" for r in got)


def test_window_table(spark):
    items = [(1, "a b c d"), (1, "a b c d"), (2, "A, b! C"), (3, ""), (None, "a b c")]
    got = D.window_table(spark.createDataFrame(items, "item_id long, text string"), width=3).collect()
    assert sorted(((r.item_id, bytes(r.window)) for r in got), key=str) == sorted(
        [(1, b"a b c"), (1, b"b c d"), (2, b"a b c"), (None, b"a b c")], key=str
    )
