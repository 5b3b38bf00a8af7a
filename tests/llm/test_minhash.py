import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from epilens.llm import minhash
from epilens.llm.common import WordHash, shingle_set, space_words
from epilens.llm.components import connected_components
from util import DOCS, docs, text, words


def sets(rows, width):
    out = []
    for i, t in rows:
        w = [x for x in space_words(t)]
        out.append((i, {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()))
    return out


def brute(rows, width, percent):
    """(doc_id, n_shingles, component_id, kept) by comparing all pairs."""
    s = sets(rows, width)
    root = {i: i for i, _ in s if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(s):
        for j, b in s[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted(
        ((i, len(a), None if i is None else find(i), i is not None and find(i) == i) for i, a in s), key=repr
    )


def edited(base, share, seed):
    r = random.Random(seed)
    w = list(base)
    for _ in range(int(share * len(w))):
        w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
    return " ".join(w)


def corpus():
    rows = [(i, text(60 + 7 * i, i)) for i in range(20)]
    rows += [(100 + k, edited(words(300, 1000), 0.012, k)) for k in range(40)]  # a family of near copies
    rows += [(60, " ".join(words(300, 1000)))]  # its origin, not the smallest id
    chain = words(200, 77)
    for k in range(6):  # each is near the next one
        rows.append((200 + k, " ".join(chain)))
        chain = chain[3:] + words(3, 900 + k)
    rows += [(300, rows[3][1]), (301, rows[3][1].upper())]  # the word hash folds A-Z
    rows += [(400, "a b"), (401, "A  b"), (402, "a"), (403, "b"), (404, ""), (405, None), (406, " \t\n"), (407, "b a")]
    return rows


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_equals_brute_force(spark, width, percent):
    rows = corpus()
    got = minhash.near_duplicates(docs(spark, rows), width=width, percent=percent).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows, width, percent)


def drifting(n, seed):
    """A family without an origin: each text edits a drawn earlier one. Its
    first third of words never changes, so that its buckets are large."""
    r = random.Random(seed)
    rows = [words(200, seed)]
    for _ in range(n - 1):
        w = list(r.choice(rows))
        for _ in range(3):
            w[r.randrange(70, 200)] = f"x{r.randrange(10**6)}"
        rows.append(w)
    order = list(range(n))
    r.shuffle(order)
    return [(i, " ".join(rows[k])) for i, k in enumerate(order)]


@pytest.mark.parametrize("paired", [32, 2])  # pair by pair, and by blocks
def test_hot_family_without_origin_equals_brute_force(spark, monkeypatch, paired):
    monkeypatch.setattr(minhash, "PAIRED", paired, raising=False)
    monkeypatch.setattr(minhash, "BLOCK", 8, raising=False)
    for seed in (1, 2):
        rows = drifting(150, seed)
        got = minhash.near_duplicates(docs(spark, rows), width=3, percent=90).collect()
        assert sorted((tuple(r) for r in got), key=repr) == brute(rows, 3, 90)


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    t = text(80, 5)
    rows = [(1, t), (1, t), (None, t), (2, t), (3, text(80, 6)), (None, None), (3, t)]
    df = docs(spark, rows).withColumn("component_id", F.lit("x")).withColumn("bands", F.lit(1))
    got = sorted((tuple(r) for r in minhash.near_duplicates(df).collect()), key=repr)
    n = 76
    assert got == sorted(
        [(1, n, 1, True), (1, n, 1, True), (None, n, None, False), (2, n, 1, False), (3, n, 1, False), (3, n, 1, False), (None, 0, None, False)],
        key=repr,
    )
    kept = minhash.keep_one(df)
    assert kept.columns == df.columns
    # the second text of id 3 resembles nothing, so it stays though its other text goes
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(1, t), (3, text(80, 6)), (None, t), (None, None)], key=repr)


def test_ids_with_several_texts(spark):
    a, b, c = text(80, 1), text(80, 2), text(80, 3)
    more = f"{a} one more"
    rows = [(5, a), (5, b), (2, b), (2, more), (2, a), (7, c), (7, c), (8, ""), (8, None), (9, ""), (9, "")]
    kept = minhash.keep_one(docs(spark, rows)).collect()
    # of group {a, more} id 2 with its longer text; of group {b} id 2
    assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == sorted([(2, more), (2, b), (7, c), (8, ""), (8, None), (9, "")], key=repr)


def test_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    assert minhash.keep_one(spark.createDataFrame([], DOCS)).count() == 0


def test_densified_signature_estimates_similarity():
    h = WordHash()
    a = shingle_set(h.of(space_words(text(600, 1))), 3)
    for share in (0.5, 0.8, 0.95):
        n = int(len(a) * share)
        b = np.sort(np.concatenate([a[:n], shingle_set(h.of(space_words(text(len(a) - n + 2, 2))), 3)]))
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((minhash.signature(a) == minhash.signature(b)).mean() - j) < 0.15
    tiny = np.array([12345], np.uint64)
    assert (minhash.signature(tiny) == 12345).all()  # every empty bin is filled


def test_components_of_long_paths_and_hubs(spark):
    r = random.Random(3)
    path = [(i, i + 1) for i in range(1, 40)]
    hub = [(100, 100 + i) for i in range(1, 60)]
    edges = path + hub + [(200, 150), (300, 301), (301, 300), (7, 7), (None, 3)]
    r.shuffle(edges)
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect())
    want = {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 160)} | {200: 100, 300: 300, 301: 300}
    assert got == want
