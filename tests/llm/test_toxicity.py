import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from epilens.llm import toxicity as T
from util import DOCS, words

BAD = {"en": ["scumbag", "moronic", "trashy"], "de": ["loweist", "loweien", "loweung"]}


def corpus(n=900, seed=3):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        lang = r.choice(["en", "de"])
        w = words(r.randrange(5, 120), 5000 + i)
        toxic = int(r.random() < 0.25)
        for _ in range(r.randrange(1, 4) * toxic):
            w.insert(r.randrange(len(w) + 1), r.choice(BAD[lang]))
        rows.append((i, " ".join(w), lang, "s", 1))
        labels.append((i, 1, toxic))
    return rows, labels


@pytest.fixture(scope="module")
def fitted(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, DOCS)
    model = T.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    return rows, labels, docs, model


def test_held_out_accuracy_and_thresholds(fitted):
    rows, labels, docs, model = fitted
    held = {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    got = {r.doc_id: r for r in T.score(docs, model).collect()}
    truth = {i: y for i, _, y in labels}
    wrong = sum((got[i].score >= 0.5) != (truth[i] == 1) for i in held)
    assert len(held) > 100 and wrong <= 0.03 * len(held)
    assert sum(got[i].rejected != (truth[i] == 1) for i in held) <= 0.03 * len(held)
    assert set(model.thresholds) == {"en", "de"} and all(0 <= r.score <= 1 for r in got.values())
    # a form of a stem that training never saw
    unseen = T.Scorer(model).logits(["w1 w2 loweiheit w3", "w1 w2 w3 w4"])
    assert unseen[0] > unseen[1] + 1


def test_held_out_rows_are_never_learnt(spark, fitted):
    rows, labels, docs, model = fitted
    flipped = [(i, q, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, q, y in labels]
    again = T.train(docs, spark.createDataFrame(flipped, "doc_id long, quality int, toxic int"))
    assert np.array_equal(model.embedding, again.embedding) and model.scale == again.scale
    r = spark.range(50).select("id", T.remainder(F.col("id")).alias("m")).collect()
    assert all(x.m == zlib.crc32(str(x.id).encode()) % 5 for x in r)


def test_score_depends_on_the_text_alone_and_on_all_of_it(spark, fitted):
    model = fitted[3]
    long = " ".join(words(40_000, 1))
    rows = [(1, long, "en", "s", 1), (2, long + " scumbag", "en", "s", 1), (3, "scumbag moronic", None, None, None), (4, "scumbag moronic", "xx", "t", 9),
            (5, None, "en", "s", 0), (6, "", "de", "s", 0), (7, "?! .", "de", "s", 0), (None, "scumbag moronic", "de", "s", 1), (3, "scumbag moronic", None, None, None)]
    df = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("x")).withColumn("rejected", F.lit(2))
    out = T.score(df, model)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "score", "threshold", "rejected"]
    got = out.collect()
    s = {(r.doc_id, r.lang): r for r in got}
    assert len(got) == len(rows) and s[2, "en"].score > s[1, "en"].score + 0.2
    assert s[3, None].score == s[4, "xx"].score == s[None, "de"].score > 0.5 and s[3, None].threshold == model.threshold
    assert s[5, "en"].score == s[6, "de"].score == s[7, "de"].score < 0.5
    assert T.score(df.limit(0), model).count() == 0


def test_pieces_do_not_change_scores(fitted, monkeypatch):
    rows, _, _, model = fitted
    texts = [t for _, t, *_ in rows[:80]] + ["", None]
    whole = T.Scorer(model).logits(texts)
    monkeypatch.setattr(T, "_KEEP_WORDS", 50)
    one = T.Scorer(model)
    assert np.allclose(whole, [one.logits([t])[0] for t in texts], atol=1e-4)


@pytest.mark.parametrize("labels", [[], [(1, 1, 0), (2, 1, 0)], [(1, 1, 1)], [(1, 1, None), (None, 1, 1), (2, 1, 7)]])
def test_few_or_odd_labels(spark, labels):
    docs = spark.createDataFrame([(1, "a b", "en", "s", 3), (2, "c", None, "s", 1), (2, None, "en", "s", 1)], DOCS)
    model = T.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert all(0 <= r.score <= 1 and not r.rejected for r in T.score(docs, model).collect())


def test_best_cut():
    p, y = np.array([0.9, 0.8, 0.3, 0.2, 0.2]), np.array([1, 1, 0, 0, 0])
    assert T._best_cut(p, y, np.ones(5)) == pytest.approx(0.55)
    assert T._best_cut(np.array([0.4, 0.4]), np.array([1, 0]), np.ones(2)) == T.LOWEST
    # entries that count for several rows
    assert T._best_cut(np.array([0.9, 0.8, 0.4]), np.array([1, 0, 1]), np.array([1, 3, 30])) == T.LOWEST
    assert T._best_cut(np.array([0.9, 0.8, 0.4]), np.array([1, 0, 1]), np.array([9, 30, 1])) == pytest.approx(0.85)


def test_every_language_with_labels_of_both_kinds_has_its_threshold(spark):
    """Also one whose few rows lie outside the sample, or are too long for it."""
    rows, labels = corpus()
    long = " ".join(words(8000, 1))
    for k in range(10):
        rows.append((2000 + k, (long if k < 4 else "w1 w2 ") + (" scumbag moronic" if k % 2 else ""), "es", "s", 1))
        labels.append((2000 + k, 1, k % 2))
    ids = [i for i, _, lang, *_ in rows if lang == "es" and zlib.crc32(str(i).encode()) % 5]
    few = min(sum(i % 2 for i in ids), sum(1 - i % 2 for i in ids))
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = T.train(docs, marks, positives=80, negatives=200)
    assert ("es" in model.thresholds) == (few >= T.MIN_PER_LANGUAGE) and {"en", "de"} <= set(model.thresholds)
    monkey = T.MIN_PER_LANGUAGE
    try:
        T.MIN_PER_LANGUAGE = 3
        assert set(T.train(docs, marks, positives=80, negatives=200).thresholds) == {"en", "de", "es"}
    finally:
        T.MIN_PER_LANGUAGE = monkey


def test_long_texts_leave_their_place_in_the_sample(spark, monkeypatch):
    rows, labels = corpus(300)
    kept = []
    monkeypatch.setattr(T, "fit", lambda texts, y, left_out: kept.append((texts, y)) or T.Model(np.zeros((T.BUCKETS, T.DIM), np.float32), [np.zeros((w * T.DIM, T.FILTERS), np.float32) for w in T.WIDTHS], np.zeros(24, np.float32), np.zeros(24, np.float32), 0.0))
    T.train(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), positives=12, negatives=20, train_chars=300)
    texts, y = kept[0]
    assert sum(y) == 12 and len(y) == 32 and max(map(len, texts)) <= 300
