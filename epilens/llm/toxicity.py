"""Toxicity by a convolutional text classifier, trained in numpy.

A word's vector is the sum of hashed embeddings of the word, its first four
and six bytes and its last four bytes. Filters of widths 1, 2 and 3 run over
the word vectors, the maximum of each filter over the whole text feeds a
logistic layer. The weights are trained on a bounded sample of labelled rows
(``positives`` + ``negatives`` of those with at most ``train_chars`` characters;
smallest hashes first), of which a fifth is left out.

Scores are scaled, and thresholds set, on all labelled rows that aren't held
out, whole texts: Spark scores them and counts them by language, label and score
bin (``BIN``); only those counts reach the driver (languages x ``BINS`` x 4 at
most). The scale takes the rows that the weights have not seen. Every language
with ``MIN_PER_LANGUAGE`` rows of either label gets the threshold of best F1
among its rows, the others that of all rows. Every text is scored whole.

Scoring never multiplies per position: a filter is a sum over its offsets, so
the product of a word's vector and each offset's weights is computed once per
distinct word and looked up.

Cases: null and empty texts (and texts without words) get the score of no
evidence; labels that are null or neither 0 nor 1 are ignored; contradicting
labels both count; without both classes in the sample every score is the
smoothed share of positives and nothing is rejected; unknown languages take the overall threshold;
repeated rows each get their score; clashing ``score``, ``threshold`` and
``rejected`` columns are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epilens.llm.common import alnum_words, lean, prepare

POSITIVES, NEGATIVES, TRAIN_CHARS = 2000, 5000, 20_000
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 16, 8, 8, (1, 2, 3)
_PARTS = 4
_PAD = max(WIDTHS) - 1
_KEEP_WORDS = 100_000
MIN_PER_LANGUAGE = 5  # positives and negatives for a threshold of its own
BIN, BINS = 0.02, 1500  # of logits, around 0
LOWEST, HIGHEST = 0.3, 0.9  # bounds of a threshold: few rows may place a cut anywhere


def _buckets(word: bytes) -> tuple[int, ...]:
    return tuple(
        xxhash.xxh3_64_intdigest(part, seed) % (BUCKETS - 1) + 1
        for seed, part in enumerate((word, word[:4], word[:6], word[-4:]))
    )


class _Words(dict):
    """Word -> number from 1 on (0 is padding); new ones wait in ``new``."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self) + 1
        self.new.append(word)
        return n


def _layout(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers of all texts, padded after each, with starts and stops."""
    pad = np.zeros(_PAD, np.int64)
    ids = np.concatenate([x for t in texts for x in (t, pad)] + [pad, pad[:1]])
    stops = np.cumsum([len(t) + _PAD for t in texts]) - _PAD
    return ids, stops - np.array([len(t) for t in texts]), stops


@dataclass
class Model:
    embedding: np.ndarray
    filters: list[np.ndarray]  # per width: (width * DIM, FILTERS)
    bias: np.ndarray
    output: np.ndarray
    intercept: float
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.5

    def probability(self, logit: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * logit + b, -40, 40)))


class Scorer:
    """Logits of whole texts; word projections are kept between calls."""

    def __init__(self, model: Model):
        self.model, self.words = model, _Words()
        self.table = np.zeros((1, sum(WIDTHS) * FILTERS), np.float32)
        self.used = 1

    def _learn(self) -> None:
        new, m = self.words.new, self.model
        if not new:
            return
        x = m.embedding[np.array([_buckets(w) for w in new])].sum(axis=1)
        parts = [x @ w[j * DIM : (j + 1) * DIM] for w in m.filters for j in range(len(w) // DIM)]
        if self.used + len(new) > len(self.table):
            grown = np.zeros((max(2 * len(self.table), self.used + len(new)), self.table.shape[1]), np.float32)
            grown[: self.used] = self.table[: self.used]
            self.table = grown
        self.table[self.used : self.used + len(new)] = np.concatenate(parts, axis=1)
        self.used += len(new)
        self.words.new = []

    def logits(self, texts: list[str | None]) -> np.ndarray:
        if len(self.words) > _KEEP_WORDS:
            self.words, self.used = _Words(), 1
        m = self.model
        numbers = []
        for t in texts:
            w = alnum_words(t)
            numbers.append(np.fromiter(map(self.words.__getitem__, w), np.int64, len(w)))
        self._learn()
        out = []
        for group in _pieces(numbers):
            ids, start, stop = _layout(group)
            rows = self.table[ids]
            feats, at = [], 0
            cut = np.column_stack([start, stop]).ravel()
            n = len(ids) - _PAD
            for w in WIDTHS:
                s = rows[:n, at : at + FILTERS].copy()
                for j in range(1, w):
                    s += rows[j : j + n, at + j * FILTERS : at + (j + 1) * FILTERS]
                feats.append(np.maximum.reduceat(s, cut, axis=0)[::2])
                at += w * FILTERS
            top = np.concatenate(feats, axis=1) + m.bias
            top[start == stop] = 0
            out.append(np.maximum(top, 0) @ m.output + m.intercept)
        return np.concatenate(out).astype(np.float64) if out else np.empty(0)


def _pieces(numbers: list[np.ndarray], words: int = 1 << 15):
    """Texts together, up to about ``words`` words; a longer one alone."""
    group, size = [], 0
    for x in numbers:
        if group and size + len(x) > words:
            yield group
            group, size = [], 0
        group.append(x)
        size += len(x)
    if group:
        yield group


def fit(texts: list[str], labels: list[int], left_out: list[bool], epochs: int = 8, seed: int = 7) -> Model:
    """Train on the rows that aren't left out."""
    rng = np.random.default_rng(seed)
    model = Model(
        rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32),
        [rng.normal(0, 0.3, (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
        np.zeros(len(WIDTHS) * FILTERS, np.float32),
        rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32),
        0.0,
    )
    model.embedding[0] = 0
    y = np.array(labels, np.float64)
    if not 0 < y.sum() < len(y):
        share = (y.sum() + 0.5) / (len(y) + 2)
        model.output[:] = 0
        model.intercept, model.threshold = float(np.log(share / (1 - share))), 1.0
        return model
    words, docs = _Words(), []
    for t in texts:
        docs.append(np.fromiter(map(words.__getitem__, w := alnum_words(t)), np.int64, len(w)))
    parts = np.zeros((len(words) + 1, _PARTS), np.int64)
    if words.new:
        parts[1:] = [_buckets(w) for w in words.new]
    train = np.flatnonzero(~np.array(left_out, bool) & np.array([len(d) > 0 for d in docs]))
    _train(model, docs, parts, y, train, epochs, rng)
    return model


def calibrate(model: Model, counts: list[tuple[str | None, int, int, bool, int]]) -> Model:
    """Scale and thresholds from counts of labelled rows: (language, bin,
    label, whether the weights have seen it, rows)."""
    lang = np.array([c[0] for c in counts], object)
    logit = (np.array([c[1] for c in counts], float) + 0.5) * BIN
    y, seen, n = (np.array([c[k] for c in counts], float) for k in (2, 3, 4))
    new = seen == 0
    if min((n * y)[new].sum(), (n * (1 - y))[new].sum()) < MIN_PER_LANGUAGE:
        new[:] = True
    model.scale = _platt(logit[new], y[new], n[new])
    p = model.probability(logit)
    model.threshold = _best_cut(p, y, n)
    for own_lang in {x for x in lang if x is not None}:
        own = lang == own_lang
        if min((n * y)[own].sum(), (n * (1 - y))[own].sum()) >= MIN_PER_LANGUAGE:
            model.thresholds[own_lang] = _best_cut(p[own], y[own], n[own])
    return model


def _train(model: Model, docs, parts, y, train, epochs: int, rng, batch: int = 32, rate: float = 0.1) -> None:
    """Adagrad; a batch touches only the words that some filter's maximum
    came from."""
    seen = [np.full_like(model.embedding, 1e-6), *[np.full_like(w, 1e-6) for w in model.filters],
            np.full_like(model.bias, 1e-6), np.full_like(model.output, 1e-6)]
    seen_c = 1e-6
    n_f = FILTERS

    def step(value, total, grad):
        total += grad * grad
        value -= rate * grad / np.sqrt(total)

    for epoch in range(epochs):
        order = rng.permutation(train)
        for a in range(0, len(order), batch):
            pick = order[a : a + batch]
            ids, start, stop = _layout([docs[i] for i in pick])
            own, ids = np.unique(ids, return_inverse=True)
            vectors = model.embedding[parts[own]].sum(axis=1)
            vectors[own == 0] = 0
            x = vectors[ids]
            n = len(ids) - _PAD
            tops, wheres, wide = [], [], []
            for w, f in zip(WIDTHS, model.filters):
                z = np.concatenate([x[j : j + n] for j in range(w)], axis=1)
                s = z @ f
                at = np.array([p + s[p:q].argmax(axis=0) for p, q in zip(start, stop)])
                wheres.append(at)
                wide.append(z)
                tops.append(np.take_along_axis(s, at, axis=0))
            top = np.concatenate(tops, axis=1) + model.bias
            act = np.maximum(top, 0)
            p = 1 / (1 + np.exp(-np.clip(act @ model.output + model.intercept, -30, 30)))
            d = (p - y[pick]).astype(np.float32) / len(pick)
            d_act = d[:, None] * model.output * (top > 0)
            g_vec = np.zeros_like(vectors)
            g_filters = []
            for k, (w, f) in enumerate(zip(WIDTHS, model.filters)):
                g = d_act[:, k * n_f : (k + 1) * n_f]
                at, z = wheres[k], wide[k]
                g_f = np.empty_like(f)
                for c in range(n_f):
                    g_f[:, c] = g[:, c] @ z[at[:, c]]
                    for j in range(w):
                        np.add.at(g_vec, ids[at[:, c] + j], g[:, c, None] * f[j * DIM : (j + 1) * DIM, c])
                g_filters.append(g_f)
            g_vec[own == 0] = 0
            touched = np.flatnonzero(np.abs(g_vec).sum(axis=1))
            buckets, back = np.unique(parts[own[touched]].ravel(), return_inverse=True)
            g_e = np.zeros((len(buckets), DIM), np.float32)
            np.add.at(g_e, back.ravel(), np.repeat(g_vec[touched], _PARTS, axis=0))
            seen[0][buckets] += g_e * g_e
            model.embedding[buckets] -= rate * g_e / np.sqrt(seen[0][buckets])
            for k, g_f in enumerate(g_filters):
                step(model.filters[k], seen[1 + k], g_f)
            step(model.bias, seen[-2], d_act.sum(axis=0))
            step(model.output, seen[-1], d @ act)
            g_c = float(d.sum())
            seen_c += g_c * g_c
            model.intercept -= rate * g_c / np.sqrt(seen_c)


def _platt(logit: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic fit with smoothed targets (Newton). n:
    rows that each entry counts for."""
    n1, n0 = (n * y).sum(), (n * (1 - y)).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * logit + b, -40, 40)))
        w = n * (p * (1 - p) + 1e-9)
        r = n * (p - target)
        h = np.array([[(w * logit * logit).sum() + 1e-6, (w * logit).sum()], [(w * logit).sum(), w.sum() + 1e-6]])
        da, db = np.linalg.solve(h, [(r * logit).sum(), r.sum()])
        size = max(abs(da), abs(db))
        a, b = a - da / max(1, size), b - db / max(1, size)
        if size < 1e-6:
            break
    return (float(a), float(b)) if a > 0 else (1.0, 0.0)


def _best_cut(p: np.ndarray, y: np.ndarray, n: np.ndarray) -> float:
    """The cut with the best F1, halfway between neighbouring scores; ties go
    to the cut nearest 0.5. n: rows that each entry counts for."""
    order = np.argsort(-p, kind="stable")
    s, hits = p[order], np.cumsum((n * y)[order])
    f1 = 2 * hits / (np.cumsum(n[order]) + (n * y).sum())
    after = np.append(s[1:], 0.0)
    cut = (s + after) / 2
    f1[s == after] = -1  # a cut cannot part equal scores
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    return float(np.clip(cut[best[np.argmin(np.abs(cut[best] - 0.5))]], LOWEST, HIGHEST))


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5: 0 is held out from training."""
    return F.crc32(doc_id.cast("string")) % 5


def train(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    label: str = "toxic",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    train_chars: int = TRAIN_CHARS,
) -> Model:
    """Fit on a bounded sample of the labelled rows that aren't held out, then
    calibrate on all of them. The sample's label rows are drawn first, so that
    they can be broadcast and no text is shuffled for them."""
    spark = docs.sparkSession
    prepare(spark)
    own = labels.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{label}`").cast("int").alias("_y"))
    own = own.where(F.col("_id").isNotNull() & (remainder(F.col("_id")) != 0) & F.col("_y").isin(0, 1)).distinct()
    own = own.withColumn("_h", F.xxhash64("_id", "_y"))
    texts = docs.select(
        F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").alias("_text"), F.col(f"`{lang}`").alias("_lang")
    )
    short = F.length("_text") <= train_chars
    usable = own.join(texts.where(short).select("_id").distinct(), "_id", "left_semi")
    sample = None
    for y, n in ((1, positives), (0, negatives)):
        part = usable.where(F.col("_y") == y).orderBy("_h").limit(n)
        sample = part if sample is None else sample.unionByName(part)
    rows = (
        texts.where(short)
        .join(F.broadcast(sample), "_id")
        .orderBy("_h", F.xxhash64("_text"), "_lang")
        .limit(positives + negatives)
        .select("_text", "_y", "_id")
        .collect()
    )
    y, left_out = np.array([r[1] for r in rows], int), np.arange(len(rows)) % 5 == 4
    if min((y[left_out] == 1).sum(), (y[left_out] == 0).sum()) < MIN_PER_LANGUAGE:
        left_out[:] = False  # too few to part
    model = fit([r[0] for r in rows], y.tolist(), left_out.tolist())
    if not 0 < y.sum() < len(y):
        return model
    trained = sorted({(r[2], r[1]) for r, out in zip(rows, left_out) if not out})  # of the sample
    trained = spark.createDataFrame(trained, own.select("_id", "_y").schema).withColumn("_seen", F.lit(True))
    logit = _logits(spark, model)(F.col("_text"))
    place = F.greatest(F.lit(-BINS // 2), F.least(F.lit(BINS // 2 - 1), F.floor(logit / BIN)))
    # scored before the join, which then moves a few numbers per row and no text
    binned = texts.select("_id", "_lang", place.cast("int").alias("_bin"), F.coalesce(short, F.lit(False)).alias("_short"))
    marked = binned.join(own, "_id").join(F.broadcast(trained), ["_id", "_y"], "left")
    marked = marked.select("_lang", "_bin", "_y", (F.col("_seen").isNotNull() & F.col("_short")).alias("_seen"))
    return calibrate(model, [tuple(r) for r in marked.groupBy("_lang", "_bin", "_y", "_seen").count().collect()])


def _logits(spark: SparkSession, model: Model):
    """A function of a text column: the model's logit before it is scaled."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def run(texts):
            scorer = Scorer(sent.value)
            for s in texts:
                own = [x if isinstance(x, str) else None for x in s.tolist()]
                yield pd.Series(np.concatenate([scorer.logits(own[a : a + 256]) for a in range(0, len(own), 256)] or [np.empty(0)]))

        yield from lean(run)(texts)

    return of


def score(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` with ``score`` (from the text alone), the language's
    ``threshold`` and ``rejected``."""
    prepare(docs.sparkSession)
    slope, shift = model.scale
    logit = F.lit(slope) * _logits(docs.sparkSession, model)(F.col(f"`{text}`")) + F.lit(shift)
    p = 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), logit))))
    cut = F.lit(model.threshold)
    for name, value in sorted(model.thresholds.items()):
        cut = F.when(F.col(f"`{lang}`") == name, F.lit(value)).otherwise(cut)
    keep = [c for c in docs.columns if c.lower() not in ("score", "threshold", "rejected")]
    return (
        docs.select(*[F.col(f"`{c}`") for c in keep])
        .withColumn("score", p)
        .withColumn("threshold", cut)
        .withColumn("rejected", F.col("score") >= F.col("threshold"))
    )
