"""Small fixtures of the operators' tests."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed, vocabulary=4000):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}é" if r.random() < 0.1 else f"w{r.randrange(vocabulary)}" for _ in range(n)]


def text(n, seed):
    return " ".join(words(n, seed))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)
