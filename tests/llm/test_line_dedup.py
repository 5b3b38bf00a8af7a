import random

import numpy as np
from pyspark.sql import functions as F

from epilens.llm import line_dedup as L
from util import DOCS, docs

SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute(rows, min_docs, min_chars=1, counted=None):
    seen = {}
    for i, t in rows if counted is None else counted:
        for line in (t or "").split("\n"):
            if i is not None:
                seen.setdefault(key(line), set()).add(i)
    hot = {k for k, ids in seen.items() if len(ids) >= min_docs and len(k) >= min_chars}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if key(x) not in hot]
        out.append((i, "\n".join(stay) if t is not None else None, len(lines), len(lines) - len(stay)))
    return sorted(out, key=repr)


def table(df):
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in df.collect()), key=repr)


def corpus(n, seed):
    r = random.Random(seed)
    common = ["Share this", " share THIS\t", "Éa", "éa", "", "  ", "\x1c", "a b", "x" * 50]
    rows = []
    for i in range(n):
        lines = [r.choice(common) if r.random() < 0.3 else f"line {r.randrange(40 * n)}" for _ in range(r.randrange(1, 12))]
        rows.append((i, "\n".join(lines)))
    return rows


def test_equals_brute_force(spark):
    rows = corpus(120, 1)
    rows += [(500, None), (501, ""), (502, "\n\n"), (503, "end\n"), (504, "\r\nshare this\r\n")]
    rows += [(None, "share this\nalone"), (None, None), rows[3], (3, "another text of 3\nshare this")]
    rows += [(600, "\n".join(["word " * 40_000, "share this"]))]
    for low, chars in ((10, 1), (2, 0), (3, 3), (10**6, 1)):
        got = L.dedup_lines(docs(spark, rows), min_docs=low, min_chars=chars)
        assert table(got) == brute(rows, low, chars), (low, chars)


def test_exact_join_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(L, "BROADCAST_BYTES", -1)
    rows = corpus(80, 2)
    assert table(L.dedup_lines(docs(spark, rows), min_docs=4)) == brute(rows, 4)


def state(index):
    refs = {bytes(r.key): r.docs for r in index.refs.collect()}
    return refs, sorted((r.doc_id, bytes(r.key)) for r in index.members.collect())


def test_inserts_and_deletions_are_reversible(spark, monkeypatch):
    monkeypatch.setattr(L, "PER_SHARD", 8)
    monkeypatch.setattr(L, "LEAST_SHARDS", 2)
    rows = corpus(60, 3)
    first, more = rows[:30], rows[30:]
    base = L.build_index(docs(spark, first), min_docs=3)
    both = L.update(base, inserts=docs(spark, more))
    assert state(both) == state(L.build_index(docs(spark, rows), min_docs=3))
    assert table(L.drop_lines(docs(spark, rows), both)) == brute(rows, 3)
    ids = docs(spark, [(i, None) for i, _ in more] + [(None, None), (9999, None)])
    back = L.update(both, deletes=ids)
    assert state(back) == state(base)
    assert table(L.drop_lines(docs(spark, rows), back)) == brute(rows, 3, counted=first)
    # the filters alone: every hot key of either state is found
    for index in (base, both, back):
        found = {r.shard: L.Cuckoo(r.slots, r.stash) for r in index.filters.collect()}
        hot = [bytes(r.key) for r in index.hot().collect()]
        assert all(found[L._shard_of(k, index.shards)].has(L.Cuckoo.hashes([k]))[0] for k in hot)
        assert sum(r.hot for r in index.filters.collect()) == len(hot)
    # replaced in one call; an inserted id that is there gains lines
    new = [(0, "only this"), (5, "only this"), (7, "only this")]
    swapped = L.update(base, inserts=docs(spark, new), deletes=docs(spark, [(0, None)]))
    want = [x for x in first if x[0] != 0] + new
    assert state(swapped) == state(L.build_index(docs(spark, want), min_docs=3))
    assert table(L.drop_lines(docs(spark, want), swapped)) == brute(want, 3)
    assert L.update(base) is base


def test_cuckoo_filter_moves_stashes_and_removes():
    r = np.random.default_rng(1)
    h = r.integers(-(2**63), 2**63 - 1, 3000)
    for c in (L.Cuckoo.empty(3000), L.Cuckoo.empty(300)):  # the second far too small
        c.add(h)
        assert c.has(h).all()
        assert (len(c.stash) > 0) == (len(c.table) < 256)
        c.remove(h[:1500])
        assert c.has(h[1500:]).all()
        c.remove(h[1500:])
        assert not c.table.any() and not c.stash
    assert not L.Cuckoo.empty(0).has(h).any()
    c = L.Cuckoo.empty(3000)
    c.add(h)
    assert c.has(r.integers(-(2**63), 2**63 - 1, 100_000)).mean() < 1e-3


def test_columns_and_empty_table(spark):
    rows = [(i, "same\nown %d" % i) for i in range(12)]
    df = docs(spark, rows).withColumn("key", F.lit("k")).withColumn("_row", F.lit(1)).withColumn("n_lines", F.lit("x")).withColumn("_hot", F.lit(2))
    got = L.dedup_lines(df)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "key", "_row", "_hot", "n_lines", "n_dropped"]
    assert {(r.text, r.n_lines, r.n_dropped, r.key, r._hot) for r in got.collect()} == {(f"own {i}", 2, 1, "k", 2) for i in range(12)}
    none = spark.createDataFrame([], DOCS)
    assert L.dedup_lines(none).count() == 0
    assert table(L.drop_lines(docs(spark, rows), L.build_index(none))) == [(i, t, 2, 0) for i, t in sorted(rows, key=lambda x: repr((x[0], x[1])))]
