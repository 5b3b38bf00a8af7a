"""The registered queries and the pipeline on the smallest tables, against
brute force."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline as P
from epilens.llm import queries as Q
from epilens.llm.common import alnum_words, space_words, table
from test_minhash import brute as near_brute
from util import DOCS

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    """The documents after each stage, as the driver runs them."""
    docs, out = table(spark, SF, "documents"), []
    for name, function in P.STAGES:
        docs = P.stage(function(spark, docs, SF), name)
        out.append((name, docs))
    return out


def test_stages_and_columns(kept):
    assert [n for n, _ in kept] == ["toxicity", "near_duplicates", "repeated_passages", "decontamination", "encoding"]
    for _, docs in kept[:-1]:
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert [f.dataType.simpleString() for f in docs.schema] == ["bigint", "string", "string", "string", "bigint"]
    assert kept[-1][1].columns == ["doc_id", "token_ids", "n_tokens", "round_trip"]


def rows(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_toxic_documents_go(spark, kept):
    before, after = rows(table(spark, SF, "documents")), rows(kept[0][1])
    assert all(before[i] == t for i, t in after.items()) and 0 < len(before) - len(after) < len(before) / 3


def test_one_of_each_group_stays(kept):
    before, after = rows(kept[0][1]), rows(kept[1][1])
    want = {i for i, _, _, k in near_brute(sorted(before.items()), 5, 80) if k}
    assert set(after) == want and all(before[i] == t for i, t in after.items())


def test_repeated_passages_go(kept):
    before, after = rows(kept[1][1]), rows(kept[2][1])
    assert set(before) == set(after)
    first = {}
    for i in sorted(after):
        w = space_words(after[i])
        for k in range(len(w) - 49):
            assert first.setdefault(tuple(w[k : k + 50]), i) == i
        assert len(w) <= len(space_words(before[i]))
    assert sum(before[i] == after[i] for i in before) > 0.7 * len(before)


def test_benchmark_passages_go(spark, kept):
    before, after = rows(kept[2][1]), rows(kept[3][1])
    items = [alnum_words(r.text) for r in table(spark, SF, "benchmark").collect()]
    windows = {tuple(w[k : k + 10]) for w in items for k in range(max(1, len(w) - 9) if w else 0)}
    hit = 0
    for i, t in before.items():
        w = alnum_words(t)
        found = any(tuple(w[k : k + n]) in windows for n in {len(x) for x in windows} for k in range(len(w) - n + 1))
        hit += found
        assert (after[i] == t) == (not found)
        v = alnum_words(after[i])
        assert not any(tuple(v[k : k + 10]) in windows for k in range(len(v) - 9))
    assert hit
    assert {r.doc_id: r.n_chars for r in kept[3][1].collect()} == {i: len(t) for i, t in after.items()}


def test_encoding_equals_the_public_encoder(kept):
    import base64

    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(Q.RANKS), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = rows(kept[3][1])
    out = kept[4][1].collect()
    assert len(out) == len(texts)
    for r in out:
        assert r.round_trip and r.token_ids == enc.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.token_ids)


def test_stages_take_nulls_repeats_and_empty_tables(spark):
    bad = [(1, None, None, None, None), (None, "a b", "en", "s", 3), (None, None, None, None, None), (2, "", "xx", "", 0), (3, "one two", "en", "s", 7), (3, "one two", "en", "s", 7)]
    for data in (bad, []):
        docs = spark.createDataFrame(data, DOCS)
        for name, function in P.STAGES:
            docs = P.stage(function(spark, docs, SF), name)
        # toxicity learns from these documents alone: nothing to learn, nothing rejected
        assert sorted(str(r.doc_id) for r in docs.collect()) == sorted(["1", "None", "None", "2", "3"] if data else [])


def test_queries_are_registered():
    assert [n for n in E.queries() if n.startswith("op")] == list(Q.QUERIES) and "pipeline" in E.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in Q.QUERIES) == list(range(1, 14))
    assert set(Q.ORACLE_SQL) <= set(Q.QUERIES) and set(Q.ORACLE_SQL) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_queries_match_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF, t)}.parquet')")
    df = Q.QUERIES[name](spark, SF)
    res = con.execute(Q.ORACLE_SQL[name])
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(df.columns)
    order = sorted(cols)
    got = sorted((tuple(r[c] for c in order) for r in df.collect()), key=repr)
    assert got == sorted((tuple(r[cols.index(c)] for c in order) for r in res.fetchall()), key=repr)


def test_contract_columns_of_the_others(spark):
    import zlib

    docs = rows(table(spark, SF, "documents"))
    for r in Q.op2_toxicity(spark, SF).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5)
    for r in Q.op9_bpe(spark, SF).collect():
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest() and r.n_tokens > 0
    assert Q.op10_sharding(spark, SF).agg(F.countDistinct("shard")).first()[0] > 50
    found = {r.doc_id: r.licenses.split(",") for r in Q.op3_licenses(spark, SF).where("n_notices > 0").collect()}
    reserved = {i for i, t in docs.items() if "all rights reserved" in t.lower()}
    assert set(found) == reserved | {i for i, t in docs.items() if "icense" in t}
    assert reserved == {i for i, names in found.items() if "All-Rights-Reserved" in names}
