import base64
import random

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from epilens.llm import bpe

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.Vocabulary(bpe.read_ranks(RANKS)), P.PATTERN)


def texts():
    r = random.Random(5)
    out = [None, "", " ", "\n\n  \t x", "<|endoftext|> hi", "it's we'll I'd", "a" * 5000, " " * 3000 + "b", "日本語 テキスト 🙂🙂" * 20, "\x00\x01￾"]
    out += ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(0xA0, 0x250), r.randrange(0x4E00, 0x4F00)])) for _ in range(200)) for _ in range(30)]
    out += ["".join(r.choice("abcxyz") for _ in range(r.randrange(1, 400))) for _ in range(60)]
    return out


def test_equals_the_public_encoder(encoder, reference):
    for t in texts():
        assert encoder.encode(t).tolist() == reference.encode_ordinary(t or "")


def test_documents_equal_the_public_encoder(spark, reference):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    for r in bpe.encode(rows, RANKS, P.PATTERN).collect():
        assert r.token_ids == reference.encode_ordinary(r.text)


def test_perfect_hash_is_minimal_and_perfect():
    keys = [f"k{i}".encode() for i in range(3000)]
    h = bpe.PerfectHash(keys)
    assert sorted(h.slot.tolist()) == list(range(3000))
    assert [h.candidate(k) for k in keys] == list(range(3000))


def test_round_trip_nulls_repeats_and_clashing_columns(spark):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "x"), (5, "it's we'll I'd")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("token_ids", F.lit("old")).withColumn("decoded", F.lit(1))
    back = bpe.decode(bpe.encode(df, RANKS, P.PATTERN), RANKS)
    assert back.columns == ["doc_id", "text", "token_ids", "decoded"]
    got = back.collect()
    assert len(got) == len(rows) and all(bytes(r.decoded).decode() == (r.text or "") for r in got)
    assert bpe.encode(df.limit(0), RANKS, P.PATTERN).count() == 0


def test_ids_outside_the_vocabulary(spark):
    for ids in ([50256], [-1], [None]):
        with pytest.raises(Exception, match="outside the vocabulary"):
            bpe.decode(spark.createDataFrame([(ids,)], "token_ids array<int>"), RANKS).collect()
    null = spark.createDataFrame([(None,)], "token_ids array<int>")
    assert bytes(bpe.decode(null, RANKS).first().decoded) == b""
