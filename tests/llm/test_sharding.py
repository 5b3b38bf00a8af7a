import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from epilens.llm import sharding


def test_table_is_even_and_stable():
    names = [f"s{i}" for i in range(20)]
    a = sharding.lookup_table(names, 5003)
    counts = np.bincount(a, minlength=20)
    assert counts.min() >= 5003 // 20 and counts.max() <= 5003 // 20 + 1
    b = sharding.lookup_table(names[:-1], 5003)
    stays = a != 19
    assert (a[stays] == b[stays]).mean() > 0.9  # hardly a slot of the others moves
    back = sharding.lookup_table(names[::-1], 5003)
    assert [names[k] for k in a] == [names[::-1][k] for k in back]


def test_bad_arguments():
    for shards, size in ((["a", "a"], 11), ([], 11), (["a"], 12), (["a", "b", "c"], 2)):
        with pytest.raises(ValueError):
            sharding.lookup_table(shards, size)


def test_placement_equals_brute_force(spark):
    rows = [(i, str(i % 7)) for i in range(500)] + [(None, None), (None, "x"), (3, "3")]
    df = spark.createDataFrame(rows, "doc_id long, source string").withColumn("shard", F.lit("old")).withColumn("_hot", F.lit(1))
    owner = sharding.lookup_table(sharding.SHARDS, sharding.TABLE_SIZE)

    def want(i):
        h = hashlib.md5((b"\x00" if i is None else str(i).encode())).hexdigest()[:15]
        slot = int(h, 16) % sharding.TABLE_SIZE
        return slot, sharding.SHARDS[owner[slot]]

    got = sharding.place(df, ["doc_id"])
    assert sorted(map(str, got.select("doc_id", "slot", "shard").collect())) == sorted(
        map(str, (got.sparkSession.createDataFrame([(i, *want(i)) for i, _ in rows], "doc_id long, slot int, shard string").collect()))
    )
    assert sharding.place(df.limit(0), ["doc_id"]).count() == 0


def test_hot_key_is_spread(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") < 1000, "hot").otherwise(F.col("id").cast("string")).alias("source"))
    df = df.withColumn("_hot", F.lit(1)).withColumn("_k0", F.lit(1))
    shards = [f"s{i}" for i in range(8)]
    plain = Counter(r.shard for r in sharding.place(df, ["source"], shards, 211).collect())
    even = Counter(r.shard for r in sharding.place(df, ["source"], shards, 211, spread=["id"]).collect())
    assert max(plain.values()) > 1000 and max(even.values()) < 700 and sum(even.values()) == 3000


def test_write_shards(spark, tmp_path):
    df = spark.range(200).withColumn("text", F.lit("t"))
    sharding.write_shards(df, str(tmp_path / "out"), key=["id"], shards=["a", "b"], size=11)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 200 and {r.shard for r in back.select("shard").distinct().collect()} == {"a", "b"}
