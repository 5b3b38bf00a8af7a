"""Sharding by a permutation-filled lookup table.

Every shard has a preference order over the slots of a table of prime size
(offset + i * skip mod size, both from hashes of the shard's name). Shards
take turns; each turn a shard claims its next preferred free slot, until the
table is full. Placement is one lookup: slot = hash of the key mod size.
Shards get nearly equal slot counts, and when a shard leaves, nearly all
slots of the others stay where they are.

The table has ``size`` entries whatever the data's size, so it is broadcast.
A key that many rows share (one source with a third of all rows) would land
in one shard: ``place`` takes ``spread`` columns, whose hash deals the rows of
such a key over ``fan_out`` shards, found by a count per key.

Cases: null keys are placed like any value (all nulls of a key together);
empty tables give no rows; repeated rows go to the same shard; a clashing
``slot`` or ``shard`` column of the input is replaced. No shard, or repeated
shard names, raise ValueError.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epilens.llm.common import fresh

TABLE_SIZE = 65_537  # prime
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def _is_prime(n: int) -> bool:
    return n >= 2 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: Sequence[str], size: int = TABLE_SIZE) -> np.ndarray:
    """For each slot the index (into ``shards``) of the shard that owns it."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be non-empty and distinct")
    if not _is_prime(size) or size < len(shards):
        raise ValueError("size must be a prime, at least the number of shards")
    draws = [hashlib.sha256(s.encode()).digest() for s in shards]
    at = [int.from_bytes(d[:8], "big") % size for d in draws]
    skip = [int.from_bytes(d[8:16], "big") % (size - 1) + 1 for d in draws]
    owner = np.full(size, -1, np.int32)
    turns = sorted(range(len(shards)), key=lambda k: shards[k])  # the order given doesn't matter
    free = size
    while free:
        for k in turns:
            while owner[at[k]] >= 0:
                at[k] = (at[k] + skip[k]) % size
            owner[at[k]] = k
            free -= 1
            if not free:
                break
    return owner


def slot_of(key: Sequence[str], size: int, salt: Column | None = None) -> Column:
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("\x00")) for k in key])
    if salt is not None:
        text = F.concat_ws("\x1e", text, salt.cast("string"))
    # 60 bits of an MD5: the same slot in any engine
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(size)).cast("int")


def place(
    df: DataFrame,
    key: Sequence[str],
    shards: Sequence[str] = SHARDS,
    size: int = TABLE_SIZE,
    spread: Sequence[str] | None = None,
    hot_share: float = 0.01,
    fan_out: int | None = None,
) -> DataFrame:
    """``df`` with ``slot`` and ``shard``.

    With ``spread``, keys that hold more than ``hot_share`` of all rows (at
    most 1 / hot_share of them, so their list is broadcast) are dealt over
    ``fan_out`` sub-keys (default: the number of shards) by the hash of the
    ``spread`` columns."""
    owner = lookup_table(shards, size)
    spark = df.sparkSession
    slots = spark.createDataFrame([(i, shards[k]) for i, k in enumerate(owner.tolist())], "slot int, shard string")
    rows = df.drop("slot", "shard")
    salt = None
    if spread:
        total = rows.count()
        names = [fresh(rows, f"_k{i}") for i in range(len(key))]
        mark = fresh(rows, "_hot")
        hot = rows.groupBy(*[F.col(f"`{k}`").alias(n) for k, n in zip(key, names)]).agg(F.count("*").alias(mark))
        hot = hot.where(F.col(mark) > F.lit(hot_share) * total)
        same = [F.col(f"`{k}`").eqNullSafe(F.col(n)) for k, n in zip(key, names)]
        on = same[0]
        for c in same[1:]:
            on = on & c
        rows = rows.join(F.broadcast(hot), on, "left").drop(*names)
        part = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in spread]), F.lit(fan_out or len(shards)))
        salt = F.when(F.col(mark).isNotNull(), part)  # null: concat_ws leaves it out
    placed = rows.withColumn("slot", slot_of(key, size, salt)).join(F.broadcast(slots), "slot")
    return placed.drop(mark) if spread else placed


def write_shards(df: DataFrame, path: str, **options) -> None:
    """One folder per shard. Rows are dealt by (shard, file) so that a large
    shard is written by several tasks."""
    placed = place(df, **options)
    placed.repartition("shard", F.pmod(F.col("slot"), F.lit(8))).write.partitionBy("shard").parquet(path)
