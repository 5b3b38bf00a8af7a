"""Connected components of an edge table by alternating star operations: each
node's larger neighbours are linked to its smallest one (large star), then its
smaller neighbours to the smallest (small star), until nothing changes. Every
step is a minimum per node and an equi-join; nothing but two numbers per round
reaches the driver. The rounds grow with the logarithm of the longest path.

A node may have a large part of all edges. Its minimum is taken in two steps
(a partial one in each task). Its edges are dealt over ``PARTS`` sub-nodes that
each get the minimum; both sides of that join are plain exchanges, so Spark
splits a sub-node that is still too large over more tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epilens.llm.common import cut

PARTS = 4

def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """edges (u, v) with m of least (u, m), by sub-nodes of u."""
    part = F.pmod(F.xxhash64("v"), F.lit(PARTS)).cast("int")
    each = least.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return edges.withColumn("part", part).join(each, ["u", "part"]).where("v <> m")


def _large_star(edges: DataFrame) -> DataFrame:
    """edges: u > v. Larger neighbours of a node to the smallest of it and its
    neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
    return _with_least(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """edges: u > v. Smaller neighbours of a node, and itself, to the smallest
    of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    linked = _with_least(edges, least).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.union(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest id that each node reaches, for nodes
    with an edge. Null ends, loops and repeated edges are ignored."""
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    cur = edges.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).where(
        x.isNotNull() & y.isNotNull() & (x != y)
    )
    cur, before = cut(cur.distinct()), None
    while True:
        sums = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sums == before or not sums[0]:
            break
        before = sums
        cur = cut(_small_star(_large_star(cur)).distinct())
    roots = cur.select(F.col("v").alias("node")).distinct()
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )
