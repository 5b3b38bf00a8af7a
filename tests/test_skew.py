"""One customer holds a third of all orders: the case-table pipeline still
gives exact results, and with broadcasts off the hot join partition is split
by AQE (skew join) instead of landing in one task."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from epilens.session import staging_path
from epilens.sources import driver_tables as D


@pytest.fixture()
def skewed_dir(spark):
    rnd = random.Random(11)
    n_orders, n_cust = 6000, 300
    customers = pd.DataFrame(
        {
            "c_custkey": range(1, n_cust + 1),
            "c_name": [f"c{i}" for i in range(1, n_cust + 1)],
            "c_nationkey": [i % 25 for i in range(1, n_cust + 1)],
            "c_acctbal": [0.0] * n_cust,
            "c_mktsegment": [["AUTOMOBILE", "BUILDING", "FURNITURE"][i % 3] for i in range(1, n_cust + 1)],
        }
    )
    hot = 7
    orders = pd.DataFrame(
        {
            "o_orderkey": range(1, n_orders + 1),
            "o_custkey": [hot if i % 3 == 0 else rnd.randint(1, n_cust) for i in range(n_orders)],
            "o_orderstatus": [rnd.choice("FOP") for _ in range(n_orders)],
            "o_totalprice": [round(rnd.uniform(1, 5000), 2) for _ in range(n_orders)],
            "o_orderdate": [dt.datetime(2000, 1, 1) + dt.timedelta(days=rnd.randint(0, 700)) for _ in range(n_orders)],
        }
    )
    root = staging_path(spark, "t-skew")
    cdf = spark.createDataFrame(customers).withColumn("c_nationkey", F.col("c_nationkey").cast("int"))
    cdf.write.parquet(f"{root}/customer.parquet")
    odf = spark.createDataFrame(orders).withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))
    odf.write.parquet(f"{root}/orders.parquet")
    return root, customers, orders


def _brute_monthly(customers, orders):
    j = orders.merge(customers, left_on="o_custkey", right_on="c_custkey")
    j["Case_Type"] = j["o_orderstatus"].map({"F": "Confirmed", "O": "Deaths", "P": "Active"})
    j["iso3"] = j["c_nationkey"].map(lambda k: f"N{k:02d}")
    j["month"] = j["o_orderdate"].map(lambda t: dt.date(t.year, t.month, 1))
    j["cents"] = (j["o_totalprice"] * 100).round().astype("int64")
    g = j.groupby(["Case_Type", "iso3", "c_mktsegment", "month"])["cents"].sum()
    return {k: int(v) for k, v in g.items()}


def test_hot_customer_exact_and_split(spark, skewed_dir):
    root, customers, orders = skewed_dir
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        monthly = D.new_cases(spark, root)
        got = {(r[0], r[1], r[2], r[3]): r[4] for r in monthly.collect()}
        assert got == _brute_monthly(customers, orders)
        monthly.write.format("noop").mode("overwrite").save()
        plan = monthly._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin(skew=true)" in plan or "skew=true" in plan
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
