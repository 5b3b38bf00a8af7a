"""What must not go wrong at scale: new files are seen, unknown years fail,
large sums stay exact, zero totals give nulls, staged files go."""

import datetime as dt
import glob

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from epilens.operators import chartdata
from epilens.plans import queries as Q
from epilens.session import release_staging, staging_path
from epilens.sources import driver_tables as D
from epilens.sources import read_parquet


def test_appended_files_are_seen(spark):
    path = staging_path(spark, "t-append")
    spark.range(10).write.parquet(path)
    assert read_parquet(spark, path).count() == 10
    spark.range(10).write.mode("append").parquet(path)
    assert read_parquet(spark, path).count() == 20


def _shipments(spark, lines, suppliers=((1, 0), (2, 1))):
    root = staging_path(spark, "t-ship")
    li = spark.createDataFrame(lines, "l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_shipdate timestamp")
    li.withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp_ntz")).write.parquet(f"{root}/lineitem.parquet")
    spark.createDataFrame(list(suppliers), "s_suppkey long, s_nationkey int").write.parquet(f"{root}/supplier.parquet")
    spark.createDataFrame([(0, "A", 0), (1, "B", 0)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{root}/nation.parquet")
    spark.createDataFrame([(0, "R")], "r_regionkey int, r_name string").write.parquet(f"{root}/region.parquet")
    return root


def test_unknown_ship_year_fails(spark):
    root = _shipments(spark, [(1, 1.0, 10.0, 0.1, dt.datetime(2002, 5, 1)), (1, 1.0, 10.0, 0.1, dt.datetime(1996, 5, 1))])
    with pytest.raises(Exception, match="no column for ship year 2002"):
        D.indicator_wide(spark, root, "arrivals").collect()
    one = D.indicator_wide(spark, root, "arrivals", ("1996",)).collect()
    assert {r["Country Code"]: r["1996"] for r in one} == {"N00": 1.0, "R00": 1.0, "WLD": 1.0}


def test_large_sums_and_no_revenue(spark):
    big = 6e14  # dollars: two nations below, their world row beyond a long after scaling
    lines = [(1, 1.0, big, 0.05, dt.datetime(1996, 1, 1)), (2, 1.0, big, 0.15, dt.datetime(1996, 1, 1)), (1, 1.0, 0.0, 0.0, dt.datetime(1997, 1, 1))]
    got = {r["Country Code"]: (r["1996"], r["1997"]) for r in D.indicator_wide(spark, _shipments(spark, lines), "expenditure").collect()}
    assert got["N00"] == (5.0, None) and got["N01"] == (15.0, None) and got["WLD"] == (10.0, None)


def test_one_read_gives_the_values_of_both_tables(spark):
    pair = {r["iso3"]: (r["expenditure"], r["arrivals"]) for r in D.indicator_pair(spark, SF_SMALL, "1996", "1998").collect()}
    e = {r["Country Code"]: r["1996"] for r in D.indicator_wide(spark, SF_SMALL, "expenditure").collect()}
    a = {r["Country Code"]: r["1998"] for r in D.indicator_wide(spark, SF_SMALL, "arrivals").collect()}
    assert pair and pair == {k: (e[k], a[k]) for k in pair}


def test_zero_total_gives_null_shares(spark):
    df = spark.createDataFrame([("a", 0), ("b", 0)], "k string, v long")
    assert {r["k"]: r["share"] for r in chartdata.share_by_key(df, "k", "v").collect()} == {"a": None, "b": None}


def test_staged_files_go(spark):
    names = ["scan_csv_inferred", "scan_csv_delimiter", "schema_columns", "stream_totals_by_date", "rank_keys_by_measure", "lag_bucketed"]
    for name in names * 2:
        Q.QUERIES[name](spark, SF_SMALL).collect()
    folder = staging_path(spark, "t").rsplit("/", 1)[0].removeprefix("file:")
    assert glob.glob(f"{folder}/*")
    release_staging(spark)
    assert not glob.glob(f"{folder}/*")


def test_checkpoint_folder_must_be_named_on_a_cluster(monkeypatch):
    from epilens import session

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())
