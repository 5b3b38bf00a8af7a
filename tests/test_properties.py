"""Property tests: invariants that must hold on any input."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF_SMALL
from epilens.operators import chartdata, correlation, ordering
from epilens.operators.ordering import global_lag, global_row_number
from epilens.plans import queries as Q

HSET = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@HSET
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(-5, 5)), min_size=1, max_size=60))
def test_global_row_number_matches_window(spark, rows):
    data = [(i, k, v) for i, (k, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "id long, k long, v long")
    got = {r["id"]: r["rn"] for r in global_row_number(df, ["k", "v", "id"], "rn", num_ranges=4, descending=["v"]).collect()}
    ref = df.withColumn("rn", F.row_number().over(Window.orderBy("k", F.col("v").desc(), "id")))
    assert got == {r["id"]: r["rn"] for r in ref.collect()}


@pytest.mark.parametrize("num_ranges", [1, 5, 40])
def test_global_lag_matches_window_with_hot_key(spark, num_ranges):
    rnd = random.Random(7)
    # one timestamp holds a third of the rows: ties broken by the id
    data = [(i, 0 if i % 3 == 0 else rnd.randint(1, 40), rnd.choice([None, rnd.randint(-9, 9)])) for i in range(150)]
    df = spark.createDataFrame(data, "id long, ts long, v long")
    got = {r["id"]: r["prev"] for r in global_lag(df, "v", ["ts", "id"], "prev", num_ranges=num_ranges).collect()}
    ref = df.withColumn("prev", F.lag("v").over(Window.orderBy("ts", "id")))
    assert got == {r["id"]: r["prev"] for r in ref.collect()}


def test_new_cases_sum_telescopes(spark):
    df = Q.q_daily_new_cases(spark, SF_SMALL)
    rows = sorted(df.collect(), key=lambda r: r["Date"])
    total_new = sum(r["Number of New Cases"] for r in rows[1:])
    assert total_new == rows[-1]["Number_Of_Cases"] - rows[0]["Number_Of_Cases"]


def test_new_cases_equal_monthly_observations(spark):
    """Each month's change of the worldwide cumulative total is that month's
    new Confirmed cases (series are carried forward, never dropped)."""
    from epilens.sources import new_cases

    obs = {r[0]: r[1] for r in new_cases(spark, SF_SMALL).where("Case_Type = 'Confirmed'").groupBy("month").agg(F.sum("new_cases")).collect()}
    for r in Q.q_daily_new_cases(spark, SF_SMALL).collect():
        if r["Number of New Cases"] is not None:
            assert r["Number of New Cases"] == obs.get(r["Date"], 0)


def test_shares_add_up_to_one(spark):
    df = Q.q_chart_share_by_key(spark, SF_SMALL)
    assert sum(r["share"] for r in df.collect()) == pytest.approx(1.0, abs=1e-12)


@HSET
@given(
    st.lists(st.tuples(st.floats(-1e3, 1e3), st.floats(-1e3, 1e3)), min_size=3, max_size=30),
    st.floats(0.5, 20),
    st.floats(-100, 100),
)
def test_corr_symmetric_and_linear_invariant(spark, pts, a, b):
    df = spark.createDataFrame(pts, "x double, y double").withColumn("z", F.col("x") * a + b)
    (r1,) = correlation.correlation(df, "x", "y").collect()
    (r2,) = correlation.correlation(df, "y", "x").collect()
    (r3,) = correlation.correlation(df, "z", "y").collect()
    if r1["correlation"] is None:
        assert r2["correlation"] is None
        return
    assert r1["correlation"] == pytest.approx(r2["correlation"], abs=1e-9)
    if r3["correlation"] is not None:
        assert r1["correlation"] == pytest.approx(r3["correlation"], abs=1e-6)


def test_all_pairs_equal_separate_queries(spark):
    pairs = {(r["measure"], r["factor"]): r["correlation"] for r in Q.q_corr_all_pairs(spark, SF_SMALL).collect()}
    for name in ("corr_population_cases", "corr_population_deaths", "corr_expenditure_cases",
                 "corr_expenditure_deaths", "corr_arrivals_cases", "corr_arrivals_deaths"):
        (r,) = Q.QUERIES[name](spark, SF_SMALL).collect()
        assert pairs[(r["measure"], r["factor"])] == pytest.approx(r["correlation"], abs=1e-9) or (
            pairs[(r["measure"], r["factor"])] is None and r["correlation"] is None
        )


def test_share_total_from_subquery_equals_sum(spark):
    df = spark.createDataFrame([("a", 1), ("b", 3), ("a", 4)], "k string, v long")
    got = {r["k"]: r["share"] for r in chartdata.share_by_key(df, "k", "v").collect()}
    assert got == {"a": 5 / 8, "b": 3 / 8}


def test_a_hot_value_is_split_over_buckets(spark):
    """No bucket holds most rows of a value with a third of all rows."""
    data = [(i, 5 if i % 3 == 0 else i) for i in range(3000)]
    df = spark.createDataFrame(data, "id long, k long")
    for down in ((), ["k"], ["id"], ["k", "id"]):
        sizes = [r["count"] for r in ordering._bucketed(df, ["k", "id"], down, 12).groupBy("_bucket").count().collect()]
        assert sum(sizes) == 3000 and max(sizes) < 600
        got = {r["id"]: r["rn"] for r in global_row_number(df, ["k", "id"], "rn", 12, down).collect()}
        order = [F.col(c).desc() if c in down else F.col(c) for c in ("k", "id")]
        ref = df.withColumn("rn", F.row_number().over(Window.orderBy(*order)))
        assert got == {r["id"]: r["rn"] for r in ref.collect()}


def test_nulls_in_a_global_order(spark):
    data = [(i, None if i % 4 == 0 else i % 7) for i in range(200)]
    df = spark.createDataFrame(data, "id long, k long")
    for down, key in (((), F.col("k").asc_nulls_first()), (["k"], F.col("k").desc_nulls_last())):
        got = {r["id"]: r["rn"] for r in global_row_number(df, ["k", "id"], "rn", 6, down).collect()}
        ref = df.withColumn("rn", F.row_number().over(Window.orderBy(key, "id")))
        assert got == {r["id"]: r["rn"] for r in ref.collect()}


def test_global_row_number_with_default_ranges(spark):
    """Numbering equals the single-partition window, also with a hot value."""
    rnd = random.Random(3)
    data = [(i, 5 if i % 3 == 0 else rnd.randint(0, 10_000)) for i in range(3000)]
    df = spark.createDataFrame(data, "id long, k long")
    got = {r["id"]: r["rn"] for r in global_row_number(df, ["k", "id"], "rn", descending=["k"]).collect()}
    ref = df.withColumn("rn", F.row_number().over(Window.orderBy(F.col("k").desc(), "id")))
    assert got == {r["id"]: r["rn"] for r in ref.collect()}


@HSET
@given(st.lists(st.integers(-10**9, 10**9), min_size=1, max_size=50), st.sampled_from([100, 1000, 10000]))
def test_cents_equals_round(spark, ints, scale):
    from epilens.functions import cents

    vals = [i / scale for i in ints] + [0.125, -0.125, 1.005, 2.675, -2.675, 12.5 / 100]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    rows = df.select(cents("x").alias("a"), F.round(F.col("x") * 100).cast("bigint").alias("b")).collect()
    assert all(r["a"] == r["b"] for r in rows)
