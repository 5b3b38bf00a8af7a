"""Edge semantics, one test per rule."""

import datetime as dt
import math
import os

import pytest
from pyspark.sql import functions as F

from epilens.functions import parse_date, safe_corr
from epilens.operators import cleaning, contract, correlation
from epilens.session import staging_path
from epilens.sources import UnknownOptionError, read_csv, write_csv


def test_unpadded_dates_parse(spark):
    df = spark.createDataFrame([("4/9/2020",), ("04/19/2020",), ("12/1/2019",)], "d string")
    got = [r[0] for r in df.select(parse_date("d")).collect()]
    assert got == [dt.date(2020, 4, 9), dt.date(2020, 4, 19), dt.date(2019, 12, 1)]


def test_bad_date_is_null_then_dropped(spark):
    df = spark.createDataFrame([("Confirmed", 1, "AAA", 10, "not a date"), ("Confirmed", 2, "AAA", 10, "4/9/2020")],
                               "Case_Type string, Cases int, iso3 string, Population_Count int, Date string")
    clean = cleaning.clean_case_table(df)
    assert [r["Cases"] for r in clean.collect()] == [2]


def test_strict_date_raises(spark):
    df = spark.createDataFrame([("not a date",)], "d string")
    with pytest.raises(Exception):
        df.select(parse_date("d", strict=True)).collect()


def test_date_column_passes_through(spark):
    df = spark.createDataFrame([(dt.date(2020, 4, 19),)], "Date date")
    assert cleaning.parse_date_column(df).collect()[0][0] == dt.date(2020, 4, 19)


def test_na_drop_equivalence_including_nan(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), "b"), (None, "c"), (2.0, None)], "x double, s string")
    assert sorted(map(tuple, cleaning.drop_null_rows(df).collect())) == sorted(map(tuple, df.na.drop().collect()))


def test_corr_skips_incomplete_pairs_unlike_stat_corr(spark):
    rows = [(1.0, 2.0), (2.0, 4.1), (3.0, 5.9), (4.0, None), (None, 7.0)]
    df = spark.createDataFrame(rows, "x double, y double")
    (r,) = df.select(safe_corr("x", "y")).collect()
    complete = spark.createDataFrame(rows[:3], "x double, y double")
    assert r[0] == pytest.approx(complete.stat.corr("x", "y"), abs=1e-12)
    assert r[0] == pytest.approx(complete.select(F.corr("x", "y")).collect()[0][0], abs=1e-12)


def test_corr_constant_column_is_null_not_error(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "x double, y double")
    assert df.select(safe_corr("x", "y")).collect()[0][0] is None


@pytest.mark.parametrize("n", [0, 1])
def test_corr_empty_and_single_row_is_null(spark, n):
    df = spark.createDataFrame([(1.0, 2.0)][:n], "x double, y double")
    assert df.select(safe_corr("x", "y")).collect()[0][0] is None


def test_skewness_population_form(spark):
    df = spark.createDataFrame([(1,), (2,), (4,), (10,)], "v int")
    (r,) = correlation.skewness(df, "v").collect()
    xs = [1, 2, 4, 10]
    mu = sum(xs) / 4
    m2 = sum((x - mu) ** 2 for x in xs)
    m3 = sum((x - mu) ** 3 for x in xs)
    assert r[0] == pytest.approx(math.sqrt(4) * m3 / m2 ** 1.5, abs=1e-12)


def test_skewness_constant_is_null(spark):
    df = spark.createDataFrame([(3,), (3,)], "v int")
    assert correlation.skewness(df, "v").collect()[0][0] is None


def test_all_empty_year_is_cast(fixture_inputs):
    wide = fixture_inputs.expenditure_wide
    assert dict(wide.dtypes)["1960"] == "string"  # what inference gives
    assert cleaning.indicator_year(wide, "1960").count() == 0
    assert dict(cleaning.indicator_year(wide, "2016").dtypes)["2016"] == "double"


def test_misspelt_csv_option_is_rejected(spark):
    with pytest.raises(UnknownOptionError):
        read_csv(spark, "/nonexistent.csv", delimeter=",")


def test_delimiter_round_trip(spark):
    df = spark.createDataFrame([("A, B", "AAA", 1.5)], "`Country Name` string, `Country Code` string, `2018` double")
    path = write_csv(df, staging_path(spark, "t-delim"), delimiter=";")
    back = read_csv(spark, path, delimiter=";")
    assert back.columns == ["Country Name", "Country Code", "2018"]
    assert back.collect()[0]["Country Name"] == "A, B"


def test_digit_column_is_a_column_not_a_literal(spark):
    df = spark.createDataFrame([("AAA", 7.0)], "`Country Code` string, `2018` double")
    out = cleaning.indicator_year(df, 2018)
    assert out.collect()[0]["2018"] == 7.0


def test_schema_contract_lists_every_problem(spark):
    df = spark.createDataFrame([("x", "y")], "Case_Type string, Cases string")
    with pytest.raises(contract.SchemaContractError) as err:
        contract.assert_schema(df, contract.CASE_CONTRACT)
    msg = str(err.value)
    for needle in ("'Cases'", "'iso3'", "'Population_Count'", "'Date'"):
        assert needle in msg


def test_contract_failure_on_preamble_file(spark, tmp_path):
    p = tmp_path / "pre.csv"
    p.write_text('"Data Source","World Development Indicators",\n\n"Country Name","Country Code","2018"\n"A","AAA","1"\n')
    df = read_csv(spark, str(p))
    with pytest.raises(contract.SchemaContractError):
        cleaning.indicator_year(df, "2018")


def test_duplicate_indicator_code_fails(spark):
    from epilens.operators.factors import indicator_factor

    wide = spark.createDataFrame([("AAA", 1.0), ("AAA", 2.0), ("BBB", 3.0)], "`Country Code` string, `2018` double")
    with pytest.raises(Exception) as err:
        indicator_factor(wide, "2018", "f").collect()
    assert "duplicate key" in str(err.value)


def test_lag_skips_date_gaps(spark):
    from epilens.operators.timeseries import with_first_difference

    df = spark.createDataFrame(
        [(dt.date(2020, 4, 16), 5), (dt.date(2020, 4, 17), 16), (dt.date(2020, 4, 19), 61)], "Date date, n bigint"
    )
    got = [r[-1] for r in with_first_difference(df, "n").orderBy("Date").collect()]
    assert got == [None, 11, 45]


def test_checkpoint_dir_comes_from_session(spark):
    root = spark.sparkContext.getCheckpointDir()
    assert root
    assert staging_path(spark, "x").startswith(root)
    assert os.path.basename(staging_path(spark, "x")) != os.path.basename(staging_path(spark, "x"))


def test_trailing_comma_header_is_harmless(spark, tmp_path):
    p = tmp_path / "trail.csv"
    p.write_text("Country Name,Country Code,2018,\nA,AAA,1.5,\nB,BBB,,\n")
    df = read_csv(spark, str(p))
    assert df.columns[-1].startswith("_c")
    assert [tuple(r) for r in cleaning.indicator_year(df, "2018").collect()] == [("AAA", 1.5)]


def test_distributed_lag_equals_plain_on_daily_series(spark):
    from epilens.operators.timeseries import with_first_difference
    from epilens.plans import queries as Q
    from conftest import SF_SMALL

    daily = Q.A.worldwide_cases_by_date(Q._clean(spark, SF_SMALL))
    plain = {r["Date"]: r["Number of New Cases"] for r in with_first_difference(daily, "Number_Of_Cases").collect()}
    dist = {r["Date"]: r["Number of New Cases"] for r in with_first_difference(daily, "Number_Of_Cases", distributed=True).collect()}
    assert plain == dist
