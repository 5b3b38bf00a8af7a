"""The command line runs every analysis on the fixture CSVs."""

import os

import pytest

from conftest import FIXTURES
from epilens.__main__ import main
from epilens.session import staging_path


def test_cli_writes_all_results(spark):
    out = staging_path(spark, "t-cli")
    main([
        "--cases", os.path.join(FIXTURES, "cases.csv"),
        "--expenditure", os.path.join(FIXTURES, "indicator.csv"),
        "--arrivals", os.path.join(FIXTURES, "indicator.csv"),
        "--date", "2020-04-19", "--out", out,
    ])
    cases = {r["iso3"]: r["Number_Of_Cases"] for r in spark.read.parquet(f"{out}/cases_per_country").collect()}
    assert cases == {"AAA": 16, "BBB": 11, "CCC": 30, "DDD": 4}
    report = {r["report"] for r in spark.read.parquet(f"{out}/correlation_report").collect()}
    assert "The correlation between Population and Number_Of_Cases is: -0.150252" in report
    assert spark.read.parquet(f"{out}/daily_new_cases").count() == 3


def test_cli_with_explicit_case_schema(spark):
    out = staging_path(spark, "t-cli-schema")
    ddl = ("Case_Type string, Cases bigint, Difference bigint, Date string, Combined_Key string, "
           "Country_Region string, Province_State string, iso3 string, Population_Count bigint")
    main([
        "--cases", os.path.join(FIXTURES, "cases.csv"),
        "--expenditure", os.path.join(FIXTURES, "indicator.csv"),
        "--arrivals", os.path.join(FIXTURES, "indicator.csv"),
        "--date", "2020-04-19", "--out", out, "--cases-schema", ddl,
    ])
    cases = {r["iso3"]: r["Number_Of_Cases"] for r in spark.read.parquet(f"{out}/cases_per_country").collect()}
    assert cases == {"AAA": 16, "BBB": 11, "CCC": 30, "DDD": 4}


def test_cli_without_a_date_lists_every_result(spark):
    """The snapshot is then the latest date; every cell's result is written."""
    out = staging_path(spark, "t-cli-latest")
    args = ["--cases", os.path.join(FIXTURES, "cases.csv"), "--expenditure", os.path.join(FIXTURES, "indicator.csv"),
            "--arrivals", os.path.join(FIXTURES, "indicator.csv"), "--out", out]
    main(args)
    names = {n for n in os.listdir(out.removeprefix("file:")) if not n.startswith("_")}
    pairs = {f"{k}{f}_{j}" for k, f, j in [(k, f, j) for f in ("expenditure", "arrivals") for j in ("cases", "deaths") for k in ("scatter_",)]}
    joins = {f"{f}_vs_{j}" for f in ("expenditure", "arrivals") for j in ("cases", "deaths")}
    assert names == pairs | joins | {
        "columns_cases", "columns_expenditure", "columns_arrivals", "clean_cases", "preview_cases", "preview_expenditure",
        "preview_arrivals", "countries", "expenditure_countries", "arrivals_countries", "cases_per_country",
        "deaths_per_country", "worldwide_cases_by_date", "expenditure_factor", "arrivals_factor",
        "scatter_population_cases", "scatter_population_deaths", "bars_of_cases", "share_of_cases", "share_of_deaths",
        "skewness_of_cases", "correlations", "correlation_report", "cases_over_time", "deaths_over_time", "daily_new_cases",
    }
    cases = {r["iso3"]: r["Number_Of_Cases"] for r in spark.read.parquet(f"{out}/cases_per_country").collect()}
    assert cases == {"AAA": 16, "BBB": 11, "CCC": 30, "DDD": 4}
    assert spark.read.parquet(f"{out}/expenditure_countries").first()[0] == 5
    assert spark.read.parquet(f"{out}/columns_arrivals").count() == 7


def test_strict_dates_fail(spark, tmp_path):
    bad = tmp_path / "bad.csv"
    bad.write_text("Case_Type,Cases,Date,iso3,Population_Count\nConfirmed,5,16.04.2020,AAA,100\n")
    args = ["--cases", str(bad), "--expenditure", os.path.join(FIXTURES, "indicator.csv"),
            "--arrivals", os.path.join(FIXTURES, "indicator.csv"), "--date", "2020-04-16", "--out", str(tmp_path / "o")]
    with pytest.raises(Exception):
        main([*args, "--strict-dates"])
