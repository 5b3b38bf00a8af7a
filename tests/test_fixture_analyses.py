"""The hand-checkable fixture (FIXTURES.md section 2): every step of the
reference's pipeline against values computed independently."""

import datetime as dt

import pytest

from epilens.operators import cleaning, correlation, snapshot
from epilens.plans import analyses as A

P = A.Params(snapshot_date=dt.date(2020, 4, 19), expenditure_year="2016", arrivals_year="2018")
EXP = A.expenditure_label("2016")
ARR = A.arrivals_label("2018")


def _corr_value(df):
    (row,) = df.collect()
    return row["correlation"]


def test_clean_rows_and_countries(fixture_inputs):
    clean = fixture_inputs.clean_cases()
    assert clean.columns == ["Case_Type", "Cases", "iso3", "Population_Count", "Date"]
    assert dict(clean.dtypes)["Date"] == "date"
    assert clean.count() == 14
    (row,) = snapshot.count_distinct_keys(clean).collect()
    assert row["Number_Of_Countries"] == 4


def test_snapshot_totals(fixture_inputs):
    clean = fixture_inputs.clean_cases()
    cases = {r["iso3"]: (r["Number_Of_Cases"], r["Population"]) for r in A.cases_per_country(clean, P.snapshot_date).collect()}
    assert cases == {"AAA": (16, 140), "BBB": (11, 300), "CCC": (30, 80), "DDD": (4, 50)}
    deaths = {r["iso3"]: (r["Number_Of_Deaths"], r["Population"]) for r in A.deaths_per_country(clean, P.snapshot_date).collect()}
    assert deaths == {"AAA": (1, 140), "BBB": (2, 300), "CCC": (6, 80), "DDD": (1, 50)}


def test_population_correlations_and_skewness(fixture_inputs):
    clean = fixture_inputs.clean_cases()
    cases = A.cases_per_country(clean, P.snapshot_date)
    deaths = A.deaths_per_country(clean, P.snapshot_date)
    assert _corr_value(correlation.correlation(cases, "Population", "Number_Of_Cases")) == pytest.approx(-0.150252, abs=1e-6)
    assert _corr_value(correlation.correlation(deaths, "Population", "Number_Of_Deaths")) == pytest.approx(-0.194715, abs=1e-6)
    (s,) = correlation.skewness(cases, "Number_Of_Cases").collect()
    assert s[0] == pytest.approx(0.494685, abs=1e-6)
    (s,) = correlation.skewness(deaths, "Number_Of_Deaths").collect()
    assert s[0] == pytest.approx(1.027210, abs=1e-6)


def test_indicator_rows_and_joins(fixture_inputs):
    for year in ("2016", "2018"):
        assert cleaning.indicator_year(fixture_inputs.expenditure_wide, year).count() == 5
    for factor in ("expenditure", "arrivals"):
        for measure in ("Number_Of_Cases", "Number_Of_Deaths"):
            keys = sorted(r["iso3"] for r in A.factor_join(fixture_inputs, P, factor, measure).collect())
            assert keys == ["AAA", "BBB", "CCC"]


@pytest.mark.parametrize(
    "factor,measure,expected",
    [
        ("expenditure", "Number_Of_Cases", 0.915992),
        ("expenditure", "Number_Of_Deaths", 0.999424),
        ("arrivals", "Number_Of_Cases", 0.956965),
        ("arrivals", "Number_Of_Deaths", 0.737652),
    ],
)
def test_indicator_correlations(fixture_inputs, factor, measure, expected):
    frame = A.factor_join(fixture_inputs, P, factor, measure)
    label = EXP if factor == "expenditure" else ARR
    assert _corr_value(correlation.correlation(frame, label, measure)) == pytest.approx(expected, abs=1e-6)


def test_all_pairs_one_pass_equals_separate_joins(fixture_inputs):
    rows = {(r["measure"], r["factor"]): (r["n_pairs"], r["correlation"]) for r in A.all_factor_correlations(fixture_inputs, P).collect()}
    assert rows[("Number_Of_Cases", "Population")] == (4, pytest.approx(-0.150252, abs=1e-6))
    assert rows[("Number_Of_Deaths", "Population")] == (4, pytest.approx(-0.194715, abs=1e-6))
    assert rows[("Number_Of_Cases", EXP)] == (3, pytest.approx(0.915992, abs=1e-6))
    assert rows[("Number_Of_Deaths", EXP)] == (3, pytest.approx(0.999424, abs=1e-6))
    assert rows[("Number_Of_Cases", ARR)] == (3, pytest.approx(0.956965, abs=1e-6))
    assert rows[("Number_Of_Deaths", ARR)] == (3, pytest.approx(0.737652, abs=1e-6))


def test_worldwide_new_cases(fixture_inputs):
    rows = sorted(A.daily_new_cases(fixture_inputs.clean_cases()).collect())
    got = [(r["Date"], r["Number_Of_Cases"], r["Number of New Cases"]) for r in rows]
    assert got == [
        (dt.date(2020, 4, 16), 5, None),
        (dt.date(2020, 4, 17), 16, 11),
        (dt.date(2020, 4, 19), 61, 45),
    ]


def test_latest_date_is_max(fixture_inputs):
    clean = fixture_inputs.clean_cases()
    on = snapshot.latest_date(clean)
    got = {r["iso3"]: r["Number_Of_Cases"] for r in A.cases_per_country(clean, on).collect()}
    assert got == {"AAA": 16, "BBB": 11, "CCC": 30, "DDD": 4}


def test_rank_and_top_n(fixture_inputs):
    cases = A.cases_per_country(fixture_inputs.clean_cases(), P.snapshot_date)
    ranked = sorted((r["rank"], r["iso3"]) for r in snapshot.rank_by_measure(cases, "Number_Of_Cases").collect())
    assert ranked == [(1, "CCC"), (2, "AAA"), (3, "BBB"), (4, "DDD")]
    top = sorted((r["rank"], r["iso3"]) for r in snapshot.top_n(cases, 2, "Number_Of_Cases").collect())
    assert top == [(1, "CCC"), (2, "AAA")]


def test_split_keeps_other_case_types_out(fixture_inputs):
    cases, deaths = cleaning.split_by_case_type(fixture_inputs.clean_cases())
    assert {r["Case_Type"] for r in cases.collect()} == {"Confirmed"}
    assert "Deaths" in deaths.columns and "Cases" not in deaths.columns
    assert cases.count() + deaths.count() == 13  # the Active row is in neither


def test_report_lines(fixture_inputs):
    rows = correlation.report_lines(A.all_factor_correlations(fixture_inputs, P)).collect()
    texts = {r["report"] for r in rows}
    assert "The correlation between Population and Number_Of_Cases is: -0.150252" in texts
    assert f"The correlation between {ARR} and Number_Of_Deaths is: 0.737652" in texts


def test_materialized_inputs_give_same_results(spark, fixture_inputs):
    from epilens.session import staging_path

    m = fixture_inputs.materialize(staging_path(spark, "t-mat"))
    for name in ("cases_per_country", "correlations", "daily_new_cases", "deaths_over_time"):
        a = A.all_results(fixture_inputs, P)[name]
        b = A.all_results(m, P)[name]
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())), name
    text = m.clean_cases().where("Case_Type = 'Confirmed' AND Date = DATE'2020-04-19'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(Case_Type" in text and "Date" in text.split("PushedFilters")[1][:200]
