"""The reference's questions (C1-C11) as composed plans.

Each function returns a lazy DataFrame; nothing is collected. Inputs are the
three tables in the reference's layout (``sources``), so the same plans run
on the real case/indicator files or on the driver-table mapping.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from ..operators import chartdata, cleaning, contract, correlation, factors, snapshot, timeseries
from ..fixed import ARRIVALS_LABEL, CONFIRMED, DEATHS, EXPENDITURE_LABEL, NUMBER_OF_CASES, NUMBER_OF_DEATHS, POPULATION


def expenditure_label(year: str) -> str:
    return EXPENDITURE_LABEL.format(year=year)


def arrivals_label(year: str) -> str:
    return ARRIVALS_LABEL.format(year=year)


@dataclass(frozen=True)
class Params:
    """Dates, years and names; the years' defaults fit the driver-table
    mapping (the reference used 2020-04-19, 2016 and 2018)."""

    snapshot_date: _dt.date | None = None  # None: the latest date of the data set
    expenditure_year: str = "1996"
    arrivals_year: str = "1998"
    digits: int = 6  # rounding of correlations and skewness in results
    check_unique: bool = True  # a repeated code in an indicator table fails the join


class Inputs:
    """The three input tables, each built only when first used (a query
    that needs no indicator never plans one)."""

    def __init__(
        self,
        cases_raw: DataFrame | Callable[[], DataFrame],
        expenditure_wide: DataFrame | Callable[[], DataFrame],
        arrivals_wide: DataFrame | Callable[[], DataFrame],
        indicator_pair: Callable[[], DataFrame] | None = None,
        strict_dates: bool = False,
    ) -> None:
        """``indicator_pair`` gives (iso3, expenditure, arrivals) where both
        indicators can be had from one read of their source. With
        ``strict_dates`` an unparsable date fails instead of leaving as null."""
        self._make = {"cases_raw": cases_raw, "expenditure_wide": expenditure_wide, "arrivals_wide": arrivals_wide}
        self._built: dict[str, DataFrame] = {}
        self.indicator_pair, self.strict_dates = indicator_pair, strict_dates

    def _get(self, name: str) -> DataFrame:
        if name not in self._built:
            src = self._make[name]
            self._built[name] = src if isinstance(src, DataFrame) else src()
        return self._built[name]

    @property
    def cases_raw(self) -> DataFrame:
        return self._get("cases_raw")

    @property
    def expenditure_wide(self) -> DataFrame:
        return self._get("expenditure_wide")

    @property
    def arrivals_wide(self) -> DataFrame:
        return self._get("arrivals_wide")

    def clean_cases(self) -> DataFrame:
        return self.derived("clean", lambda: cleaning.clean_case_table(self.cases_raw, strict=self.strict_dates))

    def materialize(self, path: str) -> Inputs:
        """Write the clean case table once as Parquet under ``path`` (a folder
        every executor sees, e.g. below ``spark.checkpoint.dir``) and return
        inputs that read it back: many analyses then share one cleaning pass
        instead of re-deriving it per action, and the lineage is cut.

        Files are partitioned by case type (a case-type filter reads one
        folder) and sorted by date inside each task (row-group statistics let
        a date filter skip the rest). No repartition: each task writes its
        own rows, so a hot case type is not funnelled into one writer."""
        clean = self.clean_cases()
        (
            clean.sortWithinPartitions("Case_Type", "Date")
            .write.mode("overwrite")
            .partitionBy("Case_Type")
            .parquet(path)
        )
        # the known schema also types the partition column (no inference of
        # folder names: a numeric-looking case type stays a string)
        back = clean.sparkSession.read.schema(clean.schema).parquet(path).select(*clean.columns)
        out = Inputs(
            self.cases_raw, self._make["expenditure_wide"], self._make["arrivals_wide"], self.indicator_pair, self.strict_dates
        )
        out._built.update({k: v for k, v in self._built.items() if k not in ("clean",)})
        out._built["clean"] = back
        return out

    def derived(self, key, build: Callable[[], DataFrame]) -> DataFrame:
        """A frame derived from the inputs, planned once (plans, not data)."""
        if key not in self._built:
            self._built[key] = build()
        return self._built[key]


def snapshot_on(clean: DataFrame, p: Params) -> _dt.date | Column:
    """The stated snapshot date, else the latest date of the data set."""
    return p.snapshot_date if p.snapshot_date is not None else snapshot.latest_date(clean)


def cases_per_country(clean: DataFrame, on: _dt.date | Column) -> DataFrame:
    """iso3, Number_Of_Cases, Population on the snapshot date (C1)."""
    return snapshot.snapshot_totals(clean, CONFIRMED, on, NUMBER_OF_CASES)


def deaths_per_country(clean: DataFrame, on: _dt.date | Column) -> DataFrame:
    """iso3, Number_Of_Deaths, Population on the snapshot date (C2)."""
    return snapshot.snapshot_totals(clean, DEATHS, on, NUMBER_OF_DEATHS)


def expenditure_factor(inputs: Inputs, p: Params) -> DataFrame:
    return inputs.derived(
        ("expenditure", p.expenditure_year, p.check_unique),
        lambda: factors.indicator_factor(
            inputs.expenditure_wide, p.expenditure_year, expenditure_label(p.expenditure_year), check_unique=p.check_unique
        ),
    )


def arrivals_factor(inputs: Inputs, p: Params) -> DataFrame:
    return inputs.derived(
        ("arrivals", p.arrivals_year, p.check_unique),
        lambda: factors.indicator_factor(
            inputs.arrivals_wide, p.arrivals_year, arrivals_label(p.arrivals_year), check_unique=p.check_unique
        ),
    )


def factor_join(inputs: Inputs, p: Params, factor: str, measure: str) -> DataFrame:
    """C5-C8 joins: totals per country x one indicator."""
    clean = inputs.clean_cases()
    totals = (cases_per_country if measure == NUMBER_OF_CASES else deaths_per_country)(clean, snapshot_on(clean, p))
    if factor == "expenditure":
        ind, label = expenditure_factor(inputs, p), expenditure_label(p.expenditure_year)
    else:
        ind, label = arrivals_factor(inputs, p), arrivals_label(p.arrivals_year)
    return factors.join_indicator(totals, ind, measure, label)


def all_factor_correlations(inputs: Inputs, p: Params) -> DataFrame:
    """All six correlations of the reference in one job.

    Cases and deaths per country come from one conditional aggregate; both
    indicators are *left*-joined to it; the six null-safe correlations are
    one global aggregate over complete pairs, which gives each pair exactly
    the rows of its own inner join.
    """
    clean = inputs.clean_cases()
    per_key = snapshot.measures_by_key(clean, snapshot_on(clean, p))
    exp_label, arr_label = expenditure_label(p.expenditure_year), arrivals_label(p.arrivals_year)
    if inputs.indicator_pair is not None:
        both = inputs.derived("pair", inputs.indicator_pair)
        wide = per_key.join(both.withColumnsRenamed({"expenditure": exp_label, "arrivals": arr_label}), "iso3", "left")
    else:
        wide = per_key.join(expenditure_factor(inputs, p), "iso3", "left").join(arrivals_factor(inputs, p), "iso3", "left")
    pairs = [
        ("Population_Cases", NUMBER_OF_CASES, POPULATION, NUMBER_OF_CASES),
        ("Population_Deaths", NUMBER_OF_DEATHS, POPULATION, NUMBER_OF_DEATHS),
        (exp_label, NUMBER_OF_CASES, exp_label, NUMBER_OF_CASES),
        (exp_label, NUMBER_OF_DEATHS, exp_label, NUMBER_OF_DEATHS),
        (arr_label, NUMBER_OF_CASES, arr_label, NUMBER_OF_CASES),
        (arr_label, NUMBER_OF_DEATHS, arr_label, NUMBER_OF_DEATHS),
    ]
    return correlation.correlations(wide, pairs, p.digits)


def worldwide_cases_by_date(clean: DataFrame) -> DataFrame:
    """Date, Number_Of_Cases summed over all Confirmed rows (AG4)."""
    return timeseries.totals_by_date(clean.where(clean["Case_Type"] == CONFIRMED), "Cases", "Date", NUMBER_OF_CASES)


def daily_new_cases(clean: DataFrame) -> DataFrame:
    """C11 -- worldwide cumulative total per date, then the change from the
    previous row (WN1, WN2)."""
    return timeseries.with_first_difference(worldwide_cases_by_date(clean), NUMBER_OF_CASES, "Date")


def series_over_time(clean: DataFrame, case_type: str) -> DataFrame:
    """C9/C10 -- the Date-keyed bar chart of cases (or deaths) rows."""
    value = "Cases" if case_type == CONFIRMED else "Deaths"
    rows = clean.where(clean["Case_Type"] == case_type).withColumnRenamed("Cases", value)
    return chartdata.series_over_time(rows, value, "Date", value)


def all_results(
    inputs: Inputs, p: Params, keep: Callable[[str, DataFrame], DataFrame] = lambda name, df: df
) -> dict[str, DataFrame]:
    """Every result of the reference notebook, by name (lazy DataFrames):
    what one would ``display`` or print, cell by cell.

    Many results derive from a few small frames (totals per country and by
    date, the two factors, the correlations). ``keep(name, df)`` may write such
    a frame and give it back as read, so that it is computed once; what it
    has written need not be written again."""
    clean = inputs.clean_cases()
    on = snapshot_on(clean, p)
    spark = clean.sparkSession
    cases = keep("cases_per_country", cases_per_country(clean, on))
    deaths = keep("deaths_per_country", deaths_per_country(clean, on))
    by_date = keep("worldwide_cases_by_date", worldwide_cases_by_date(clean))
    exp_label, arr_label = expenditure_label(p.expenditure_year), arrivals_label(p.arrivals_year)
    exp_year = cleaning.indicator_year(inputs.expenditure_wide, p.expenditure_year)
    arr_year = cleaning.indicator_year(inputs.arrivals_wide, p.arrivals_year)
    found = {
        "expenditure": (keep("expenditure_factor", expenditure_factor(inputs, p)), exp_label),
        "arrivals": (keep("arrivals_factor", arrivals_factor(inputs, p)), arr_label),
    }
    correlations = keep("correlations", all_factor_correlations(inputs, p))
    out = {
        "columns_cases": contract.column_listing(spark, inputs.cases_raw),
        "columns_expenditure": contract.column_listing(spark, inputs.expenditure_wide),
        "columns_arrivals": contract.column_listing(spark, inputs.arrivals_wide),
        "clean_cases": clean,
        "preview_cases": snapshot.preview(clean),
        "preview_expenditure": snapshot.preview(exp_year),
        "preview_arrivals": snapshot.preview(arr_year),
        "countries": snapshot.count_distinct_keys(clean),
        "expenditure_countries": snapshot.count_distinct_keys(exp_year),
        "arrivals_countries": snapshot.count_distinct_keys(arr_year),
        "cases_per_country": cases,
        "deaths_per_country": deaths,
        "worldwide_cases_by_date": by_date,
        "expenditure_factor": found["expenditure"][0],
        "arrivals_factor": found["arrivals"][0],
        "scatter_population_cases": factors.scatter(cases, POPULATION, NUMBER_OF_CASES),
        "scatter_population_deaths": factors.scatter(deaths, POPULATION, NUMBER_OF_DEATHS),
        "bars_of_cases": chartdata.series_by_key(cases, "iso3", NUMBER_OF_CASES),
        "share_of_cases": chartdata.share_by_key(cases, "iso3", NUMBER_OF_CASES),
        "share_of_deaths": chartdata.share_by_key(deaths, "iso3", NUMBER_OF_DEATHS),
        "skewness_of_cases": correlation.skewness(cases, NUMBER_OF_CASES, digits=p.digits),
        "correlations": correlations,
        "correlation_report": correlation.report_lines(correlations, p.digits),
        "cases_over_time": by_date.withColumnRenamed(NUMBER_OF_CASES, "Cases"),
        "deaths_over_time": series_over_time(clean, DEATHS),
        "daily_new_cases": timeseries.with_first_difference(by_date, NUMBER_OF_CASES, "Date"),
    }
    for f, (factor, label) in found.items():
        for short, totals, m in (("cases", cases, NUMBER_OF_CASES), ("deaths", deaths, NUMBER_OF_DEATHS)):
            joined = factors.join_indicator(totals, factor, m, label)
            out[f"{f}_vs_{short}"] = joined
            out[f"scatter_{f}_{short}"] = factors.scatter(joined, label, m)
    return out
