"""Registered queries: one per operator/analysis of the inventory.

Each callable takes (spark, sf_dir) and returns a DataFrame over the driver
tables at ``sf_dir``. The CSV and streaming queries write their files while
they are built (``session.release_staging`` deletes them), rankings and
event lags compute their bucket boundaries; the others run no job. Column names match ``oracle_sql.py``.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chartdata, cleaning, contract, correlation, factors, snapshot, timeseries
from ..operators.cleaning import CASE_COLUMNS, CONFIRMED, DEATHS
from ..operators.ordering import global_lag
from ..sources import case_table, customer_totals, event_values, indicator_pair, indicator_wide, order_line_totals
from ..sources.files import read_csv, read_parquet, register_view, sql, write_csv
from .. import streaming
from ..fixed import NUMBER_OF_CASES, NUMBER_OF_DEATHS, POPULATION
from ..functions.names import quote
from ..session import staging_path
from . import analyses as A

P = A.Params(snapshot_date=dt.date(2001, 7, 1))  # 2001-08, the latest, is a partial month
EXP = A.expenditure_label(P.expenditure_year)
ARR = A.arrivals_label(P.arrivals_year)
TOP_N = 10
PREVIEW_ROWS = 50


def inputs(spark: SparkSession, sf_dir: str) -> A.Inputs:
    """The three inputs over the driver tables at ``sf_dir`` (each built on
    first use)."""
    return A.Inputs(
        lambda: case_table(spark, sf_dir),
        lambda: indicator_wide(spark, sf_dir, "expenditure", (P.expenditure_year,)),
        lambda: indicator_wide(spark, sf_dir, "arrivals", (P.arrivals_year,)),
        lambda: indicator_pair(spark, sf_dir, P.expenditure_year, P.arrivals_year),
    )


def _clean(spark, d):
    return inputs(spark, d).clean_cases()


def _cases(spark, d):
    return A.cases_per_country(_clean(spark, d), P.snapshot_date)


def _deaths(spark, d):
    return A.deaths_per_country(_clean(spark, d), P.snapshot_date)


def _join(factor, measure):
    return lambda spark, d: A.factor_join(inputs(spark, d), P, factor, measure)


def _corr(factor, measure):
    def run(spark, d):
        if factor == "population":
            frame = (_cases if measure == NUMBER_OF_CASES else _deaths)(spark, d)
            return correlation.correlation(frame, POPULATION, measure, P.digits)
        frame = A.factor_join(inputs(spark, d), P, factor, measure)
        return correlation.correlation(frame, EXP if factor == "expenditure" else ARR, measure, P.digits)

    return run


def _scatter(factor, measure):
    def run(spark, d):
        if factor == "population":
            frame = (_cases if measure == NUMBER_OF_CASES else _deaths)(spark, d)
            return factors.scatter(frame, POPULATION, measure)
        frame = A.factor_join(inputs(spark, d), P, factor, measure)
        return factors.scatter(frame, EXP if factor == "expenditure" else ARR, measure)

    return run


# ---- sources and schema -------------------------------------------------


def q_case_table_raw(spark, d):
    return case_table(spark, d)


def q_indicator_wide_arrivals(spark, d):
    return indicator_wide(spark, d, "arrivals")


def q_indicator_wide_expenditure(spark, d):
    return indicator_wide(spark, d, "expenditure")


def q_scan_csv_inferred(spark, d):
    """Case table written as CSV (quoted commas in Combined_Key, text
    dates), read back with header + inferred schema, then held to the
    contract and cast to the contract's widths."""
    path = write_csv(case_table(spark, d), staging_path(spark, "cases-csv"))
    df = read_csv(spark, path, header=True, infer_schema=True)
    contract.assert_schema(df, contract.CASE_CONTRACT)
    return contract.cast_to(df, {"Cases": "bigint", "Population_Count": "bigint", "Date": "string"})


def q_scan_csv_delimiter(spark, d):
    """Wide indicator table through CSV with an explicit, validated
    delimiter (a misspelt option name raises instead of being ignored)."""
    path = write_csv(indicator_wide(spark, d, "arrivals"), staging_path(spark, "arrivals-csv"), delimiter=";")
    df = read_csv(spark, path, header=True, infer_schema=True, delimiter=";")
    contract.assert_schema(df, contract.INDICATOR_CONTRACT)
    years = [c for c in df.columns if c.isdigit()]
    return contract.cast_to(df, {y: "double" for y in years})


def sum_by_sql(view: str, key: str, sums: dict[str, str], key_name: str | None = None) -> str:
    """SQL text: sums per key of a view. ``sums``: result column -> value."""
    parts = [f"sum({quote(value)}) AS {quote(name)}" for name, value in sums.items()]
    return f"SELECT {', '.join([f'{quote(key)} AS {quote(key_name or key)}', *parts])} FROM {quote(view)} GROUP BY {quote(key)}"


def q_temp_view_sql(spark, d):
    """Cases per country by SQL over a temp view of the snapshot rows."""
    latest = snapshot.snapshot_filter(cleaning.filter_value(_clean(spark, d), CONFIRMED), P.snapshot_date)
    register_view(latest, "snapshot_cases")
    return sql(spark, sum_by_sql("snapshot_cases", "iso3", {NUMBER_OF_CASES: "Cases", POPULATION: "Population_Count"}))


def q_temp_view_sql_deaths(spark, d):
    """Deaths per country by SQL over a temp view of the renamed slice."""
    deaths = cleaning.split_by_case_type(_clean(spark, d))[1]
    register_view(snapshot.snapshot_filter(deaths, P.snapshot_date), "snapshot_deaths")
    return sql(spark, sum_by_sql("snapshot_deaths", "iso3", {NUMBER_OF_DEATHS: "Deaths", POPULATION: "Population_Count"}))


def q_temp_view_sql_worldwide(spark, d):
    """Worldwide totals by date by SQL over a temp view of all Confirmed rows
    (the key is found whatever the case of its name)."""
    register_view(cleaning.filter_value(_clean(spark, d), CONFIRMED), "confirmed_rows")
    return sql(spark, sum_by_sql("confirmed_rows", "date", {NUMBER_OF_CASES: "Cases"}, "Date"))


def q_schema_columns(spark, d):
    """Columns of the case CSV as schema inference sees them (the
    reference's read with ``inferschema`` and ``columns.foreach(println)``):
    the inference is a pass over every row. CSV columns are nullable."""
    path = write_csv(case_table(spark, d), staging_path(spark, "cases-csv-schema"))
    return contract.column_listing(spark, read_csv(spark, path, header=True, infer_schema=True))


def q_schema_columns_indicators(spark, d):
    """Names, types and nullability of both wide indicator files as read: from
    the header and by inference over every row (a year without values is read
    as text), with the number of values in each column."""
    out = None
    for name in ("arrivals", "expenditure"):
        path = write_csv(indicator_wide(spark, d, name), staging_path(spark, f"{name}-csv-schema"))
        listed = contract.column_listing_of_rows(read_csv(spark, path, header=True, infer_schema=True))
        listed = listed.withColumn("input", F.lit(name))
        out = listed if out is None else out.unionByName(listed)
    return out


def q_schema_contract(spark, d):
    """Every contract the inputs are held to, checked on the inputs: a row per
    contract column with what was found."""
    frames = {
        "cases": (case_table(spark, d), contract.CASE_CONTRACT),
        "clean_cases": (_clean(spark, d), contract.CLEAN_CASE_CONTRACT),
        "arrivals": (indicator_wide(spark, d, "arrivals"), contract.INDICATOR_CONTRACT),
        "expenditure": (indicator_wide(spark, d, "expenditure"), contract.INDICATOR_CONTRACT),
    }
    rows = []
    for name, (df, wanted) in frames.items():
        found = dict(contract.assert_schema(df, wanted).dtypes)
        rows += [(name, c, family, found[c]) for c, family in wanted.items()]
    listed = spark.createDataFrame(rows, "input string, column_name string, contract string, data_type string")
    sizes = [frames[n][0].agg(F.count("*").alias("n_rows")).withColumn("input", F.lit(n)) for n in frames]
    counts = sizes[0].unionByName(sizes[1]).unionByName(sizes[2]).unionByName(sizes[3])
    return listed.join(counts, "input")


# ---- cleaning -----------------------------------------------------------


def q_project_columns(spark, d):
    return cleaning.project(case_table(spark, d), CASE_COLUMNS)


def q_parse_date_column(spark, d):
    return cleaning.parse_date_column(cleaning.project(case_table(spark, d), CASE_COLUMNS))


def q_drop_null_rows(spark, d):
    return _clean(spark, d)


def q_filter_case_type(spark, d):
    return cleaning.filter_value(_clean(spark, d), CONFIRMED)


def q_rename_columns(spark, d):
    return cleaning.split_by_case_type(_clean(spark, d))[1]


def q_split_by_case_type(spark, d):
    """Both slices in one pass: one filter, the slice named by the case type."""
    name = F.when(F.col("Case_Type") == CONFIRMED, "cases").otherwise("deaths")
    both = _clean(spark, d).where(F.col("Case_Type").isin(CONFIRMED, DEATHS))
    return both.select(name.alias("slice"), "Case_Type", F.col("Cases").alias("value"), "iso3", "Date")


def q_drop_null_rows_outer(spark, d):
    """The null drop over an outer join whose right side has gaps: orders
    without line items leave."""
    return cleaning.drop_null_rows(order_line_totals(spark, d))


def q_join_inner_unmatched(spark, d):
    """The indicator join on keys that differ on both sides: documents with a
    label against documents of English text, by id."""
    labels = read_parquet(spark, f"{d.rstrip('/')}/labels.parquet", ["doc_id", "quality"])
    docs = read_parquet(spark, f"{d.rstrip('/')}/documents.parquet", ["doc_id", "lang", "n_chars"])
    english = docs.where(F.col("lang") == "en").select("doc_id", "n_chars")
    return factors.join_indicator(labels, english, "quality", "n_chars", "doc_id")


def q_filter_snapshot_date(spark, d):
    return snapshot.snapshot_filter(cleaning.filter_value(_clean(spark, d), CONFIRMED), P.snapshot_date)


def q_indicator_year_column(spark, d):
    return cleaning.indicator_year(indicator_wide(spark, d, "expenditure"), P.expenditure_year)


def q_count_distinct_keys(spark, d):
    return snapshot.count_distinct_keys(_clean(spark, d))


def q_count_distinct_arrivals_keys(spark, d):
    """Countries in the arrivals table after its null drop (AG1)."""
    return snapshot.count_distinct_keys(cleaning.indicator_year(inputs(spark, d).arrivals_wide, P.arrivals_year))


def q_count_distinct_expenditure_keys(spark, d):
    """Countries in the health-expenditure table after its null drop (AG1)."""
    return snapshot.count_distinct_keys(cleaning.indicator_year(inputs(spark, d).expenditure_wide, P.expenditure_year))


# ---- snapshots and ranking ----------------------------------------------


def q_latest_snapshot(spark, d):
    """Totals per country on the latest date of the data set (all case types)."""
    clean = _clean(spark, d)
    on = snapshot.latest_date(clean)
    return A.cases_per_country(clean, on).withColumn("Date", on)


def q_latest_snapshot_of_type(spark, d):
    """The same on the latest date of the Confirmed rows alone: a case type
    that reports longer than another cannot empty the snapshot."""
    confirmed = cleaning.filter_value(_clean(spark, d), CONFIRMED)
    on = snapshot.latest_date(confirmed)
    return A.cases_per_country(confirmed, on).withColumn("Date", on)


def q_snapshot_avg_by_key(spark, d):
    avg = snapshot.snapshot_totals(_clean(spark, d), CONFIRMED, P.snapshot_date, "Average_Cases", agg="avg")
    return avg.withColumn("Average_Cases", F.round("Average_Cases", P.digits))


def q_rank_keys_by_measure(spark, d):
    return snapshot.rank_by_measure(_cases(spark, d), NUMBER_OF_CASES)


def q_rank_customers(spark, d):
    """Every customer ranked by order total: a key table that grows."""
    return snapshot.rank_by_measure(customer_totals(spark, d), "total_cents", "c_custkey")


def q_top_n_keys(spark, d):
    return snapshot.top_n(_cases(spark, d), TOP_N, NUMBER_OF_CASES)


def q_preview_first_50(spark, d):
    return snapshot.preview(_clean(spark, d), PREVIEW_ROWS)


def q_preview_arrivals_50(spark, d):
    """The cleaned arrivals table (code, year value), first 50 by code."""
    ind = cleaning.indicator_year(inputs(spark, d).arrivals_wide, P.arrivals_year)
    return snapshot.preview(ind, PREVIEW_ROWS)


def q_preview_expenditure_50(spark, d):
    ind = cleaning.indicator_year(inputs(spark, d).expenditure_wide, P.expenditure_year)
    return snapshot.preview(ind, PREVIEW_ROWS)


# ---- statistics ----------------------------------------------------------


def q_corr_all_pairs(spark, d):
    return A.all_factor_correlations(inputs(spark, d), P)


def q_corr_report(spark, d):
    return correlation.report_lines(A.all_factor_correlations(inputs(spark, d), P), P.digits)


def q_skewness_measure(spark, d):
    return correlation.skewness(_cases(spark, d), NUMBER_OF_CASES, digits=P.digits)


# ---- time ----------------------------------------------------------------


def q_worldwide_total_by_date(spark, d):
    return A.worldwide_cases_by_date(_clean(spark, d))


def q_lag_previous_row(spark, d):
    return timeseries.with_lag(A.worldwide_cases_by_date(_clean(spark, d)), NUMBER_OF_CASES, "Date", "Previous_Number_Of_Cases")


def q_daily_new_cases(spark, d):
    return A.daily_new_cases(_clean(spark, d))


def q_lag_bucketed(spark, d):
    """lag over every event in (ts, event_id) order, bucket by bucket."""
    return global_lag(event_values(spark, d), "value_cents", ["ts", "event_id"], "prev_value_cents")


def q_stream_totals_by_date(spark, d):
    """The case table lands as CSV files in a folder, twice (history is
    published again); a streaming query keeps the newest row per key over
    several micro-batches, and the totals per date are taken from its table."""
    folder, kept, ckpt = (staging_path(spark, f"stream-{x}") for x in ("files", "rows", "ckpt"))
    for part in ("first", "again"):
        write_csv(case_table(spark, d), f"{folder}/{part}")
    streaming.update_case_rows(streaming.case_file_stream(spark, f"{folder}/*", files_per_batch=1), kept, ckpt)
    return streaming.totals_from_rows(spark, kept)


# ---- chart data ------------------------------------------------------------


def q_chart_series_by_key(spark, d):
    return chartdata.series_by_key(_cases(spark, d), "iso3", NUMBER_OF_CASES)


def q_chart_share_by_key(spark, d):
    return chartdata.share_by_key(_cases(spark, d), "iso3", NUMBER_OF_CASES)


def q_chart_share_deaths_by_key(spark, d):
    return chartdata.share_by_key(_deaths(spark, d), "iso3", NUMBER_OF_DEATHS)


def q_chart_series_over_time(spark, d):
    """The bars of both charts in one frame: cases and deaths by date."""
    both = _clean(spark, d).where(F.col("Case_Type").isin(CONFIRMED, DEATHS))
    return both.groupBy("Case_Type", "Date").agg(F.sum("Cases").alias("value"))


def q_chart_series_deaths_over_time(spark, d):
    return A.series_over_time(_clean(spark, d), DEATHS)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "case_table_raw": q_case_table_raw,
    "indicator_wide_arrivals": q_indicator_wide_arrivals,
    "indicator_wide_expenditure": q_indicator_wide_expenditure,
    "scan_csv_inferred": q_scan_csv_inferred,
    "scan_csv_delimiter": q_scan_csv_delimiter,
    "temp_view_sql": q_temp_view_sql,
    "temp_view_sql_deaths": q_temp_view_sql_deaths,
    "temp_view_sql_worldwide": q_temp_view_sql_worldwide,
    "schema_columns": q_schema_columns,
    "schema_columns_indicators": q_schema_columns_indicators,
    "schema_contract": q_schema_contract,
    "project_columns": q_project_columns,
    "parse_date_column": q_parse_date_column,
    "drop_null_rows": q_drop_null_rows,
    "drop_null_rows_outer": q_drop_null_rows_outer,
    "filter_case_type": q_filter_case_type,
    "rename_columns": q_rename_columns,
    "split_by_case_type": q_split_by_case_type,
    "filter_snapshot_date": q_filter_snapshot_date,
    "indicator_year_column": q_indicator_year_column,
    "count_distinct_keys": q_count_distinct_keys,
    "count_distinct_arrivals_keys": q_count_distinct_arrivals_keys,
    "count_distinct_expenditure_keys": q_count_distinct_expenditure_keys,
    "snapshot_cases_by_key": _cases,
    "snapshot_deaths_by_key": _deaths,
    "snapshot_avg_by_key": q_snapshot_avg_by_key,
    "latest_snapshot": q_latest_snapshot,
    "latest_snapshot_of_type": q_latest_snapshot_of_type,
    "rank_keys_by_measure": q_rank_keys_by_measure,
    "rank_customers": q_rank_customers,
    "top_n_keys": q_top_n_keys,
    "preview_first_50": q_preview_first_50,
    "preview_arrivals_50": q_preview_arrivals_50,
    "preview_expenditure_50": q_preview_expenditure_50,
    "join_inner_unmatched": q_join_inner_unmatched,
    "join_expenditure_cases": _join("expenditure", NUMBER_OF_CASES),
    "join_expenditure_deaths": _join("expenditure", NUMBER_OF_DEATHS),
    "join_arrivals_cases": _join("arrivals", NUMBER_OF_CASES),
    "join_arrivals_deaths": _join("arrivals", NUMBER_OF_DEATHS),
    "scatter_population_cases": _scatter("population", NUMBER_OF_CASES),
    "scatter_population_deaths": _scatter("population", NUMBER_OF_DEATHS),
    "scatter_expenditure_cases": _scatter("expenditure", NUMBER_OF_CASES),
    "scatter_expenditure_deaths": _scatter("expenditure", NUMBER_OF_DEATHS),
    "scatter_arrivals_cases": _scatter("arrivals", NUMBER_OF_CASES),
    "scatter_arrivals_deaths": _scatter("arrivals", NUMBER_OF_DEATHS),
    "corr_population_cases": _corr("population", NUMBER_OF_CASES),
    "corr_population_deaths": _corr("population", NUMBER_OF_DEATHS),
    "corr_expenditure_cases": _corr("expenditure", NUMBER_OF_CASES),
    "corr_expenditure_deaths": _corr("expenditure", NUMBER_OF_DEATHS),
    "corr_arrivals_cases": _corr("arrivals", NUMBER_OF_CASES),
    "corr_arrivals_deaths": _corr("arrivals", NUMBER_OF_DEATHS),
    "corr_all_pairs": q_corr_all_pairs,
    "corr_report": q_corr_report,
    "skewness_measure": q_skewness_measure,
    "worldwide_total_by_date": q_worldwide_total_by_date,
    "lag_previous_row": q_lag_previous_row,
    "daily_new_cases": q_daily_new_cases,
    "lag_bucketed": q_lag_bucketed,
    "stream_totals_by_date": q_stream_totals_by_date,
    "chart_series_by_key": q_chart_series_by_key,
    "chart_share_by_key": q_chart_share_by_key,
    "chart_share_deaths_by_key": q_chart_share_deaths_by_key,
    "chart_series_over_time": q_chart_series_over_time,
    "chart_series_deaths_over_time": q_chart_series_deaths_over_time,
}
