"""Snapshot on one date and totals per key (FL2, FL6, AG1-AG3, AG7, SO1,
SO3, SK2-SK3).

Counts in the case table are cumulative, so a total per country is taken on
*one* date; summing over dates would count every day again.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import date_literal
from ..functions.names import col, quote
from ..fixed import CONFIRMED, DEATHS, NUMBER_OF_CASES, NUMBER_OF_COUNTRIES, NUMBER_OF_DEATHS, POPULATION
from .ordering import global_row_number

_AGGS = {"sum": F.sum, "avg": F.avg}


def latest_date(df: DataFrame, column: str = "Date") -> Column:
    """``max(date)`` of the table it is given, as a scalar subquery: computed
    once by a partial aggregate, then used as a literal (no join, no driver
    round trip). Given the whole clean table it is the latest date of the data
    set; given one case type, the latest date of that type."""
    return df.agg(F.max(col(column))).scalar()


def snapshot_filter(df: DataFrame, on: str | _dt.date | Column, column: str = "Date") -> DataFrame:
    value = on if isinstance(on, Column) else date_literal(on)
    return df.where(col(column) == value)


def totals_by_key(
    df: DataFrame,
    value: str = "Cases",
    measure: str = NUMBER_OF_CASES,
    key: str = "iso3",
    population: str | None = "Population_Count",
    population_name: str = POPULATION,
    agg: str = "sum",
) -> DataFrame:
    """``SELECT key, agg(value) AS measure, SUM(population) AS Population
    GROUP BY key``. ``agg='avg'`` is the average the text mentions."""
    aggs = [_AGGS[agg](col(value)).alias(measure)]
    if population:
        aggs.append(F.sum(col(population)).alias(population_name))
    return df.groupBy(col(key).alias(key)).agg(*aggs)


def snapshot_totals(
    clean: DataFrame,
    case_type: str,
    on: str | _dt.date | Column,
    measure: str,
    key: str = "iso3",
    agg: str = "sum",
) -> DataFrame:
    """Totals per key of one case type on one date."""
    rows = snapshot_filter(clean.where(F.col("Case_Type") == case_type), on)
    return totals_by_key(rows, "Cases", measure, key, agg=agg)


def measures_by_key(
    clean: DataFrame,
    on: str | _dt.date | Column,
    key: str = "iso3",
    confirmed: str = CONFIRMED,
    deaths: str = DEATHS,
) -> DataFrame:
    """Cases and deaths per key in *one* pass (one scan, one shuffle):
    conditional sums. Population is summed per case type, as each slice of
    the reference sums it over its own rows; a key absent from a slice gets
    null there, not 0."""
    rows = snapshot_filter(clean.where(F.col("Case_Type").isin(confirmed, deaths)), on)
    is_c = F.col("Case_Type") == confirmed
    is_d = F.col("Case_Type") == deaths
    return rows.groupBy(col(key).alias(key)).agg(
        F.sum(F.when(is_c, F.col("Cases"))).alias(NUMBER_OF_CASES),
        F.sum(F.when(is_c, F.col("Population_Count"))).alias("Population_Cases"),
        F.sum(F.when(is_d, F.col("Cases"))).alias(NUMBER_OF_DEATHS),
        F.sum(F.when(is_d, F.col("Population_Count"))).alias("Population_Deaths"),
    )


def count_distinct_keys(df: DataFrame, key: str = "iso3", name: str = NUMBER_OF_COUNTRIES) -> DataFrame:
    """``selectExpr("count(distinct(iso3)) AS Number_Of_Countries")``: an
    aggregate written as SQL text. Exact; nulls are not counted."""
    return df.selectExpr(f"count(DISTINCT {quote(key)}) AS {quote(name)}")


def rank_by_measure(df: DataFrame, measure: str, key: str = "iso3", name: str = "rank") -> DataFrame:
    """``ORDER BY measure DESC`` made visible as a 1-based rank column; the
    key breaks ties so the order is total. Distributed (see ``ordering``)."""
    return global_row_number(df, [measure, key], name, descending=[measure])


def top_n(df: DataFrame, n: int, measure: str, key: str = "iso3", name: str = "rank") -> DataFrame:
    """The n keys with the largest measure. ``orderBy().limit(n)`` plans as
    ``TakeOrderedAndProject``: each task keeps its own top n, so at most
    n rows per task reach the final merge; the rank is numbered over those n."""
    order = [F.col(measure).desc_nulls_last(), F.col(key).asc()]
    head = df.orderBy(*order).limit(n)
    return head.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def preview(df: DataFrame, n: int = 50, order: Sequence[str] | None = None) -> DataFrame:
    """``show(n)`` as data: the first n rows in a stated, total order (the
    reference's preview has none, so it is not repeatable)."""
    cols = list(order) if order else df.columns
    return df.orderBy(*[col(c) for c in cols]).limit(n)
