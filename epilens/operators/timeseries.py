"""Totals by date, lag and first difference (AG4, SO2, WN1, WN2, SK8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..fixed import NEW_CASES, NUMBER_OF_CASES
from ..functions.names import col
from .ordering import global_lag


def totals_by_date(df: DataFrame, value: str = "Cases", date: str = "Date", name: str = NUMBER_OF_CASES) -> DataFrame:
    """``SELECT date AS Date, SUM(value) GROUP BY date``: partial aggregate,
    then one row per date."""
    return df.groupBy(col(date).alias(date)).agg(F.sum(col(value)).alias(name))


def with_lag(df: DataFrame, value: str, order: str = "Date", name: str | None = None, distributed: bool = False) -> DataFrame:
    """Previous *row* by ``order`` (not the previous calendar day: a gap in
    the dates is skipped over). Null on the first row.

    The plain form is a window without partition, i.e. one task; use it on
    a frame with one row per date (bounded by the calendar, not by the
    data). ``distributed=True`` takes the range-partitioned path for a fine
    order key; ``order`` must then be unique."""
    out = name or f"lag_{value}"
    if distributed:
        return global_lag(df, value, [order], out)
    return df.withColumn(out, F.lag(col(value), 1).over(Window.orderBy(col(order))))


def with_first_difference(
    df: DataFrame, value: str, order: str = "Date", name: str = NEW_CASES, distributed: bool = False
) -> DataFrame:
    """value - lag(value): new cases from a cumulative series. Null on the
    first row; negative when a cumulative count was corrected down."""
    lagged = with_lag(df, value, order, "_prev", distributed)
    return lagged.withColumn(name, col(value) - F.col("_prev")).drop("_prev")
