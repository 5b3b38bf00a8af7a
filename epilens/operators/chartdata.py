"""The data series behind the reference's charts (SK4-SK7). Charts are not
drawn; the frames are what a plotting tool would read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import col


def series_by_key(df: DataFrame, key: str, value: str, name: str | None = None) -> DataFrame:
    """Bar chart keyed by ``key``: one summed bar per key."""
    return df.groupBy(col(key).alias(key)).agg(F.sum(col(value)).alias(name or value))


def series_over_time(df: DataFrame, value: str, date: str = "Date", name: str | None = None) -> DataFrame:
    """Bar chart keyed by date over row-level data: many rows share a date,
    a bar is their sum."""
    return df.groupBy(col(date).alias(date)).agg(F.sum(col(value)).alias(name or value))


def share_by_key(df: DataFrame, key: str, value: str, name: str = "share") -> DataFrame:
    """Pie chart: each key's part of the total. The total is a scalar
    subquery (one partial aggregate), not a global window or a cross join
    with a one-row frame. A total of zero (no deaths yet) gives null shares."""
    per_key = series_by_key(df, key, value)
    total = per_key.agg(F.sum(col(value))).scalar()
    return per_key.withColumn(name, F.try_divide(col(value), total))
