"""Indicator joins and scatter frames (PJ2-PJ3, PJ6, JN1-JN4, SK4)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..fixed import COUNTRY_CODE
from ..functions.names import col
from .cleaning import indicator_year
from .contract import unique_key_check


def indicator_factor(
    wide: DataFrame,
    year: str | int,
    factor_name: str,
    key: str = COUNTRY_CODE,
    new_key: str = "iso3",
    check_unique: bool = True,
) -> DataFrame:
    """(iso3, factor) from a wide yearly table: one year picked, nulls
    dropped, the year renamed to a readable factor name. With
    ``check_unique`` a repeated code fails the job instead of silently
    multiplying rows in the join."""
    ind = indicator_year(wide, year, key, new_key, factor_name)
    return unique_key_check(ind, new_key, [factor_name]) if check_unique else ind


def join_indicator(totals: DataFrame, indicator: DataFrame, measure: str, factor: str, key: str = "iso3") -> DataFrame:
    """Inner equi-join on the key *name*, so one key column comes out (the
    reference needed a view qualifier to pick one). Unmatched keys on
    either side leave, as intended: aggregate rows such as the world total
    have no case rows.

    No broadcast hint: both sides are aggregates, so AQE measures them at
    run time and broadcasts the indicator only when it is under the
    threshold, else keeps a sort-merge join.
    """
    return totals.join(indicator, key, "inner").select(col(key), col(measure), col(factor))


def scatter(df: DataFrame, x: str, y: str) -> DataFrame:
    """The two plotted columns, one point per key."""
    return df.select(col(x), col(y))
