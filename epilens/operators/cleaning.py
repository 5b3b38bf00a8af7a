"""Selection, renames, date parsing, null drop and case-type filters
(PJ1-PJ4, FL1, FL3-FL4, SF1). All narrow: no shuffle, one scan stage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..fixed import CASE_COLUMNS, CONFIRMED, COUNTRY_CODE, DEATHS
from ..functions.dates import CASE_DATE_FORMAT, parse_date
from ..functions.names import col
from .contract import CASE_CONTRACT, INDICATOR_CONTRACT, assert_schema

__all__ = [
    "CASE_COLUMNS", "CONFIRMED", "DEATHS", "clean_case_table", "drop_null_rows", "filter_value", "indicator_year",
    "not_null", "parse_date_column", "project", "rename", "split_by_case_type",
]


def project(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keep the named columns; the parquet scan reads only these."""
    return df.select(*[col(c) for c in columns])


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(mapping))


def parse_date_column(df: DataFrame, column: str = "Date", fmt: str = CASE_DATE_FORMAT, strict: bool = False) -> DataFrame:
    """Replace a text date column by a date column in place (same name)."""
    if isinstance(df.schema[column].dataType, T.DateType):
        return df
    return df.withColumn(column, parse_date(col(column), fmt, strict))


def not_null(df: DataFrame, subset: Sequence[str] | None = None) -> Column:
    """Predicate equal to ``na.drop('any')``: null, and NaN in float/double
    columns, both drop the row. Written as per-column ``isNotNull`` so the
    parquet scan receives ``IsNotNull`` pushed filters."""
    names = list(subset) if subset is not None else df.columns
    kinds = {f.name: f.dataType for f in df.schema.fields}
    preds = []
    for name in names:
        c = col(name)
        preds.append(c.isNotNull())
        if isinstance(kinds.get(name), (T.FloatType, T.DoubleType)):
            preds.append(~F.isnan(c))
    return reduce(lambda a, b: a & b, preds, F.lit(True))


def drop_null_rows(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    return df.where(not_null(df, subset))


def filter_value(df: DataFrame, value: str, column: str = "Case_Type") -> DataFrame:
    """Case-sensitive equality; pushed to the scan."""
    return df.where(col(column) == F.lit(value))


def split_by_case_type(
    df: DataFrame, confirmed: str = CONFIRMED, deaths: str = DEATHS, column: str = "Case_Type"
) -> tuple[DataFrame, DataFrame]:
    """Two frames by value; any other value goes to neither. The deaths
    frame names its count ``Deaths``. When both feed one result, prefer the
    one-pass conditional aggregate in :mod:`epilens.operators.snapshot`."""
    cases = filter_value(df, confirmed, column)
    deaths_df = filter_value(df, deaths, column).withColumnRenamed("Cases", "Deaths")
    return cases, deaths_df


def clean_case_table(raw: DataFrame, fmt: str = CASE_DATE_FORMAT, strict: bool = False) -> DataFrame:
    """The five analysed columns, typed date, rows with any null dropped.

    A row without population or country also leaves the *case* counts:
    that is the reference's rule (nulls are dropped over all five)."""
    assert_schema(raw, CASE_CONTRACT)
    selected = project(raw, CASE_COLUMNS)
    return drop_null_rows(parse_date_column(selected, "Date", fmt, strict))


def indicator_year(
    wide: DataFrame, year: str | int, key: str = COUNTRY_CODE, new_key: str = "iso3", value_name: str | None = None
) -> DataFrame:
    """(code, value of one year) from a wide table, nulls dropped. The year
    column is cast to double: an all-empty year infers as string."""
    assert_schema(wide, INDICATOR_CONTRACT)
    y = str(year)
    if y not in wide.columns:
        raise KeyError(f"year column {y!r} not in indicator table")
    out = wide.select(col(key).alias(new_key), col(y).cast("double").alias(value_name or y))
    return drop_null_rows(out)
