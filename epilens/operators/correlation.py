"""Correlations and skewness as DataFrames (AG5, AG6, SK9).

The reference printed driver-side doubles; here every statistic is a row,
so results stay in Spark and several come from one aggregate pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import REPORT_FORMAT
from ..functions.names import col
from ..functions.stats import pair_count, population_skewness, safe_corr

RESULT_COLUMNS = ["measure", "factor", "n_pairs", "correlation"]


def _rounded(c: Column, digits: int | None) -> Column:
    return F.round(c, digits) if digits is not None else c


def correlations(df: DataFrame, pairs: Sequence[tuple[str, ...]], digits: int | None = None) -> DataFrame:
    """Null-safe Pearson correlation for each pair, all in one global
    aggregate; then one output row per pair (measure, factor, n_pairs,
    correlation). A pair is (factor column, measure column) or, with labels
    for the output, (factor column, measure column, factor label, measure
    label).

    Each pair uses only its own complete rows, so a frame made by *left*
    joins gives every pair the same rows as its own inner join."""
    aggs = []
    labels = []
    for i, pair in enumerate(pairs):
        factor, measure = pair[0], pair[1]
        labels.append((pair[2], pair[3]) if len(pair) == 4 else (factor, measure))
        aggs.append(pair_count(col(factor), col(measure)).alias(f"n{i}"))
        aggs.append(safe_corr(col(factor), col(measure)).alias(f"r{i}"))
    one_row = df.agg(*aggs)
    rows = F.array(
        *[
            F.struct(
                F.lit(measure_label).alias("measure"),
                F.lit(factor_label).alias("factor"),
                F.col(f"n{i}").alias("n_pairs"),
                _rounded(F.col(f"r{i}"), digits).alias("correlation"),
            )
            for i, (factor_label, measure_label) in enumerate(labels)
        ]
    )
    return one_row.select(F.inline(rows))


def correlation(df: DataFrame, factor: str, measure: str, digits: int | None = None) -> DataFrame:
    """One pair -> one row."""
    return correlations(df, [(factor, measure)], digits)


def skewness(df: DataFrame, column: str, name: str | None = None, digits: int | None = None) -> DataFrame:
    """``select(skewness(column))``: population skewness, one row."""
    return df.select(_rounded(population_skewness(col(column)), digits).alias(name or f"skewness({column})"))


def report_lines(corr: DataFrame, digits: int = 6) -> DataFrame:
    """The printed sentence of the reference as a column, one per pair:
    ``The correlation between <factor> and <measure> is: <value>``."""
    value = F.format_string(f"%.{digits}f", F.col("correlation"))
    text = F.format_string(REPORT_FORMAT, F.col("factor"), F.col("measure"), F.coalesce(value, F.lit("undefined")))
    return corr.select("measure", "factor", text.alias("report"))
