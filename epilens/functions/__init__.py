"""Column-level building blocks (built-in Spark expressions only)."""

from .dates import CASE_DATE_FORMAT, date_literal, parse_date
from .names import col, quote
from .stats import cents, complete_pair, pair_count, population_skewness, safe_corr

__all__ = [
    "CASE_DATE_FORMAT",
    "cents",
    "col",
    "complete_pair",
    "date_literal",
    "pair_count",
    "parse_date",
    "population_skewness",
    "quote",
    "safe_corr",
]
