"""Scans, temp views and the driver-table mapping."""

from .driver_tables import (
    case_table,
    customer_totals,
    event_values,
    indicator_pair,
    indicator_wide,
    new_cases,
    order_line_totals,
    population,
)
from .files import UnknownOptionError, read_csv, read_parquet, register_view, sql, write_csv

__all__ = [
    "UnknownOptionError",
    "case_table",
    "customer_totals",
    "event_values",
    "indicator_pair",
    "indicator_wide",
    "new_cases",
    "order_line_totals",
    "population",
    "read_csv",
    "read_parquet",
    "register_view",
    "sql",
    "write_csv",
]
