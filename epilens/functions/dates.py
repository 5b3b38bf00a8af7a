"""Date parsing and date literals."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# The case files write dates as month/day/year (fixed.CASE_DATE_PATTERN,
# MM/dd/yyyy). ``M/d/yyyy`` parses that and also unpadded text (4/9/2020),
# on which the padded pattern raises under ANSI mode.
CASE_DATE_FORMAT = "M/d/yyyy"


def parse_date(column: str | Column, fmt: str = CASE_DATE_FORMAT, strict: bool = False) -> Column:
    """Text -> date. Unparsable text becomes null (then dropped with the
    other nulls) unless ``strict``, which raises on the first bad value.
    A column that already is a date passes through unchanged."""
    col = F.col(column) if isinstance(column, str) else column
    return F.to_date(col, fmt) if strict else F.try_to_date(col, fmt)


def date_literal(value: str | _dt.date) -> Column:
    """A typed date literal. Strings must be ISO ``yyyy-MM-dd``; comparing a
    date column with any other text raises under ANSI mode."""
    if isinstance(value, str):
        value = _dt.date.fromisoformat(value)
    return F.lit(value)
