"""Column names with spaces or made of digits (``Country Code``, ``2018``).

``F.col("2018")`` is the column; ``selectExpr("2018")`` would be the
literal 2018. Inside SQL text such names must be back-quoted.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(name: str) -> Column:
    return F.col(quote(name))


def quote(name: str) -> str:
    """Back-quote a name for SQL text or for ``F.col`` (dots stay literal)."""
    return "`" + name.replace("`", "``") + "`"
