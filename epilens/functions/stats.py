"""Null-safe statistical aggregate expressions.

All are ordinary Catalyst aggregates, so they run as partial (map-side)
aggregates: one small buffer per task crosses the shuffle, whatever the
input size.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def complete_pair(x: str | Column, y: str | Column) -> tuple[Column, Column]:
    """Mask both inputs to the rows where *both* are present (and not NaN),
    so a correlation sees exactly the rows an inner join would keep."""
    xc, yc = _c(x), _c(y)
    ok = xc.isNotNull() & yc.isNotNull() & ~F.isnan(xc.cast("double")) & ~F.isnan(yc.cast("double"))
    return F.when(ok, xc.cast("double")), F.when(ok, yc.cast("double"))


def safe_corr(x: str | Column, y: str | Column) -> Column:
    """Pearson correlation over complete pairs.

    Unlike ``DataFrame.stat.corr`` nulls are skipped instead of read as 0,
    and a constant column gives null instead of raising DIVIDE_BY_ZERO under
    ANSI mode (``when(stddev > 0, corr)`` does not help there: the aggregate
    is evaluated before the condition).
    """
    xm, ym = complete_pair(x, y)
    return F.try_divide(F.covar_pop(xm, ym), F.stddev_pop(xm) * F.stddev_pop(ym))


def pair_count(x: str | Column, y: str | Column) -> Column:
    """Number of complete pairs behind :func:`safe_corr`."""
    xm, _ = complete_pair(x, y)
    return F.count(xm)


def population_skewness(x: str | Column) -> Column:
    """Population skewness  sqrt(n) * sum((x-mu)^3) / sum((x-mu)^2)^1.5,
    null for empty or constant input (Spark's ``skewness``)."""
    return F.skewness(_c(x))


def cents(x: str | Column, scale: int = 100) -> Column:
    """``CAST(round(x * scale) AS BIGINT)`` -- half away from zero -- without
    ``round``'s per-row BigDecimal: floor(|v| + 0.5) with the sign restored,
    a plain arithmetic expression inside whole-stage codegen."""
    v = _c(x) * F.lit(float(scale))
    return F.when(v >= 0, F.floor(v + 0.5)).otherwise(-F.floor(-v + 0.5)).cast("bigint")
