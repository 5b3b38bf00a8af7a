"""Row numbers and ``lag`` over a *global* order, without one task.

``Window.orderBy(...)`` with no ``partitionBy`` moves every row into a
single task (``Exchange SinglePartition``). That is fine after a group-by
date (one row per date), but not for a per-event order or a per-key table
of unknown size. Here the order is cut into contiguous buckets, and the
bucket is a plain function of the row:

1. Boundaries are approximate quantiles of the first order column (one
   aggregate, at most ``num_ranges`` values). A value that spans several
   quantiles is hot: it is split further at quantiles of the second order
   column among its rows, if that column is a number or a time.
2. The bucket of a row comes from comparing it with the boundaries (a binary
   decision tree in one expression), so it can be computed any number of
   times with the same result: nothing is checkpointed or written.
3. Numbers and lags are taken inside buckets (one shuffle on the bucket). Each
   bucket hands the next one its row count, or its last value: one row per
   bucket, from a partial aggregate.

A derived frame (an aggregate, a join) would be computed once for the
boundaries, once for the counts and once for the rows. ``global_row_number``
keeps one copy of it in the shared staging folder, counted as it is written,
and reads that; the number of buckets follows the count, so a short one needs
no boundaries.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import col
from ..session import staging_path
from ..sources.files import read_parquet

_BUCKET = "_bucket"
ROWS_PER_RANGE = 1 << 20
_SPLITTABLE = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _key(name: str, descending: Sequence[str]) -> Column:
    """The order column as a sort key; nulls first ascending, last descending."""
    return col(name).desc_nulls_last() if name in descending else col(name).asc_nulls_first()


def _quantiles(name: str, n: int) -> Column:
    return F.percentile_approx(col(name), [i / n for i in range(1, n)], 100 * n)


def _boundaries(df: DataFrame, order: Sequence[str], descending: Sequence[str], n: int) -> list[tuple]:
    """At most 2n boundaries (first, second or None), in the order's direction."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    if n < 2 or not isinstance(kinds[order[0]], _SPLITTABLE):
        return []
    cuts = df.agg(_quantiles(order[0], n)).first()[0] or []
    hot = sorted({c for c in cuts if cuts.count(c) > 1})
    out = [(c, None) for c in dict.fromkeys(cuts)]
    if hot and len(order) > 1 and isinstance(kinds[order[1]], _SPLITTABLE):
        inside = df.where(col(order[0]).isin(hot)).groupBy(col(order[0]).alias("k")).agg(_quantiles(order[1], n).alias("q"))
        for k, q in inside.collect():  # one row per hot value: fewer than n
            own = sorted(set(q or []))[:: max(1, n // (cuts.count(k) + 1))]
            out += [(k, x) for x in own]
    down = [c in descending for c in order[:2]]

    def place(b):
        # a boundary on the first column alone precedes those inside its value
        def signed(v, d):
            v = v.toordinal() if type(v).__name__ == "date" else v.timestamp() if hasattr(v, "timestamp") else v
            return -v if d else v

        return (signed(b[0], down[0]), b[1] is not None, 0 if b[1] is None else signed(b[1], down[-1]))

    return sorted(out, key=place)


def _bucket(order: Sequence[str], descending: Sequence[str], bounds: list[tuple], kinds: dict) -> Column:
    """Number of boundaries that do not come after the row."""

    def reached(b: tuple) -> Column:
        first, down = col(order[0]), order[0] in descending
        at = F.lit(b[0]).cast(kinds[order[0]])
        if b[1] is None:
            return first <= at if down else first >= at
        second, inner = col(order[1]), F.lit(b[1]).cast(kinds[order[1]])
        beyond = first < at if down else first > at
        return beyond | ((first == at) & (second <= inner if order[1] in descending else second >= inner))

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi + 1) // 2
        return F.when(reached(bounds[mid - 1]), tree(mid, hi)).otherwise(tree(lo, mid - 1))

    # a null compares to nothing: first ascending, last descending
    nulls = F.lit(len(bounds) + 1 if order[0] in descending else 0)
    return F.when(col(order[0]).isNull(), nulls).otherwise(tree(0, len(bounds)))


def _bucketed(df: DataFrame, order: Sequence[str], descending: Sequence[str], num_ranges: int | None) -> DataFrame:
    n = num_ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumn(_BUCKET, _bucket(order, descending, _boundaries(df, order, descending, n), kinds))


def _kept(df: DataFrame) -> tuple[DataFrame, int]:
    """A written copy of the rows, and how many there are (one job)."""
    seen = Observation()
    path = staging_path(df.sparkSession, "ordered")
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    return read_parquet(df.sparkSession, path, schema=df.schema), seen.get["n"]


def global_row_number(
    df: DataFrame,
    order: Sequence[str],
    name: str = "row_number",
    num_ranges: int | None = None,
    descending: Sequence[str] = (),
) -> DataFrame:
    """``row_number() over (order by <order>)`` computed bucket by bucket.
    ``order`` must be unique (add the key as the last element). Without
    ``num_ranges`` there is one bucket per ``ROWS_PER_RANGE`` rows."""
    df, n = _kept(df)
    rows = _bucketed(df, order, descending, num_ranges or -(-n // ROWS_PER_RANGE) or 1)
    counts = rows.groupBy(_BUCKET).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    offsets = counts.select(_BUCKET, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(_BUCKET).orderBy(*[_key(c, descending) for c in order])
    numbered = rows.withColumn("_in", F.row_number().over(inside))
    return numbered.join(offsets, _BUCKET).select(
        *[col(c) for c in df.columns], (F.col("_offset") + F.col("_in")).alias(name)
    )


def global_lag(
    df: DataFrame, value: str, order: Sequence[str], name: str | None = None, num_ranges: int | None = None
) -> DataFrame:
    """``lag(value, 1) over (order by <order>)`` for a large input; ``order``
    must be unique. The first row of a bucket takes the last value of the
    bucket before it."""
    out = name or f"lag_{value}"
    rows = _bucketed(df, order, (), num_ranges)
    inside = Window.partitionBy(_BUCKET).orderBy(*[_key(c, ()) for c in order])
    lagged = rows.withColumn("_prev", F.lag(col(value), 1).over(inside)).withColumn("_in", F.row_number().over(inside))
    last = rows.groupBy(_BUCKET).agg(F.max_by(col(value), F.struct(*[col(c) for c in order])).alias("_last"))
    carried = last.select(_BUCKET, F.lag("_last", 1).over(Window.orderBy(_BUCKET)).alias("_carry"))  # one row per bucket
    return lagged.join(carried, _BUCKET).select(
        *[col(c) for c in df.columns], F.when(F.col("_in") == 1, F.col("_carry")).otherwise(F.col("_prev")).alias(out)
    )
