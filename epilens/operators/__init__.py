"""DataFrame-in, DataFrame-out operators of the reference, Spark-first."""

from . import chartdata, cleaning, contract, correlation, factors, ordering, snapshot, timeseries

__all__ = ["chartdata", "cleaning", "contract", "correlation", "factors", "ordering", "snapshot", "timeseries"]
