"""Run the whole analysis on the three CSV inputs and write every result.

    python -m epilens --cases PATH --expenditure PATH --arrivals PATH \
        --date 2020-04-19 --expenditure-year 2016 --arrivals-year 2018 --out PATH

Each result is written as Parquet under ``--out/<name>`` by the executors;
nothing is collected to the driver.
"""

from __future__ import annotations

import argparse
import datetime as dt

from . import build_session
from .plans.analyses import Inputs, Params, all_results
from .sources import read_csv


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="epilens")
    ap.add_argument("--cases", required=True)
    ap.add_argument("--expenditure", required=True)
    ap.add_argument("--arrivals", required=True)
    ap.add_argument("--date", help="snapshot date, yyyy-mm-dd (default: the latest date of the case file)")
    ap.add_argument("--strict-dates", action="store_true", help="fail on a date that cannot be parsed")
    ap.add_argument("--allow-repeated-codes", action="store_true", help="join every row of a code, don't fail")
    ap.add_argument("--expenditure-year", default="2016")
    ap.add_argument("--arrivals-year", default="2018")
    ap.add_argument("--out", required=True)
    ap.add_argument("--cluster", action="store_true", help="large-input sizing (CLUSTER_CONF)")
    ap.add_argument("--no-materialize", action="store_true", help="re-derive the clean table for every result")
    ap.add_argument(
        "--cases-schema",
        help="DDL of every column of the case file, in file order (skips the inference pass over the data)",
    )
    args = ap.parse_args(argv)

    spark = build_session(cluster=args.cluster)
    # schema inference is a full extra pass over the files; sampling it is not
    # safe (a value wider than the sample's type would turn to null and the
    # null drop would remove its row), so large inputs should pass the schema
    cases = (
        read_csv(spark, args.cases, schema=args.cases_schema, enforceSchema="false")
        if args.cases_schema
        else read_csv(spark, args.cases)
    )
    inputs = Inputs(
        cases, read_csv(spark, args.expenditure), read_csv(spark, args.arrivals), strict_dates=args.strict_dates
    )
    date = dt.date.fromisoformat(args.date) if args.date else None
    p = Params(date, args.expenditure_year, args.arrivals_year, check_unique=not args.allow_repeated_codes)
    out = args.out.rstrip("/")
    written = set()

    def keep(name, df):
        """Write a small frame once; the results that derive from it read it."""
        df.write.mode("overwrite").parquet(f"{out}/{name}")
        written.add(name)
        return spark.read.schema(df.schema).parquet(f"{out}/{name}")

    if not args.no_materialize:
        # one cleaning pass for all results; the table sits next to them
        inputs = inputs.materialize(f"{out}/_clean_cases")
    for name, df in all_results(inputs, p, keep).items():
        if name not in written:
            df.write.mode("overwrite").parquet(f"{out}/{name}")


if __name__ == "__main__":
    main()
