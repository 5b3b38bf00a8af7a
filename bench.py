"""Benchmark the headline queries.

Runs all queries in turn, ``WARM_UPS`` times to warm up and ``BENCH_RUNS`` times
timed (in turn, so that none is timed on a colder JVM than another), into the ``noop`` sink (the whole plan executes,
nothing is collected). Every run lists its files and plans anew. Prints
ONE JSON line: {"metric", "value" (sum of the medians of the four
BASELINE-shape queries), "unit", "queries": {name: median sec}, "extra":
{other headline queries}, "sf"}.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_RUNS (default 7), BENCH_QUERIES (comma list, default headline set).
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)

WARM_UPS = 3

# snapshot totals by key (incl. building the cumulative view), skewness of the
# snapshot, indicator pivot + inner join + correlation, totals by date + lag
# difference. "value" is the sum of their medians.
HEADLINE = [
    "snapshot_cases_by_key",
    "skewness_measure",
    "corr_arrivals_cases",
    "daily_new_cases",
]
# Reported as well, not part of "value".
EXTRA = [
    "corr_all_pairs",
    "chart_share_by_key",
    "rank_keys_by_measure",
    "top_n_keys",
    "latest_snapshot",
    "lag_bucketed",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "7"))
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE + EXTRA)).split(",") if n]

    from epilens import build_session
    from epilens.plans.queries import QUERIES

    spark = build_session(f"local[{cpus}]", shuffle_partitions=cpus, extra_conf={"spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    for _ in range(WARM_UPS):
        for name in names:
            run(name)
    samples = [{name: run(name) for name in names} for _ in range(runs)]
    timings = {name: round(statistics.median(s[name] for s in samples), 3) for name in names}

    m = re.search(r"sf([0-9.]+)", sf_dir)
    head = {k: v for k, v in timings.items() if k in HEADLINE}
    print(
        json.dumps(
            {
                "metric": "sum_of_median_seconds_baseline_shapes",
                "value": round(sum(head.values()), 3),
                "unit": "sec",
                "queries": head,
                "extra": {k: v for k, v in timings.items() if k not in HEADLINE},
                "sf": float(m.group(1)) if m else sf_dir,
                "cpus": cpus,
                "runs": runs,
            }
        )
    )


if __name__ == "__main__":
    main()
