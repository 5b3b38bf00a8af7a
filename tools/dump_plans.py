"""Write PLANS.md: the physical plan tree (``explain("formatted")``, tree
part) of the headline queries at a given scale, expression ids removed.

    python tools/dump_plans.py [sf_dir]
"""

from __future__ import annotations

import os
import re
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, HERE)

from epilens import build_session  # noqa: E402
from epilens.plans.inspect import plan_text  # noqa: E402
from epilens.plans.queries import QUERIES  # noqa: E402

NAMES = ["snapshot_cases_by_key", "skewness_measure", "corr_arrivals_cases", "daily_new_cases",
         "corr_all_pairs", "latest_snapshot", "chart_share_by_key", "lag_bucketed", "rank_customers"]


def tree(text: str) -> str:
    head = text.split("\n\n\n")[0]
    return re.sub(r"#\d+L?", "", head).rstrip()


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    out = ["# Physical plans of the headline queries", "",
           f"Generated by `tools/dump_plans.py` on `{os.path.basename(sf_dir)}` before execution (AQE re-plans at run "
           "time: joins of small measured sides become broadcast joins, small partitions are coalesced).", ""]
    for name in NAMES:
        out += [f"## {name}", "", "```", tree(plan_text(QUERIES[name](spark, sf_dir), "formatted")), "```", ""]
    with open(os.path.join(HERE, "PLANS.md"), "w") as fh:
        fh.write("\n".join(out))


if __name__ == "__main__":
    main()
