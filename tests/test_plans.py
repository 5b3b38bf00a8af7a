"""Plan-shape assertions: pruning, pushdown, no Python UDFs, no cartesian
products, no whole-input single-partition steps where a key exists."""

import re

import pytest

from conftest import SF_SMALL
from epilens.plans import queries as Q
from epilens.plans.inspect import has_python_udf, plan_text

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin")


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - {"scan_csv_inferred", "scan_csv_delimiter"}))
def test_no_udf_no_cartesian(spark, name):
    df = Q.QUERIES[name](spark, SF_SMALL)
    text = plan_text(df, "formatted")
    assert not has_python_udf(df)
    for bad in FORBIDDEN:
        assert bad not in text, f"{name}: {bad}"


def test_scan_reads_only_needed_columns(spark):
    text = plan_text(Q.QUERIES["snapshot_cases_by_key"](spark, SF_SMALL))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    orders = [s for s in schemas if "o_orderstatus" in s]
    assert orders and all("o_comment" not in s and "o_orderpriority" not in s for s in orders)
    lineitem = plan_text(Q.QUERIES["corr_arrivals_cases"](spark, SF_SMALL))
    li = [s for s in re.findall(r"ReadSchema: struct<([^>]*)>", lineitem) if "l_suppkey" in s]
    assert li and all("l_extendedprice" not in s and "l_orderkey" not in s for s in li)


def test_not_null_reaches_parquet(spark):
    from epilens.operators.cleaning import drop_null_rows
    from epilens.sources import read_parquet

    df = drop_null_rows(read_parquet(spark, f"{SF_SMALL}/customer.parquet", ["c_custkey", "c_nationkey"]))
    assert "IsNotNull(c_nationkey)" in plan_text(df)


def test_case_type_filter_pushed_below_window(spark):
    """The Confirmed filter is applied on the orders scan output (through the
    window, the aggregate and the join), not after the cumulative table."""
    text = plan_text(Q.QUERIES["snapshot_cases_by_key"](spark, SF_SMALL), "formatted")
    blocks = [b.strip() for b in text.split("\n\n")]
    nodes = {b.splitlines()[0].strip(): b for b in blocks if b.startswith("(")}
    scan = next(k for k, b in nodes.items() if k.startswith("(1) Scan parquet"))
    assert "o_orderstatus" in nodes[scan]
    above = next(b for k, b in nodes.items() if k.startswith("(2) Filter"))
    assert "o_orderstatus" in above and "= F) THEN true" in above


def test_ranking_has_no_single_partition_over_rows(spark):
    """The only SinglePartition exchange of the distributed row number is
    over the per-bucket counts (one row per bucket)."""
    text = plan_text(Q.QUERIES["rank_customers"](spark, SF_SMALL), "formatted")
    assert len(re.findall(r"Exchange SinglePartition", text)) <= 1


def test_event_lag_shuffles_the_events_once(spark):
    """One exchange carries whole event rows; the other two carry one row per
    bucket and task, and one per bucket."""
    df = Q.QUERIES["lag_bucketed"](spark, SF_SMALL)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    exchanges = [line for line in final.splitlines() if re.search(r"[ -]Exchange ", line)]
    rows = [line for line in exchanges if "hashpartitioning(_bucket" in line]
    assert len(rows) <= 2 and "CheckpointRDD" not in final and "Scan ExistingRDD" not in final


@pytest.mark.parametrize("name,table,most", [
    ("corr_all_pairs", "lineitem", 1), ("split_by_case_type", "orders", 2), ("daily_new_cases", "orders", 2),
])
def test_scans_of_large_tables(spark, name, table, most):
    """Orders are read once for the rows and once, one column, for the last month."""
    text = plan_text(Q.QUERIES[name](spark, SF_SMALL), "formatted")
    places = re.findall(rf"Location: [^\n]*/{table}\.parquet", text)
    assert 0 < len(places) <= most


def test_indicator_join_not_forced_broadcast(spark):
    """No explicit broadcast hint on data that grows with the input: the
    join strategy is AQE's, from measured sizes."""
    df = Q.QUERIES["join_arrivals_cases"](spark, SF_SMALL)
    assert "broadcast" not in plan_text(df, "extended").split("== Analyzed Logical Plan ==")[1].split("== Optimized")[0].lower()


def test_partial_aggregate_before_first_shuffle(spark):
    """Orders are combined map-side right after the join: the first exchange
    above the orders scan carries partial sums, not order rows."""
    text = plan_text(Q.QUERIES["snapshot_cases_by_key"](spark, SF_SMALL), "formatted")
    tree = text.split("\n\n")[0]
    lines = tree.splitlines()
    scan = max(i for i, line in enumerate(lines) if "Scan parquet" in line and "(1)" in line)
    above = [line.strip() for line in lines[:scan]]
    first_exchange = max(i for i, line in enumerate(above) if line.lstrip("+-: ").startswith("Exchange"))
    assert "HashAggregate" in above[first_exchange + 1]


def test_lineitem_year_range_is_pushed(spark):
    text = plan_text(Q.QUERIES["corr_arrivals_cases"](spark, SF_SMALL))
    pushed = [line for line in text.splitlines() if line.startswith("PushedFilters") and "l_shipdate" in line]
    assert pushed and "GreaterThanOrEqual(l_shipdate" in pushed[0] and "LessThan(l_shipdate" in pushed[0]


def test_country_join_becomes_broadcast_at_run_time(spark):
    """The indicator join carries no hint; after running, AQE has measured
    the country-grain side and chosen a broadcast hash join on iso3."""
    df = Q.QUERIES["join_arrivals_cases"](spark, SF_SMALL)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in final
    assert re.search(r"BroadcastHashJoin \[iso3#\d+\], \[iso3#\d+\]", final)


def test_ranking_derives_its_frame_once(spark):
    """One job reads the orders; the ranks come from the copy that it wrote,
    whose rows it counted."""
    from epilens.operators import ordering

    kept = []
    original = ordering._kept

    def counted(df):
        kept.append(original(df))
        return kept[-1]

    ordering._kept = counted
    try:
        df = Q.QUERIES["rank_keys_by_measure"](spark, SF_SMALL)
    finally:
        ordering._kept = original
    text = plan_text(df, "formatted")
    assert "orders.parquet" not in text and "customer.parquet" not in text and "epilens-staging/ordered" in text
    assert len(kept) == 1 and kept[0][1] == df.count()


def test_indicator_listing_reads_both_files(spark):
    df = Q.QUERIES["schema_columns_indicators"](spark, SF_SMALL)
    text = plan_text(df, "formatted")
    assert "arrivals-csv-schema" in text and "expenditure-csv-schema" in text
    kinds = {(r["input"], r["column_name"]): (r["data_type"], r["n_values"]) for r in df.collect()}
    assert kinds["arrivals", "1994"] == ("string", 0) and kinds["expenditure", "Country Code"][0] == "string"
    assert any(k == "double" and n > 0 for k, n in kinds.values())
