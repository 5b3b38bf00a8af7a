"""The reference's three inputs, derived by Spark from the driver tables.

The pandemic files themselves are not available, so the same *shapes* are
built from the TPC-H-like tables:

* ``case_table``  -- long table, one row per region x month x case type,
  counts cumulative to date (the case CSV). Orders are the new cases: the
  order status picks the case type, the customer's nation is the country
  (``iso3``), the market segment is the province, the order month is the
  date and the order total in cents is the count. The population of a
  region is its number of customers.
* ``indicator_wide`` -- wide table, one column per year, one row per
  country code plus region and world aggregate rows (the World Bank CSVs).
  ``arrivals`` = units shipped by the suppliers of a nation in a year;
  ``expenditure`` = discount as a percentage of gross revenue.
* ``event_values`` -- one row per event with an integer value, for the
  fine-grained (per event) lag.

Every row of those tables is read. The case table has a row per nation,
segment, type and month, so its row count is bounded by those, however many
orders it sums; ``event_values`` and the line totals grow with the input.

Counts are integer cents so that sums are exact and order-independent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..fixed import CASE_DATE_PATTERN, CONFIRMED, COUNTRY_CODE, DEATHS
from ..functions.stats import cents
from .files import read_parquet

# Columns of the driver tables (FIXTURES.md section 3).
SCHEMAS = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}

# Mapping of the driver tables onto the reference's inputs: order status ->
# case type (the two analysed types are fixed values; P is a third type that
# no analysis reads), and the indicator metadata.
CASE_TYPE_OF_STATUS = {"F": CONFIRMED, "O": DEATHS, "P": "Active"}
INDICATORS = {
    "arrivals": ("International arrivals (units shipped)", "ST.INT.ARVL"),
    "expenditure": ("Discount as % of gross revenue", "SH.XPD.CHEX.GD.ZS"),
}
# Year columns of the wide tables; 1994 has no shipments: an all-empty column.
# A ship year outside them fails the job.
YEARS = [str(y) for y in range(1994, 2002)]
WORLD_CODE = "WLD"
# Basis points by exact integer division (the product leaves a long at world
# sums near 1e15), then percent; null without revenue.
_PERCENT = "CAST((CAST({d} AS DECIMAL(38, 0)) * 10000) div nullif({g}, 0) AS DOUBLE) / 100.0D"

SERIES_KEYS = ["Case_Type", "iso3", "Province_State"]


def _table(spark: SparkSession, sf_dir: str, name: str, columns: list[str]) -> DataFrame:
    return read_parquet(spark, f"{sf_dir.rstrip('/')}/{name}.parquet", columns, SCHEMAS[name])


def country_code(nation_key: str | Column) -> Column:
    """Nation key -> three-letter code ``N07``."""
    return F.format_string("N%02d", F.col(nation_key) if isinstance(nation_key, str) else nation_key)


def _case_type(status: Column) -> Column:
    expr = None
    for code, name in CASE_TYPE_OF_STATUS.items():
        expr = F.when(status == code, name) if expr is None else expr.when(status == code, name)
    return expr


def new_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New cases per (case type, country, province, month): the non-cumulative
    observations. Orders x customers is the one large join; the aggregate
    right after it is partial, so a hot key is combined map-side. Rows are
    grouped by the raw keys and the codes (``Case_Type``, ``iso3``) are
    derived from the few aggregated rows, not per order; a filter on them
    still reaches the orders scan (the mapping is one-to-one)."""
    orders = _table(spark, sf_dir, "orders", ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"])
    customer = _table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey", "c_mktsegment"])
    joined = orders.join(customer, orders["o_custkey"] == customer["c_custkey"])
    monthly = joined.groupBy(
        "o_orderstatus", "c_nationkey", "c_mktsegment", F.trunc(F.to_date("o_orderdate"), "month").alias("month")
    ).agg(F.sum(cents("o_totalprice")).alias("new_cases"))
    return monthly.select(
        _case_type(F.col("o_orderstatus")).alias("Case_Type"),
        country_code("c_nationkey").alias("iso3"),
        F.col("c_mktsegment").alias("Province_State"),
        "month",
        "new_cases",
    )


def population(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = _table(spark, sf_dir, "customer", ["c_nationkey", "c_mktsegment"])
    per_region = customer.groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("Population_Count"))
    return per_region.select(
        country_code("c_nationkey").alias("iso3"), F.col("c_mktsegment").alias("Province_State"), "Population_Count"
    )


def case_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative case table in the layout of the case CSV (date as
    ``MM/dd/yyyy`` text).

    A series starts at its first report and is carried forward to the last
    month of the orders table: the running sum is taken over the months that have
    reports, and each report row is expanded (``sequence``) up to the month
    before the next report. No keys x dates cross join, and one window
    partition holds one series' months, never the raw rows.
    """
    # The reporting period ends with the last month of the orders table: a
    # scalar subquery over one column (partial max per task), no join. The
    # maximum is taken of the raw dates, one value is cut to its month.
    orders = _table(spark, sf_dir, "orders", ["o_orderdate"])
    last_month = orders.agg(F.trunc(F.to_date(F.max("o_orderdate")), "month")).scalar()
    monthly = new_cases(spark, sf_dir)
    by_series = Window.partitionBy(*SERIES_KEYS).orderBy("month")
    runs = monthly.select(
        *SERIES_KEYS,
        "month",
        F.sum("new_cases").over(by_series.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("Cases"),
        F.lead("month").over(by_series).alias("next_month"),
    )
    end = F.coalesce(F.add_months("next_month", -1), last_month)
    # population joins the report rows before they are expanded: fewer rows
    # through the join, the same value on every generated month
    with_pop = runs.join(population(spark, sf_dir), ["iso3", "Province_State"], "left")
    dense = with_pop.select(
        *SERIES_KEYS,
        "Cases",
        "Population_Count",
        F.explode(F.sequence("month", end, F.expr("INTERVAL 1 MONTH"))).alias("day"),
    )
    return dense.select(
        "Case_Type",
        "Cases",
        F.date_format("day", CASE_DATE_PATTERN).alias("Date"),
        F.concat_ws(", ", "iso3", "Province_State").alias("Combined_Key"),
        "Province_State",
        "iso3",
        "Population_Count",
    )


def _ship_year_range(years: tuple[str, ...]) -> Column:
    """Ship dates inside the given years, as plain range comparisons on the
    raw column so the scan receives them (row groups outside are skipped)."""
    pred = None
    for y in sorted({int(v) for v in years}):
        lo = F.to_timestamp_ntz(F.lit(f"{y}-01-01 00:00:00"))
        hi = F.to_timestamp_ntz(F.lit(f"{y + 1}-01-01 00:00:00"))
        one = (F.col("l_shipdate") >= lo) & (F.col("l_shipdate") < hi)
        pred = one if pred is None else pred | one
    return pred


def shipments_by_supplier_year(spark: SparkSession, sf_dir: str, years: tuple[str, ...] | None = None) -> DataFrame:
    """Line items pre-aggregated per (supplier, year) *before* the supplier
    join, tagged with nation and region. With ``years`` only those ship
    years are read."""
    li = _table(spark, sf_dir, "lineitem", ["l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate"])
    if years:
        li = li.where(_ship_year_range(years))
    per_supplier = li.groupBy("l_suppkey", F.year("l_shipdate").alias("year")).agg(
        F.sum("l_quantity").alias("qty"),
        F.sum(cents(F.col("l_extendedprice") * F.col("l_discount"))).alias("disc_cents"),
        F.sum(cents("l_extendedprice")).alias("gross_cents"),
    )
    supplier = _table(spark, sf_dir, "supplier", ["s_suppkey", "s_nationkey"])
    nation = _table(spark, sf_dir, "nation", ["n_nationkey", "n_name", "n_regionkey"])
    region = _table(spark, sf_dir, "region", ["r_regionkey", "r_name"])
    # one row per (supplier, year) with its nation and region; the wide
    # table's grouping sets sum these directly (no separate nation-year step)
    return (
        per_supplier.join(supplier, per_supplier["l_suppkey"] == supplier["s_suppkey"])
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select("r_regionkey", "r_name", "n_nationkey", "n_name", "year", "qty", "disc_cents", "gross_cents")
    )


def indicator_wide(spark: SparkSession, sf_dir: str, indicator: str, years: tuple[str, ...] | None = None) -> DataFrame:
    """Wide indicator table: Country Name, Country Code, Indicator Name,
    Indicator Code, then one double column per year. Region (``R01``) and
    world (``WLD``) aggregate rows are included, as in the World Bank files.
    ``years`` limits the table to the year columns an analysis will pick, so
    only those ship years are scanned and aggregated. Without it, a ship year
    that has no column raises an error."""
    name, code = INDICATORS[indicator]
    base = shipments_by_supplier_year(spark, sf_dir, years)
    keys = ["r_regionkey", "r_name", "n_nationkey", "n_name"]
    wanted = [str(y) for y in sorted({int(y) for y in years})] if years else YEARS
    known = F.col("year").isin([int(y) for y in wanted]) | F.col("year").isNull()
    unknown = F.raise_error(F.format_string("no column for ship year %d", F.col("year"))).cast("int")
    base = base.withColumn("year", F.when(known, F.col("year")).otherwise(unknown))

    # one conditional sum per year (a pivot that also works under grouping sets)
    def per_year(y: str) -> list[Column]:
        if indicator == "arrivals":
            return [F.expr(f"sum(CASE WHEN year = {y} THEN qty END) AS `{y}`")]
        return [
            F.expr(f"sum(CASE WHEN year = {y} THEN disc_cents END) AS _d{y}"),
            F.expr(f"sum(CASE WHEN year = {y} THEN gross_cents END) AS _g{y}"),
        ]

    def value(y: str) -> Column:
        if indicator == "arrivals":
            return F.expr(f"CAST(`{y}` AS DOUBLE) AS `{y}`")
        return F.expr(_PERCENT.format(d=f"_d{y}", g=f"_g{y}") + f" AS `{y}`")

    wide = base.groupingSets([keys, keys[:2], []], *keys).agg(
        F.grouping("n_nationkey").alias("_gn"),
        F.grouping("r_regionkey").alias("_gr"),
        *[a for y in wanted for a in per_year(y)],
    )
    nation_row = F.col("_gn") == 0
    region_row = F.col("_gr") == 0
    return wide.select(
        F.when(nation_row, F.col("n_name")).when(region_row, F.col("r_name")).otherwise(F.lit("World")).alias("Country Name"),
        F.when(nation_row, country_code("n_nationkey"))
        .when(region_row, F.format_string("R%02d", F.col("r_regionkey")))
        .otherwise(F.lit(WORLD_CODE))
        .alias(COUNTRY_CODE),
        F.lit(name).alias("Indicator Name"),
        F.lit(code).alias("Indicator Code"),
        *[value(y) for y in wanted],
    )


def order_line_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order with the total of its line items: null for an order that
    has none."""
    orders = _table(spark, sf_dir, "orders", ["o_orderkey", "o_orderstatus"])
    lines = _table(spark, sf_dir, "lineitem", ["l_orderkey", "l_extendedprice"])
    totals = lines.groupBy("l_orderkey").agg(F.sum(cents("l_extendedprice")).alias("line_cents"))
    return orders.join(totals, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        "o_orderkey", "o_orderstatus", "line_cents"
    )


def customer_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer with the total of its orders (null without orders)."""
    orders = _table(spark, sf_dir, "orders", ["o_custkey", "o_totalprice"])
    totals = orders.groupBy("o_custkey").agg(F.sum(cents("o_totalprice")).alias("total_cents"))
    customer = _table(spark, sf_dir, "customer", ["c_custkey"])
    return customer.join(totals, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "total_cents")


def indicator_pair(spark: SparkSession, sf_dir: str, expenditure_year: str, arrivals_year: str) -> DataFrame:
    """(iso3, expenditure, arrivals) of the nations from one read of the line
    items: both ship years in one filter, one partial aggregate per (supplier,
    year), one supplier join. The same values as the two wide tables give."""
    years = tuple(dict.fromkeys((expenditure_year, arrivals_year)))
    base = shipments_by_supplier_year(spark, sf_dir, years)
    of = lambda year, value: F.sum(F.when(F.col("year") == int(year), F.col(value)))
    sums = base.groupBy("n_nationkey").agg(
        of(expenditure_year, "disc_cents").alias("_d"),
        of(expenditure_year, "gross_cents").alias("_g"),
        of(arrivals_year, "qty").cast("double").alias("arrivals"),
    )
    return sums.select(
        country_code("n_nationkey").alias("iso3"),
        F.expr(_PERCENT.format(d="_d", g="_g")).alias("expenditure"),
        "arrivals",
    )


def event_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with an integer value (cents) and a unique order (ts, event_id)."""
    ev = _table(spark, sf_dir, "events", ["event_id", "ts", "value"])
    return ev.select("event_id", "ts", cents("value").alias("value_cents"))
