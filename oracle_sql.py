"""DuckDB SQL for every registered query (the correctness oracle).

Written independently of the Spark code from the definitions in
``epilens/sources/driver_tables.py`` and the operators' documented
semantics. Tables are the driver's pre-registered views. DuckDB differs from
Spark in a few places, handled here:

* SUM(bigint) is HUGEINT  -> CAST(... AS BIGINT)
* skewness is sample-adjusted -> the population formula is spelled out
* round(x, 6) on statistics, as in the Spark queries
"""

from __future__ import annotations

SNAPSHOT = "DATE '2001-07-01'"
EXP_YEAR, ARR_YEAR = "1996", "1998"
EXP = f"Health Expenditure Percentage of GDP in {EXP_YEAR}"
ARR = f"Number of Arrivals in {ARR_YEAR}"
YEARS = [str(y) for y in range(1994, 2002)]

CASES = """
obs AS (
  SELECT CASE o_orderstatus WHEN 'F' THEN 'Confirmed' WHEN 'O' THEN 'Deaths' WHEN 'P' THEN 'Active' END AS Case_Type,
         printf('N%02d', c_nationkey) AS iso3,
         c_mktsegment AS Province_State,
         CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
         CAST(round(o_totalprice * 100) AS BIGINT) AS cents
  FROM orders JOIN customer ON o_custkey = c_custkey),
monthly AS (
  SELECT Case_Type, iso3, Province_State, month, CAST(SUM(cents) AS BIGINT) AS new_cases
  FROM obs GROUP BY Case_Type, iso3, Province_State, month),
runs AS (
  SELECT Case_Type, iso3, Province_State, month,
         CAST(SUM(new_cases) OVER (PARTITION BY Case_Type, iso3, Province_State ORDER BY month
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS Cases,
         LEAD(month) OVER (PARTITION BY Case_Type, iso3, Province_State ORDER BY month) AS next_month
  FROM monthly),
dense AS (
  SELECT Case_Type, iso3, Province_State, Cases,
         CAST(UNNEST(generate_series(CAST(month AS TIMESTAMP),
              CAST(COALESCE(next_month - INTERVAL 1 MONTH,
                   (SELECT MAX(CAST(date_trunc('month', o_orderdate) AS DATE)) FROM orders)) AS TIMESTAMP),
              INTERVAL 1 MONTH)) AS DATE) AS day
  FROM runs),
pop AS (
  SELECT printf('N%02d', c_nationkey) AS iso3, c_mktsegment AS Province_State, COUNT(*) AS Population_Count
  FROM customer GROUP BY 1, 2),
cases_raw AS (
  SELECT d.Case_Type, d.Cases, strftime(d.day, '%m/%d/%Y') AS Date,
         concat_ws(', ', d.iso3, d.Province_State) AS Combined_Key, d.Province_State, d.iso3, p.Population_Count
  FROM dense d LEFT JOIN pop p ON p.iso3 = d.iso3 AND p.Province_State = d.Province_State),
cases_clean AS (
  SELECT Case_Type, Cases, iso3, Population_Count, CAST(strptime(Date, '%m/%d/%Y') AS DATE) AS Date
  FROM cases_raw
  WHERE Case_Type IS NOT NULL AND Cases IS NOT NULL AND iso3 IS NOT NULL
    AND Population_Count IS NOT NULL AND Date IS NOT NULL),
cases_per_country AS (
  SELECT iso3, CAST(SUM(Cases) AS BIGINT) AS Number_Of_Cases, CAST(SUM(Population_Count) AS BIGINT) AS Population
  FROM cases_clean WHERE Case_Type = 'Confirmed' AND Date = {snap} GROUP BY iso3),
deaths_per_country AS (
  SELECT iso3, CAST(SUM(Cases) AS BIGINT) AS Number_Of_Deaths, CAST(SUM(Population_Count) AS BIGINT) AS Population
  FROM cases_clean WHERE Case_Type = 'Deaths' AND Date = {snap} GROUP BY iso3)
""".replace("{snap}", SNAPSHOT)


def _wide_year(y: str, kind: str) -> str:
    if kind == "arrivals":
        return f'CAST(SUM(CASE WHEN year = {y} THEN qty END) AS DOUBLE) AS "{y}"'
    return (
        f"CAST(CAST((SUM(CASE WHEN year = {y} THEN disc_cents END) * 10000) // "
        f'SUM(CASE WHEN year = {y} THEN gross_cents END) AS BIGINT) AS DOUBLE) / CAST(100 AS DOUBLE) AS "{y}"'
    )


def _wide(kind: str, name: str, code: str) -> str:
    years = ",\n         ".join(_wide_year(y, kind) for y in YEARS)
    return f"""
{kind}_wide AS (
  SELECT CASE WHEN GROUPING(n_nationkey) = 0 THEN n_name WHEN GROUPING(r_regionkey) = 0 THEN r_name
              ELSE 'World' END AS "Country Name",
         CASE WHEN GROUPING(n_nationkey) = 0 THEN printf('N%02d', n_nationkey)
              WHEN GROUPING(r_regionkey) = 0 THEN printf('R%02d', r_regionkey) ELSE 'WLD' END AS "Country Code",
         '{name}' AS "Indicator Name", '{code}' AS "Indicator Code",
         {years}
  FROM ship
  GROUP BY GROUPING SETS ((r_regionkey, r_name, n_nationkey, n_name), (r_regionkey, r_name), ()))"""


INDICATORS = (
    """
per_supplier AS (
  SELECT l_suppkey, year(l_shipdate) AS year, SUM(l_quantity) AS qty,
         CAST(SUM(CAST(round(l_extendedprice * l_discount * 100) AS BIGINT)) AS BIGINT) AS disc_cents,
         CAST(SUM(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS gross_cents
  FROM lineitem GROUP BY 1, 2),
ship AS (
  SELECT r_regionkey, r_name, n_nationkey, n_name, year, SUM(qty) AS qty,
         CAST(SUM(disc_cents) AS BIGINT) AS disc_cents, CAST(SUM(gross_cents) AS BIGINT) AS gross_cents
  FROM per_supplier JOIN supplier ON l_suppkey = s_suppkey
       JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY 1, 2, 3, 4, 5),"""
    + _wide("arrivals", "International arrivals (units shipped)", "ST.INT.ARVL")
    + ","
    + _wide("expenditure", "Discount as % of gross revenue", "SH.XPD.CHEX.GD.ZS")
    + f""",
expenditure AS (
  SELECT "Country Code" AS iso3, "{EXP_YEAR}" AS "{EXP}" FROM expenditure_wide
  WHERE "Country Code" IS NOT NULL AND "{EXP_YEAR}" IS NOT NULL AND NOT isnan("{EXP_YEAR}")),
arrivals AS (
  SELECT "Country Code" AS iso3, "{ARR_YEAR}" AS "{ARR}" FROM arrivals_wide
  WHERE "Country Code" IS NOT NULL AND "{ARR_YEAR}" IS NOT NULL AND NOT isnan("{ARR_YEAR}"))"""
)


def _with(body: str, indicators: bool = False) -> str:
    ctes = CASES + ("," + INDICATORS if indicators else "")
    return f"WITH {ctes}\n{body}"


def _join_sql(factor: str, measure: str) -> str:
    per = "cases_per_country" if measure == "Number_Of_Cases" else "deaths_per_country"
    label, ind = (EXP, "expenditure") if factor == "expenditure" else (ARR, "arrivals")
    return f'SELECT t.iso3, t.{measure}, i."{label}" FROM {per} t JOIN {ind} i ON t.iso3 = i.iso3'


def _corr_expr(x: str, y: str) -> str:
    return f"ROUND(covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})), 6)"


def _corr_sql(factor: str, measure: str) -> str:
    if factor == "population":
        per = "cases_per_country" if measure == "Number_Of_Cases" else "deaths_per_country"
        src, label = per, "Population"
        x = "Population"
    else:
        label = EXP if factor == "expenditure" else ARR
        src = f"({_join_sql(factor, measure)})"
        x = f'"{label}"'
    return (
        f"SELECT '{measure}' AS measure, '{label}' AS factor, COUNT(*) AS n_pairs, "
        f"{_corr_expr(f'CAST({x} AS DOUBLE)', f'CAST({measure} AS DOUBLE)')} AS correlation FROM {src} s"
    )


def _scatter_sql(factor: str, measure: str) -> str:
    if factor == "population":
        per = "cases_per_country" if measure == "Number_Of_Cases" else "deaths_per_country"
        return f"SELECT Population, {measure} FROM {per}"
    label = EXP if factor == "expenditure" else ARR
    return f'SELECT "{label}", {measure} FROM ({_join_sql(factor, measure)}) j'


def _share_sql(per: str, measure: str) -> str:
    return f"SELECT iso3, {measure}, {measure} / (SELECT SUM({measure}) FROM {per}) AS share FROM {per}"


WORLDWIDE = (
    "SELECT Date, CAST(SUM(Cases) AS BIGINT) AS Number_Of_Cases FROM cases_clean "
    "WHERE Case_Type = 'Confirmed' GROUP BY Date"
)

CLEAN_COLS = "Case_Type, Cases, iso3, Population_Count, Date"


def _all_pairs() -> str:
    per_key = f"""
per_key AS (
  SELECT iso3,
         CAST(SUM(CASE WHEN Case_Type = 'Confirmed' THEN Cases END) AS BIGINT) AS nc,
         CAST(SUM(CASE WHEN Case_Type = 'Confirmed' THEN Population_Count END) AS BIGINT) AS pc,
         CAST(SUM(CASE WHEN Case_Type = 'Deaths' THEN Cases END) AS BIGINT) AS nd,
         CAST(SUM(CASE WHEN Case_Type = 'Deaths' THEN Population_Count END) AS BIGINT) AS pd
  FROM cases_clean WHERE Case_Type IN ('Confirmed', 'Deaths') AND Date = {SNAPSHOT} GROUP BY iso3),
frame AS (
  SELECT p.*, e."{EXP}" AS ex, a."{ARR}" AS ar
  FROM per_key p LEFT JOIN expenditure e ON p.iso3 = e.iso3 LEFT JOIN arrivals a ON p.iso3 = a.iso3)"""
    pairs = [
        ("pc", "nc", "Population", "Number_Of_Cases"),
        ("pd", "nd", "Population", "Number_Of_Deaths"),
        ("ex", "nc", EXP, "Number_Of_Cases"),
        ("ex", "nd", EXP, "Number_Of_Deaths"),
        ("ar", "nc", ARR, "Number_Of_Cases"),
        ("ar", "nd", ARR, "Number_Of_Deaths"),
    ]
    selects = []
    for x, y, fl, ml in pairs:
        selects.append(
            f"SELECT '{ml}' AS measure, '{fl}' AS factor, COUNT(*) AS n_pairs, "
            f"{_corr_expr(f'CAST({x} AS DOUBLE)', f'CAST({y} AS DOUBLE)')} AS correlation "
            f"FROM frame WHERE {x} IS NOT NULL AND {y} IS NOT NULL"
        )
    return f"WITH {CASES},{INDICATORS},{per_key}\n" + "\nUNION ALL\n".join(selects)


SKEW = """
SELECT ROUND(sqrt(COUNT(*)) * SUM(pow(x - mu, 3)) / pow(SUM(pow(x - mu, 2)), 1.5), 6) AS "skewness(Number_Of_Cases)"
FROM (SELECT CAST(Number_Of_Cases AS DOUBLE) AS x, AVG(CAST(Number_Of_Cases AS DOUBLE)) OVER () AS mu FROM cases_per_country) s
"""


def _latest(date: str) -> str:
    return (
        "SELECT iso3, CAST(SUM(Cases) AS BIGINT) AS Number_Of_Cases, CAST(SUM(Population_Count) AS BIGINT) AS Population, "
        f"MAX(Date) AS Date FROM cases_clean WHERE Case_Type = 'Confirmed' AND Date = ({date}) GROUP BY iso3"
    )


def _listing(name: str) -> str:
    """Columns of a wide table's file: text, or double where a year has values."""
    columns = ["Country Name", "Country Code", "Indicator Name", "Indicator Code", *YEARS]
    counts = "".join(f", count(\"{c}\") AS \"{c}\"" for c in columns)
    unpivot = " UNION ALL ".join(f"SELECT {i} AS ordinal, '{c}' AS column_name, \"{c}\" AS n_values FROM k" for i, c in enumerate(columns, 1))
    return (
        f"SELECT * FROM (WITH {CASES},{INDICATORS}, k AS (SELECT 1 AS one{counts} FROM {name}_wide), u AS ({unpivot}) "
        f"SELECT CAST(ordinal AS INTEGER) AS ordinal, column_name, "
        f"CASE WHEN ordinal > 4 AND n_values > 0 THEN 'double' ELSE 'string' END AS data_type, "
        f"true AS nullable, n_values, '{name}' AS input FROM u) AS l"
    )


def oracle_sql() -> dict[str, str]:
    wide_cols = ", ".join(['"Country Name"', '"Country Code"', '"Indicator Name"', '"Indicator Code"'] + [f'"{y}"' for y in YEARS])
    q: dict[str, str] = {
        "case_table_raw": _with("SELECT * FROM cases_raw"),
        "indicator_wide_arrivals": _with(f"SELECT {wide_cols} FROM arrivals_wide", True),
        "indicator_wide_expenditure": _with(f"SELECT {wide_cols} FROM expenditure_wide", True),
        "scan_csv_inferred": _with("SELECT * FROM cases_raw"),
        "scan_csv_delimiter": _with(f"SELECT {wide_cols} FROM arrivals_wide", True),
        "temp_view_sql": _with("SELECT * FROM cases_per_country"),
        "temp_view_sql_deaths": _with("SELECT * FROM deaths_per_country"),
        "temp_view_sql_worldwide": _with(WORLDWIDE),
        "schema_columns": _with(
            # CSV inference: integers that fit 32 bits are int, else bigint; MM/dd/yyyy text stays string
            "SELECT * FROM (VALUES (1, 'Case_Type', 'string'), "
            "(2, 'Cases', CASE WHEN (SELECT MAX(ABS(Cases)) FROM cases_raw) <= 2147483647 THEN 'int' ELSE 'bigint' END), "
            "(3, 'Date', 'string'), (4, 'Combined_Key', 'string'), (5, 'Province_State', 'string'), (6, 'iso3', 'string'), "
            "(7, 'Population_Count', CASE WHEN (SELECT MAX(ABS(Population_Count)) FROM cases_raw) <= 2147483647 "
            "THEN 'int' ELSE 'bigint' END)) AS t(ordinal, column_name, data_type), (SELECT true AS nullable) AS n"
        ),
        "schema_columns_indicators": _listing("arrivals") + " UNION ALL " + _listing("expenditure"),
        "schema_contract": _with(
            "SELECT t.*, n_rows FROM (VALUES "
            + ", ".join(
                f"('{i}', '{c}', '{f}', '{k}')"
                for i, c, f, k in [
                    (i, c, "date" if (i, c) == ("clean_cases", "Date") else f, "date" if (i, c) == ("clean_cases", "Date") else k)
                    for i in ("cases", "clean_cases")
                    for c, f, k in (
                        ("Case_Type", "string", "string"), ("Cases", "integral", "bigint"), ("iso3", "string", "string"),
                        ("Population_Count", "integral", "bigint"), ("Date", "date_or_string", "string"),
                    )
                ]
                + [(i, "Country Code", "string", "string") for i in ("arrivals", "expenditure")]
            )
            + ") AS t(input, column_name, contract, data_type) JOIN ("
            "SELECT 'cases' AS input, COUNT(*) AS n_rows FROM cases_raw UNION ALL SELECT 'clean_cases', COUNT(*) FROM cases_clean "
            "UNION ALL SELECT 'arrivals', COUNT(*) FROM arrivals_wide UNION ALL SELECT 'expenditure', COUNT(*) FROM expenditure_wide"
            ") AS c ON t.input = c.input",
            True,
        ),
        "project_columns": _with("SELECT Case_Type, Cases, iso3, Population_Count, Date FROM cases_raw"),
        "parse_date_column": _with(
            "SELECT Case_Type, Cases, iso3, Population_Count, CAST(strptime(Date, '%m/%d/%Y') AS DATE) AS Date FROM cases_raw"
        ),
        "drop_null_rows": _with(f"SELECT {CLEAN_COLS} FROM cases_clean"),
        "drop_null_rows_outer": (
            "SELECT o_orderkey, o_orderstatus, CAST(SUM(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS line_cents "
            "FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL"
        ),
        "join_inner_unmatched": (
            "SELECT l.doc_id, quality, n_chars FROM labels AS l JOIN documents AS d ON l.doc_id = d.doc_id WHERE lang = 'en'"
        ),
        "rank_customers": (
            "SELECT c_custkey, total_cents, row_number() OVER (ORDER BY total_cents DESC NULLS LAST, c_custkey) AS rank FROM ("
            "SELECT c_custkey, CAST(SUM(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS total_cents "
            "FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey) AS t"
        ),
        "filter_case_type": _with(f"SELECT {CLEAN_COLS} FROM cases_clean WHERE Case_Type = 'Confirmed'"),
        "rename_columns": _with(
            "SELECT Case_Type, Cases AS Deaths, iso3, Population_Count, Date FROM cases_clean WHERE Case_Type = 'Deaths'"
        ),
        "split_by_case_type": _with(
            "SELECT 'cases' AS slice, Case_Type, Cases AS value, iso3, Date FROM cases_clean WHERE Case_Type = 'Confirmed' "
            "UNION ALL SELECT 'deaths' AS slice, Case_Type, Cases AS value, iso3, Date FROM cases_clean WHERE Case_Type = 'Deaths'"
        ),
        "filter_snapshot_date": _with(
            f"SELECT {CLEAN_COLS} FROM cases_clean WHERE Case_Type = 'Confirmed' AND Date = {SNAPSHOT}"
        ),
        "indicator_year_column": _with(
            f'SELECT "Country Code" AS iso3, "{EXP_YEAR}" FROM expenditure_wide '
            f'WHERE "Country Code" IS NOT NULL AND "{EXP_YEAR}" IS NOT NULL AND NOT isnan("{EXP_YEAR}")',
            True,
        ),
        "count_distinct_keys": _with("SELECT COUNT(DISTINCT iso3) AS Number_Of_Countries FROM cases_clean"),
        "count_distinct_arrivals_keys": _with("SELECT COUNT(DISTINCT iso3) AS Number_Of_Countries FROM arrivals", True),
        "count_distinct_expenditure_keys": _with(
            "SELECT COUNT(DISTINCT iso3) AS Number_Of_Countries FROM expenditure", True
        ),
        "snapshot_cases_by_key": _with("SELECT * FROM cases_per_country"),
        "snapshot_deaths_by_key": _with("SELECT * FROM deaths_per_country"),
        "snapshot_avg_by_key": _with(
            "SELECT iso3, ROUND(AVG(Cases), 6) AS Average_Cases, CAST(SUM(Population_Count) AS BIGINT) AS Population "
            f"FROM cases_clean WHERE Case_Type = 'Confirmed' AND Date = {SNAPSHOT} GROUP BY iso3"
        ),
        "latest_snapshot": _with(_latest("SELECT MAX(Date) FROM cases_clean")),
        "latest_snapshot_of_type": _with(_latest("SELECT MAX(Date) FROM cases_clean WHERE Case_Type = 'Confirmed'")),
        "rank_keys_by_measure": _with(
            "SELECT iso3, Number_Of_Cases, Population, "
            "row_number() OVER (ORDER BY Number_Of_Cases DESC NULLS LAST, iso3) AS rank FROM cases_per_country"
        ),
        "top_n_keys": _with(
            "SELECT * FROM (SELECT iso3, Number_Of_Cases, Population, "
            "CAST(row_number() OVER (ORDER BY Number_Of_Cases DESC NULLS LAST, iso3) AS INTEGER) AS rank "
            "FROM cases_per_country) r WHERE rank <= 10"
        ),
        "preview_first_50": _with(f"SELECT {CLEAN_COLS} FROM cases_clean ORDER BY {CLEAN_COLS} LIMIT 50"),
        "preview_arrivals_50": _with(
            f'SELECT iso3, "{ARR}" AS "{ARR_YEAR}" FROM arrivals ORDER BY iso3, "{ARR_YEAR}" LIMIT 50', True
        ),
        "preview_expenditure_50": _with(
            f'SELECT iso3, "{EXP}" AS "{EXP_YEAR}" FROM expenditure ORDER BY iso3, "{EXP_YEAR}" LIMIT 50', True
        ),
        "corr_all_pairs": _all_pairs(),
        "corr_report": (
            "SELECT measure, factor, 'The correlation between ' || factor || ' and ' || measure || ' is: ' || "
            "COALESCE(printf('%.6f', correlation), 'undefined') AS report FROM (" + _all_pairs() + ") c"
        ),
        "skewness_measure": _with(SKEW),
        "worldwide_total_by_date": _with(WORLDWIDE),
        "stream_totals_by_date": _with(WORLDWIDE),
        "lag_previous_row": _with(
            f"SELECT Date, Number_Of_Cases, LAG(Number_Of_Cases) OVER (ORDER BY Date) AS Previous_Number_Of_Cases FROM ({WORLDWIDE}) w"
        ),
        "daily_new_cases": _with(
            f'SELECT Date, Number_Of_Cases, Number_Of_Cases - LAG(Number_Of_Cases) OVER (ORDER BY Date) AS "Number of New Cases" '
            f"FROM ({WORLDWIDE}) w"
        ),
        "lag_bucketed": (
            "SELECT event_id, ts, value_cents, LAG(value_cents) OVER (ORDER BY ts, event_id) AS prev_value_cents "
            "FROM (SELECT event_id, ts, CAST(round(value * 100) AS BIGINT) AS value_cents FROM events) e"
        ),
        "chart_series_by_key": _with("SELECT iso3, Number_Of_Cases FROM cases_per_country"),
        "chart_share_by_key": _with(_share_sql("cases_per_country", "Number_Of_Cases")),
        "chart_share_deaths_by_key": _with(_share_sql("deaths_per_country", "Number_Of_Deaths")),
        "chart_series_over_time": _with(
            "SELECT Case_Type, Date, CAST(SUM(Cases) AS BIGINT) AS value FROM cases_clean "
            "WHERE Case_Type IN ('Confirmed', 'Deaths') GROUP BY ALL"
        ),
        "chart_series_deaths_over_time": _with(
            "SELECT Date, CAST(SUM(Cases) AS BIGINT) AS Deaths FROM cases_clean WHERE Case_Type = 'Deaths' GROUP BY Date"
        ),
    }
    for factor in ("expenditure", "arrivals"):
        for measure, short in (("Number_Of_Cases", "cases"), ("Number_Of_Deaths", "deaths")):
            q[f"join_{factor}_{short}"] = _with(_join_sql(factor, measure), True)
    for factor in ("population", "expenditure", "arrivals"):
        for measure, short in (("Number_Of_Cases", "cases"), ("Number_Of_Deaths", "deaths")):
            q[f"scatter_{factor}_{short}"] = _with(_scatter_sql(factor, measure), factor != "population")
            q[f"corr_{factor}_{short}"] = _with(_corr_sql(factor, measure), factor != "population")
    return q
