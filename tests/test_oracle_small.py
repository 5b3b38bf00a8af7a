"""Every registered query against its DuckDB oracle on sf0.001 (the driver
does the same at sf0.01)."""

import datetime as dt
import math
import os

import duckdb
import pytest

from conftest import SF_SMALL

import __spark_entry__ as E
from epilens.plans.queries import QUERIES
from oracle_sql import oracle_sql

TABLES = "region nation customer supplier part orders lineitem events documents labels".split()


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, (dt.date, dt.datetime)):
        return v.isoformat()
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF_SMALL, t)}.parquet')")
    return c


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(oracle_sql())
    assert set(QUERIES) <= set(E.queries()) and set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF_SMALL)
    res = con.execute(E.oracle_sql()[name])
    o_cols = [d[0] for d in res.description]
    assert sorted(sdf.columns) == sorted(o_cols)
    assert _rows(sdf.columns, sdf.collect()) == _rows(o_cols, res.fetchall())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["measure", "factor", "n_pairs", "correlation"]
    assert df.count() == 6
