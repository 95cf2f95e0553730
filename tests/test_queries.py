"""Every registered query against its SQL, on the smallest tables."""

import datetime
import decimal
import math
import os

import pytest

from cohortlake.plans import queries

FOLDER = os.environ.get("COHORT_TABLES", "/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.10g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def sql():
    db = duckdb.connect()
    for name in os.listdir(FOLDER):
        db.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{FOLDER}/{name}')")
    return db


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, sql, name):
    got = queries.queries()[name](spark, FOLDER)
    columns = sorted(got.columns)
    rows = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in got.collect())
    want = sql.sql(queries.oracle_sql()[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert rows == sorted(repr(tuple(plain(r[i]) for i in at)) for r in want.fetchall())


def test_every_query_has_sql():
    assert set(queries.queries()) == set(queries.oracle_sql())


def test_narrow_reads(spark):
    plan = queries.queries()["equipment_inventory"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan
