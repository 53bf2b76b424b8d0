"""Registered queries against their SQL in DuckDB, and the driver contract."""

import datetime
import decimal
import math
from pathlib import Path

import duckdb
import pytest

from clausewise.adapt import Tables
from clausewise.plans import registry

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="driver tables are absent")


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return None if math.isnan(float(v)) else round(float(v), 6)
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in FOLDER.iterdir():
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(k for k, (_, sql) in registry().items() if sql))
def test_query_matches_sql(spark, duck, name):
    plan, sql = registry()[name]
    df = plan(Tables(spark, str(FOLDER)))
    got = duck.execute(sql)
    columns = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    ours = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    theirs = sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in got.fetchall()), key=repr)
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(k for k, (_, sql) in registry().items() if not sql))
def test_query_without_sql_runs(spark, name):
    assert registry()[name][0](Tables(spark, str(FOLDER))).count() > 0


def test_entry_and_names(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
