"""Every registered query of the score-analytics operators against DuckDB, at the smallest scale."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest

from neumata import catalog

SF = "/root/testdata/sf0.001"
SQL = catalog.oracle_sql()


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


def rows(names, found):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(names), sorted((tuple(plain(r[k]) for k in order) for r in found), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    want = duck.execute(SQL[name])
    assert rows(df.columns, df.collect()) == rows([c[0] for c in want.description], want.fetchall())


def test_registry():
    assert len(SQL) > 60 and set(SQL) <= set(catalog.queries())
