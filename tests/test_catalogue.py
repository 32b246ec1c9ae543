"""Every query with an SQL twin against DuckDB on the smallest tables; those without must give rows."""

import os

import duckdb
import pytest

from helixframe.plans import catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        path = f"{DATA}/{f}" if os.path.isfile(f"{DATA}/{f}") else f"{DATA}/{f}/*.parquet"
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{path}')")
    return c


def plain(v):
    if v is None or v != v:
        return None
    return round(float(v), 6) if isinstance(v, float) else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(repr(tuple(plain(r[i]) for i in order)) for r in data)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, con, name):
    df = catalogue.queries()[name](spark, DATA)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert got[1]
        return
    found = con.execute(sql)
    want = rows([c[0] for c in found.description], found.fetchall())
    assert got == want


def test_flagship():
    assert catalogue.FLAGSHIP in catalogue.queries() and set(catalogue.oracle_sql()) <= set(catalogue.queries())
