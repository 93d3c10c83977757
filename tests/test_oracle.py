"""Every registered query with SQL equals DuckDB on the smallest tables; the others run and give rows."""

import glob
import os

import duckdb
import pytest

from matchloom.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda x: "null" if x is None or x != x else f"{x:.9g}" if isinstance(x, float) else str(x).removesuffix(" 00:00:00")
    return sorted(columns), sorted(tuple(show(v[i]) for i in order) for v in values)


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name in SQL:
        result = con.execute(SQL[name])
        names = [d[0] for d in result.description]
        assert got == rows(names, result.fetchall())
    else:
        assert got[1]


def test_names():
    assert set(SQL) <= set(QUERIES)
