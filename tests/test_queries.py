"""Every query with SQL gives the same rows in DuckDB; the others run and keep their schema on empty tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")

from factmill.plans import catalog  # noqa: E402

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    return c


def _plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return tuple(map(_plain, v)) if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_as_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, DATA)
    r = con.execute(catalog.SQL[name])
    columns = [d[0] for d in r.description]
    assert sorted(columns) == sorted(df.columns)
    at = [columns.index(c) for c in df.columns]
    assert sorted(map(str, (_plain(tuple(x)) for x in df.collect()))) == sorted(map(str, (_plain(tuple(x[i] for i in at)) for x in r.fetchall())))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() >= 0
