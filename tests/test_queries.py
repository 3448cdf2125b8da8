"""Every registered query against its SQL in DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from brindle.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    one = lambda v: round(v, 4) + 0.0 if isinstance(v, float) else v
    return sorted(([one(r[i]) for i in order] for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_as_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    sql = duck.sql(registry.SQL[name])
    assert sorted(df.columns) == sorted(sql.columns)
    ours, theirs = plain([tuple(r) for r in df.collect()], df.columns), plain(sql.fetchall(), sql.columns)
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs, strict=True):
        assert a == b or all(x == y or isinstance(x, float) and abs(x - y) < 2e-4 for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0


def test_flagship():
    assert registry.FLAGSHIP in registry.QUERIES
