"""Every query of the library against DuckDB on the smallest tables."""

import decimal

import duckdb
import pytest

import __spark_entry__ as entry_module
from plycast.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, (float, decimal.Decimal)) and not isinstance(v, bool):
        return None if v != v else round(float(v), 5)
    if isinstance(v, int) and not isinstance(v, bool):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows(spark, duck, small, name):
    df = registry.QUERIES[name](spark, small)
    cols = sorted(df.columns)
    mine = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    got = duck.execute(registry.ORACLE_SQL[name])
    names = [x[0] for x in got.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    theirs = sorted((tuple(norm(r[i]) for i in at) for r in got.fetchall()), key=repr)
    assert mine == theirs


def test_entry(spark, small):
    assert entry_module.entry(spark).count() > 0


def test_queries_without_sql_run(spark, small):
    for name in sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)):
        assert registry.QUERIES[name](spark, small).count() > 0, name
