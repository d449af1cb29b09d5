"""Every query runs on the smallest tables, and agrees with its SQL where it has one."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    rows, sql = df.collect(), registry.ORACLE_SQL.get(name)
    if sql:
        r = con.sql(sql)
        assert sorted(df.columns) == sorted(r.columns)
        at = [r.columns.index(c) for c in df.columns]
        assert sorted(tuple(map(plain, x)) for x in rows) == sorted(tuple(plain(x[i]) for i in at) for x in r.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
