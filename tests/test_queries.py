"""Every registered query runs on the smallest tables and agrees with its SQL."""

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = [n for n in entry._own()[0]]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else repr(round(v, 9)) if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", OWN)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    mine = Counter(tuple(map(plain, r)) for r in df.select(*columns).collect())
    sql = entry.oracle_sql().get(name)
    if sql:
        found = duck.execute(sql)
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        theirs = Counter(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())
        assert mine == theirs


def test_entry(spark):
    assert entry.entry(spark).count() > 0
