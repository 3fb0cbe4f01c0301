"""Every registered query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline"]


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, dict):
        return tuple(map(plain, v.values()))
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


def rows(columns, found):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(plain(r[i]) for i in at) for r in found), key=str)


@pytest.fixture(scope="module")
def db(data):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{data}/{t}.parquet"):
            c.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, db, data, name):
    df = entry.queries()[name](spark, data)
    r = db.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in r.description]
    assert sorted(df.columns) == sorted(columns)
    mine, sql = rows(df.columns, map(tuple, df.collect())), rows(columns, r.fetchall())
    assert mine == sql
    assert mine, "a query without rows shows nothing"


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["term", "n"] and df.count() == 12


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
