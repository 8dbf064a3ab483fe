"""Registered queries against DuckDB on the smallest tables."""

import collections
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CORE = [k for k in entry.oracle_sql() if not k.startswith("op") and k != "pipeline"]


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def bag(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(n for n in names), collections.Counter(tuple(f"{r[k]:.9g}" if isinstance(r[k], float) else str(r[k]) for k in order) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", CORE)
def test_query(spark, oracle, name):
    df = entry.queries()[name](spark, SF)
    got = oracle.execute(entry.oracle_sql()[name])
    names = [d[0] for d in got.description]
    assert bag([tuple(r) for r in df.collect()], df.columns) == bag(got.fetchall(), names)


def test_entry(spark):
    assert entry.entry(spark).collect()[0]["name"] == "ASIA"
