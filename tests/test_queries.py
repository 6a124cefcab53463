"""Every registered query that has SQL, against DuckDB over the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__
from ledgerlift.plans import oracle
from ledgerlift.plans.queries import QUERIES

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def base():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(value):
    return str(round(value, 6)) if isinstance(value, float) else str([plain(v) for v in value]) if isinstance(value, list) else str(value)


@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(oracle.SQL)))
def test_query_against_sql(spark, base, name):
    got = QUERIES[name](spark, SF)
    found = base.execute(oracle.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(tuple(plain(v) for v in r) for r in got.select(*names).collect()) == sorted(tuple(plain(v) for v in r) for r in found.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == QUERIES["extract_revenue"](spark, SF).columns
    assert set(QUERIES) <= set(__spark_entry__.queries())
