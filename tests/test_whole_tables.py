"""Queries that must look at all orders, against their SQL without its filters of keys."""

from __future__ import annotations

import pytest

from ledgerlift.plans import oracle
from ledgerlift.plans.queries import QUERIES

from .test_queries import SF, base, duckdb, plain  # noqa: F401


def against_whole_sql(spark, base, name, cut, sf=SF):  # noqa: F811
    sql = oracle.SQL[name].replace(cut, "")
    assert "key % 4" not in sql
    found = base.execute(sql)
    names = [d[0] for d in found.description]
    got = QUERIES[name](spark, sf).select(*names).collect()
    assert got
    assert sorted(tuple(plain(v) for v in r) for r in got) == sorted(tuple(plain(v) for v in r) for r in found.fetchall())


@pytest.mark.parametrize("name", ["upsert_results", "exceptions_report", "run_stats"])
def test_run_takes_all_orders(spark, base, name):  # noqa: F811
    against_whole_sql(spark, base, name, " WHERE key % 4 <> 0")


def test_missing_documents_looks_at_the_whole_index(spark):
    sf = SF.replace("0.001", "0.01")  # the smallest tables with customers that lack a form
    con = duckdb.connect()
    for name in ("customer", "orders"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    against_whole_sql(spark, con, "missing_documents", " AND key % 4 = 0", sf)
