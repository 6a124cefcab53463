"""Years told from texts: digits of ids and numbers before 2000 are none; against the SQL on orders made for it."""

from __future__ import annotations

import datetime

from ledgerlift.plans import oracle
from ledgerlift.plans.queries import QUERIES

from .test_queries import duckdb, plain


def against_sql(spark, path, name: str, orders: list[tuple]) -> list[tuple]:
    """The rows of a query over orders (key, company, status, price, date), equal to those of its SQL."""
    kind = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp"
    spark.createDataFrame(orders, kind).write.mode("overwrite").parquet(f"{path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{path}/orders.parquet/*.parquet'")
    found = con.execute(oracle.SQL[name])
    names = [d[0] for d in found.description]
    got = sorted(tuple(plain(v) for v in r) for r in QUERIES[name](spark, str(path)).select(*names).collect())
    assert got == sorted(tuple(plain(v) for v in r) for r in found.fetchall())
    return got


def test_ids_tell_no_year(spark, tmp_path):
    """Companies 10002058 and 10202099: 20dd in their ids is no year of their documents."""
    day = datetime.datetime
    orders = [(1, 2058, "F", 50000.0, day(1999, 5, 1)), (2, 2058, "F", 60000.0, day(2001, 5, 1)), (3, 202099, "P", 70000.0, day(1998, 5, 1)), (4, 7, "O", 70000.0, day(2000, 5, 1))]
    assert len(against_sql(spark, tmp_path, "latest_document", orders)) == 4


def test_numbers_before_2000_head_no_column(spark, tmp_path):
    """Without a year from 2000 on in a document, an amount that equals the fixture's year is no header."""
    day = datetime.datetime(1999, 5, 1)
    orders = [(k, 7, "F", float(amount), day) for k, amount in enumerate((1989, 1990, 1991, 1999, 2000, 2001, 9999, 10000))]
    against_sql(spark, tmp_path, "fallback_column", orders)
