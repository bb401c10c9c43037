"""Registry: query name -> (Spark function, SQL text or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is what DuckDB runs for the same result."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


#: Votes by (region, nation): ordered quantity.
V_SQL = """v AS (
  SELECT r.r_name AS contest, n.n_name AS party,
         CAST(SUM(CAST(l.l_quantity AS BIGINT)) AS BIGINT) AS votes
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  GROUP BY 1, 2)"""

#: Votes by (region, nation, segment): order value in cents.
SEG_SQL = """seg AS (
  SELECT r.r_name AS region, n.n_name AS nation, c.c_mktsegment AS segment,
         CAST(SUM(CAST(ROUND(o.o_totalprice * 100) AS BIGINT)) AS BIGINT) AS votes
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  GROUP BY 1, 2, 3)"""

#: Per nation: capacity from customers, district wins (head start) from suppliers.
CAP_SQL = """cap AS (
  SELECT n.n_name AS party, COUNT(c.c_custkey) % 12 AS capacity
  FROM nation n LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey GROUP BY 1),
head AS (
  SELECT n.n_name AS party, COUNT(s.s_suppkey) AS wins
  FROM nation n LEFT JOIN supplier s ON s.s_nationkey = n.n_nationkey GROUP BY 1)"""
