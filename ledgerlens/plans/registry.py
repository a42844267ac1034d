"""Registry of checkable queries: each name maps to a Spark callable
``(spark, sf_dir) -> DataFrame`` and, where the result is SQL-expressible,
the DuckDB SQL computing the same table over the same parquet views."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        fn.query_name = name
        return fn
    return deco


# Shared SQL for the derived fact tables (same joins as sources.fixtures).
SALES_FACT_SQL = """sales_fact AS (
  SELECT l.l_orderkey, l.l_linenumber, l.l_suppkey, l.l_shipdate, o.o_custkey, l.l_partkey, p.p_brand,
         r.r_name, o.o_orderpriority, l.l_extendedprice, l.l_quantity, l.l_discount, l.l_linestatus,
         l.l_returnflag, c.c_mktsegment
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  JOIN part p ON l.l_partkey = p.p_partkey)"""

SALES_LEDGER_SQL = SALES_FACT_SQL + """,
sales_ledger AS (
  SELECT *, 'Sales' AS value_type, l_extendedprice AS amount FROM sales_fact
  UNION ALL
  SELECT *, 'Discount' AS value_type, -l_extendedprice * l_discount AS amount FROM sales_fact)"""


def all_queries() -> dict[str, Callable]:
    import ledgerlens.plans.catalog  # noqa: F401  (registers everything)
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    import ledgerlens.plans.catalog  # noqa: F401
    return dict(ORACLE)
