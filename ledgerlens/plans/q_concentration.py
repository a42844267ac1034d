"""Pareto / ABC queries on the sales fact table (customers by revenue)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators.pareto import abc_detail, abc_summary, concentration, pareto_abc
from ledgerlens.plans.registry import SALES_FACT_SQL, register
from ledgerlens.sources.fixtures import sales_fact


def revenue_fact(spark, sf_dir):
    """Sales fact with revenue as exact cents, so sums do not depend on order."""
    return sales_fact(spark, sf_dir).withColumn("revenue", F.col("l_extendedprice").cast("decimal(18,2)"))


def customer_pareto(spark, sf_dir, dim="o_custkey", a=80.0, b=95.0):
    return pareto_abc(revenue_fact(spark, sf_dir), dim, "revenue", a, b)


_PARETO_SQL = "WITH " + SALES_FACT_SQL + """,
agg AS (
  SELECT {dim}, SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS value
  FROM sales_fact WHERE {dim} IS NOT NULL GROUP BY {dim}
  HAVING SUM(CAST(l_extendedprice AS DECIMAL(18,2))) > 0),
ranked AS (
  SELECT {dim}, value,
         SUM(value) OVER (ORDER BY value DESC, {dim} ASC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_value,
         ROW_NUMBER() OVER (ORDER BY value DESC, {dim} ASC) AS rnk,
         SUM(value) OVER () AS total, COUNT(*) OVER () AS n_items
  FROM agg),
pareto AS (
  SELECT {dim}, value, CAST(value AS DOUBLE) / CAST(total AS DOUBLE) AS share,
         CAST(cum_value AS DOUBLE) / CAST(total AS DOUBLE) * 100.0 AS cum_pct,
         CASE WHEN rnk = 1 THEN 'A'
              WHEN CAST(cum_value AS DOUBLE) / CAST(total AS DOUBLE) * 100.0 <= {a} THEN 'A'
              WHEN CAST(cum_value AS DOUBLE) / CAST(total AS DOUBLE) * 100.0 <= {b} THEN 'B'
              ELSE 'C' END AS class,
         CAST(rnk AS BIGINT) AS rank, n_items
  FROM ranked)"""


def _pareto_sql(dim="o_custkey", a=80.0, b=95.0):
    return _PARETO_SQL.format(dim=dim, a=a, b=b)


@register("pareto_abc", _pareto_sql() + """
SELECT o_custkey, CAST(value AS DOUBLE) AS value, share, cum_pct, class, rank FROM pareto""")
def q_pareto_abc(spark, sf_dir):
    """Customers by revenue: cumulative share and ABC class (80/95)."""
    p = customer_pareto(spark, sf_dir)
    return p.select("o_custkey", F.col("value").cast("double").alias("value"), "share", "cum_pct",
                    "class", "rank")


@register("pareto_abc_brand", _pareto_sql("p_brand", 70.0, 90.0) + """
SELECT p_brand, CAST(value AS DOUBLE) AS value, share, cum_pct, class, rank FROM pareto""")
def q_pareto_abc_brand(spark, sf_dir):
    """Brands by revenue with 70/90 thresholds (few items, exercises class B/C edges)."""
    p = customer_pareto(spark, sf_dir, "p_brand", 70.0, 90.0)
    return p.select("p_brand", F.col("value").cast("double").alias("value"), "share", "cum_pct",
                    "class", "rank")


@register("abc_summary", _pareto_sql() + """,
per AS (SELECT class, COUNT(*) AS n, SUM(value) AS value FROM pareto GROUP BY class),
tot AS (SELECT COUNT(*) AS tn, SUM(value) AS tv FROM pareto),
classes AS (SELECT * FROM (VALUES ('A'), ('B'), ('C')) t(class))
SELECT c.class, CAST(COALESCE(per.n, 0) AS BIGINT) AS n,
       CAST(COALESCE(per.value, 0) AS DOUBLE) AS value,
       CAST(COALESCE(per.n, 0) AS DOUBLE) / tot.tn * 100.0 AS n_pct,
       CAST(COALESCE(per.value, 0) AS DOUBLE) / CAST(tot.tv AS DOUBLE) * 100.0 AS value_pct
FROM classes c LEFT JOIN per ON c.class = per.class CROSS JOIN tot""")
def q_abc_summary(spark, sf_dir):
    """Count and value per ABC class, padded to A, B, C."""
    s = abc_summary(customer_pareto(spark, sf_dir))
    return s.withColumn("value", F.col("value").cast("double"))


@register("abc_detail", _pareto_sql() + """
SELECT o_custkey, CAST(value AS DOUBLE) AS value, share, cum_pct, class, rank FROM pareto WHERE class = 'B'""")
def q_abc_detail(spark, sf_dir):
    """Members of class B."""
    d = abc_detail(customer_pareto(spark, sf_dir), "B")
    return d.select("o_custkey", F.col("value").cast("double").alias("value"), "share", "cum_pct",
                    "class", "rank")


@register("concentration", _pareto_sql() + """
, c AS (
  SELECT SUM(share * share) * 10000.0 AS hhi,
         SUM(CAST(n_items - rank + 1 AS DOUBLE) * CAST(value AS DOUBLE)) AS iv,
         SUM(CAST(value AS DOUBLE)) AS v, ANY_VALUE(n_items) AS n,
         SUM(cum_pct / 100.0) AS sy, ARG_MAX(cum_pct, rank) AS ylast, ARG_MIN(cum_pct, rank) AS yfirst
  FROM pareto)
SELECT ROUND(hhi, 6) AS hhi,
       CASE WHEN hhi >= 1800 THEN 'high' WHEN hhi >= 1000 THEN 'medium' ELSE 'low' END AS hhi_risk,
       ROUND(2.0 * iv / (n * v) - (n + 1.0) / n, 9) AS gini,
       ROUND(1.0 - 2.0 * ((sy - (yfirst + ylast) / 200.0) / n), 9) AS gini_ref
FROM c""")
def q_concentration(spark, sf_dir):
    """HHI, its risk band, standard Gini and the as-coded Gini."""
    c = concentration(customer_pareto(spark, sf_dir))
    return c.select(F.round("hhi", 6).alias("hhi"), "hhi_risk", F.round("gini", 9).alias("gini"),
                    F.round("gini_ref", 9).alias("gini_ref"))
