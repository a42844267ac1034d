"""Derived fact tables built from the driver tables by joins.

These give the audit operators the flat table they expect (time, customer,
product, region, channel, revenue, weight, mapping and group columns). Only
the columns each consumer needs are selected, so the parquet scans are pruned.
Dimension tables with a fixed size (nation 25, region 5 rows) are broadcast;
customer and part are left to AQE, which broadcasts them only when their
runtime size is under the threshold and otherwise sort-merge joins them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.plans.runtime import bounded_broadcast
from ledgerlens.sources.tables import load

SALES_FACT_COLUMNS = [
    "l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", "o_custkey", "l_partkey", "p_brand",
    "r_name", "o_orderpriority", "l_extendedprice", "l_quantity", "l_discount", "l_linestatus",
    "l_returnflag", "c_mktsegment",
]


def sales_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem ⋈ orders ⋈ customer ⋈ nation ⋈ region ⋈ part, one row per line."""
    li = load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_shipdate", "l_extendedprice",
        "l_quantity", "l_discount", "l_linestatus", "l_returnflag")
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    cust = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = load(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = load(spark, sf_dir, "region").select("r_regionkey", "r_name")
    part = load(spark, sf_dir, "part").select("p_partkey", "p_brand")

    geo = nation.join(bounded_broadcast(region, 5, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    geo = geo.select("n_nationkey", "r_name")
    cust = cust.join(bounded_broadcast(geo, 25, "nation x region"),
                     F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_mktsegment", "r_name")
    # orders meet customers before the lines, which are several times as many: lines move for orders and parts only
    sold = orders.join(cust, F.col("o_custkey") == F.col("c_custkey"))
    fact = (li.join(sold, F.col("l_orderkey") == F.col("o_orderkey"))
              .join(part, F.col("l_partkey") == F.col("p_partkey")))
    return fact.select(*SALES_FACT_COLUMNS)


def sales_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rows per line: ('Sales', price) and ('Discount', -price*discount)."""
    fact = sales_fact(spark, sf_dir)
    return fact.select(
        *SALES_FACT_COLUMNS,
        F.expr("stack(2, 'Sales', l_extendedprice, 'Discount', -l_extendedprice * l_discount) "
               "as (value_type, amount)"))


def repeated_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subject (user_id) x condition (event_type) measurements."""
    return load(spark, sf_dir, "events").select("user_id", "event_type", "value")


def binary_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order: is_large (total price above the exact median), line count,
    quantity sum and mean discount. The median comes from the distributed
    exact quantile, the line sums from one partial-aggregated groupBy."""
    from ledgerlens.operators.ranks import grouped_quantiles

    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    lines = (load(spark, sf_dir, "lineitem")
             .groupBy("l_orderkey")
             .agg(F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("sum_qty"),
                  F.avg("l_discount").alias("avg_discount")))
    med = grouped_quantiles(orders, "o_totalprice", [0.5], names=["median"]).withColumn("_k", F.lit(0))
    o = orders.withColumn("_k", F.lit(0)).join(bounded_broadcast(med, 1, "median"), "_k")
    o = o.select("o_orderkey", (F.col("o_totalprice") > F.col("median")).cast("int").alias("is_large"))
    return o.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(
        "o_orderkey", "is_large", "n_lines", "sum_qty", "avg_discount")


def doc_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    labels = load(spark, sf_dir, "labels").select("doc_id", "quality")
    return docs.join(labels, "doc_id").select("doc_id", "n_chars", "quality", "lang")
