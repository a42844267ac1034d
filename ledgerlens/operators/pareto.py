"""Pareto / ABC concentration: class by cumulative share, class summary,
HHI and Gini.

Plan: one partial-aggregated ``groupBy(dim)`` (map-side combine, so a hot
dimension value costs one row per map task), then the distributed running sum
of ``ordered_prefix`` in (value desc, dim asc) order. Totals are one-row
aggregates, broadcast by construction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.clean import fold_invalid
from ledgerlens.operators.ranks import ordered_prefix
from ledgerlens.plans.runtime import bounded_broadcast


def _measure(df: DataFrame, measure: str) -> Column:
    dt = df.schema[measure].dataType
    if isinstance(dt, (T.DecimalType, T.IntegralType)):
        return F.col(measure)          # exact sums stay exact
    return fold_invalid(measure)


def dim_totals(df: DataFrame, dim: str, measure: str) -> DataFrame:
    """Sum of the measure per non-null dimension value (dim, value)."""
    return (df.where(F.col(dim).isNotNull())
              .groupBy(dim).agg(F.sum(_measure(df, measure)).alias("value")))


def _with_total(df: DataFrame, value: str = "value") -> DataFrame:
    tot = df.agg(F.sum(value).alias("_total"), F.count(F.lit(1)).alias("_n")).withColumn("_k", F.lit(0))
    return df.withColumn("_k", F.lit(0)).join(bounded_broadcast(tot, 1, "grand total"), "_k").drop("_k")


def cumulative_share(df: DataFrame, dim: str, measure: str, positive_only: bool = True) -> DataFrame:
    """(dim, value, rank, cum_value, share, cum_pct) in descending value order,
    dim ascending on ties."""
    agg = dim_totals(df, dim, measure)
    if positive_only:
        agg = agg.where(F.col("value") > 0)
    pre = ordered_prefix(agg, [("value", False), (dim, True)],
                         {"cum_value": F.col("value"), "rank": F.lit(1).cast("long")})
    pre = _with_total(pre)
    total = F.col("_total").cast("double")
    return pre.select(
        dim, "value", "rank", "cum_value",
        (F.col("value").cast("double") / total).alias("share"),
        (F.col("cum_value").cast("double") / total * 100.0).alias("cum_pct"),
        "_n")


def pareto_abc(df: DataFrame, dim: str, measure: str, a: float = 80.0, b: float = 95.0) -> DataFrame:
    """Per dimension value with positive total: value, share, cum_pct, class
    (A if cum_pct <= a, B if <= b, else C; the top item is always A), rank."""
    cs = cumulative_share(df, dim, measure)
    cls = (F.when(F.col("rank") == 1, "A")
            .when(F.col("cum_pct") <= a, "A")
            .when(F.col("cum_pct") <= b, "B")
            .otherwise("C"))
    return cs.select(dim, "value", "share", "cum_pct", cls.alias("class"), "rank", "_n")


def abc_detail(pareto: DataFrame, cls: str) -> DataFrame:
    return pareto.where(F.col("class") == cls).drop("_n")


def abc_summary(pareto: DataFrame) -> DataFrame:
    """class A/B/C (absent class padded with 0): n, value, n_pct, value_pct."""
    spark = pareto.sparkSession
    per = pareto.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    tot = pareto.agg(F.count(F.lit(1)).alias("_n"), F.sum("value").alias("_v"))
    classes = spark.createDataFrame([("A",), ("B",), ("C",)], "class string").withColumn("_k", F.lit(0))
    joined = (classes
              .join(bounded_broadcast(per, 3, "class rows").withColumn("_k", F.lit(0)), ["class", "_k"], "left")
              .join(bounded_broadcast(tot.withColumn("_k", F.lit(0)), 1, "totals"), "_k"))
    zero = F.lit(0).cast(pareto.schema["value"].dataType)
    return joined.select(
        "class",
        F.coalesce(F.col("n"), F.lit(0).cast("long")).alias("n"),
        F.coalesce(F.col("value"), zero).alias("value"),
        (F.coalesce(F.col("n"), F.lit(0)).cast("double") / F.col("_n") * 100.0).alias("n_pct"),
        (F.coalesce(F.col("value"), zero).cast("double") / F.col("_v").cast("double") * 100.0).alias("value_pct"),
    )


def concentration(pareto: DataFrame) -> DataFrame:
    """One row: hhi (Σ share² x 10000), hhi_risk, gini (standard, ascending
    order), gini_ref (1 − 2·trapezoid of the descending cumulative share curve
    starting at 1/n, which is negative for concentrated data)."""
    n = F.col("_n").cast("double")
    asc_index = (F.col("_n") - F.col("rank") + 1).cast("double")
    agg = pareto.agg(
        F.sum(F.col("share") * F.col("share")).alias("_s2"),
        F.sum(asc_index * F.col("value").cast("double")).alias("_iv"),
        F.sum(F.col("value").cast("double")).alias("_v"),
        F.first("_n").alias("_n"),
        F.sum(F.col("cum_pct") / 100.0).alias("_sy"),
        F.max_by(F.col("cum_pct"), F.col("rank")).alias("_ylast"),
        F.min_by(F.col("cum_pct"), F.col("rank")).alias("_yfirst"),
    )
    hhi = F.col("_s2") * 10000.0
    trapz = (F.col("_sy") - (F.col("_yfirst") + F.col("_ylast")) / 200.0) / n
    return agg.select(
        hhi.alias("hhi"),
        F.when(hhi >= 1800, "high").when(hhi >= 1000, "medium").otherwise("low").alias("hhi_risk"),
        (2.0 * F.col("_iv") / (n * F.col("_v")) - (n + 1.0) / n).alias("gini"),
        (1.0 - 2.0 * trapz).alias("gini_ref"),
    )
