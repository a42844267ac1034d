"""Distribution profiles (§2.4 numeric_profile / category_freq, §2.7).

Moments come from one partial-aggregated pass (Spark's ``skewness`` and
``kurtosis`` are the population, i.e. biased, forms). Quantiles come from
the distributed exact quantile, the mode from two-level counting, outliers
from a second pass against broadcast one-row fences. The D'Agostino-Pearson
normality test is a closed form of (n, g1, g2) and is evaluated as a native
expression on the one-row result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.clean import numeric_of, value_filter
from ledgerlens.operators.ranks import group_modes, grouped_quantiles
from ledgerlens.plans.runtime import bounded_broadcast

PROFILE_PROBS = [0.01, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99]
PROFILE_NAMES = ["p01", "p05", "p10", "p25", "p50", "p75", "p90", "p95", "p99"]


def _one(df: DataFrame) -> DataFrame:
    return df.withColumn("_k", F.lit(0))


def _join1(left: DataFrame, right: DataFrame, what: str) -> DataFrame:
    """Join a one-row frame to every row of ``left``."""
    return _one(left).join(bounded_broadcast(_one(right), 1, what), "_k").drop("_k")


# ------------------------------------------------------------ normality
def skewtest_z(n: Column, g1: Column) -> Column:
    """D'Agostino skewness z from n and the biased skewness g1 (n >= 8).
    At exactly zero skewness the statistic uses y = 1, as SciPy does."""
    n = n.cast("double")
    y = g1 * F.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    beta2 = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2.0 * (beta2 - 1)) - 1
    delta = 1.0 / F.sqrt(0.5 * F.log(w2))
    alpha = F.sqrt(2.0 / (w2 - 1))
    y = F.when(y == 0, F.lit(1.0)).otherwise(y)
    return delta * F.asinh(y / alpha)


def kurtosistest_z(n: Column, g2: Column) -> Column:
    """Anscombe-Glynn kurtosis z from n and the biased excess kurtosis g2."""
    n = n.cast("double")
    b2 = g2 + 3.0
    e = 3.0 * (n - 1) / (n + 1)
    var = 24.0 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (b2 - e) / F.sqrt(var)
    sb1 = 6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6.0 + 8.0 / sb1 * (2.0 / sb1 + F.sqrt(1 + 4.0 / (sb1 * sb1)))
    term1 = 1 - 2.0 / (9.0 * a)
    denom = 1 + x * F.sqrt(2.0 / (a - 4.0))
    term2 = F.signum(denom) * F.when(denom != 0, F.cbrt((1 - 2.0 / a) / F.abs(denom)))
    return (term1 - term2) / F.sqrt(2.0 / (9.0 * a))


def normality_p(n: Column, g1: Column, g2: Column, min_n: int = 8) -> Column:
    """D'Agostino-Pearson K² p-value exp(-K²/2) (χ² with 2 dof); null when
    n < min_n or the variance is 0 (g1, g2 undefined)."""
    k2 = F.pow(skewtest_z(n, g1), 2) + F.pow(kurtosistest_z(n, g2), 2)
    ok = (n >= min_n) & g1.isNotNull() & g2.isNotNull() & ~F.isnan(g1) & ~F.isnan(g2)
    return F.when(ok, F.exp(-k2 / 2.0))


def adjusted_skew(n: Column, g1: Column) -> Column:
    """Bias-corrected G1 = g1·√(n(n−1))/(n−2)."""
    n = n.cast("double")
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def adjusted_kurt(n: Column, g2: Column) -> Column:
    """Bias-corrected excess kurtosis G2 = (n−1)/((n−2)(n−3))·((n+1)g2+6)."""
    n = n.cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))


# ------------------------------------------------------------ long form
def long_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, v) for every row and column, numeric view, invalid → null."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), numeric_of(df, c).alias("v")) for c in cols])
    return df.select(F.inline(pairs))


def numeric_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per numeric column: n, mean, std, min, p01..p99, max, skew, kurt
    (biased), p_normal (n > 7), zero_ratio. All columns share one moments
    pass and one distributed quantile pass."""
    lv = long_values(df, cols).where(F.col("v").isNotNull())
    mom = lv.groupBy("column").agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
        F.min("v").alias("min"), F.max("v").alias("max"),
        F.skewness("v").alias("_g1"), F.kurtosis("v").alias("_g2"),
        F.avg((F.col("v") == 0).cast("double")).alias("zero_ratio"))
    qs = grouped_quantiles(lv, "v", PROFILE_PROBS, by=["column"], names=PROFILE_NAMES)
    j = mom.join(qs, "column")
    n = F.col("n")
    return j.select(
        "column", "n", "mean", "std", "min", *PROFILE_NAMES, "max",
        F.when(n > 2, F.col("_g1")).alias("skew"), F.when(n > 3, F.col("_g2")).alias("kurt"),
        F.when(n > 7, normality_p(n, F.col("_g1"), F.col("_g2"))).alias("p_normal"),
        "zero_ratio")


def category_freq(df: DataFrame, col: str) -> DataFrame:
    """Non-null values as text with count and share of the non-null rows."""
    from pyspark.sql import Window
    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("string").alias("category")) \
        .agg(F.count(F.lit(1)).alias("count"))
    tot = counts.agg(F.sum("count").alias("_t"))
    return _join1(counts, tot, "total").select("category", "count", (F.col("count") / F.col("_t")).alias("share"))


# ------------------------------------------------------------ Tab 2 profile
def _clean(df: DataFrame, col: str, drop_neg: bool, drop_zero: bool, log10: bool) -> Column:
    v = numeric_of(df, col)
    ok = value_filter(v, drop_neg, drop_zero)
    if log10:
        ok = ok & (v > 0)
        v = F.log10(v)
    return F.when(ok, v)


def _raw_missing(df: DataFrame, col: str) -> Column:
    c = F.col(col)
    if isinstance(df.schema[col].dataType, (T.FloatType, T.DoubleType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def distribution_profile(df: DataFrame, col: str, drop_neg: bool = False, drop_zero: bool = False,
                         log10: bool = False, fence_k: float = 1.5) -> DataFrame:
    """One row of 23 metrics. ``missing`` and ``zero`` count the raw column;
    the rest use the cleaned values (filters, optional log10)."""
    staged = df.select(_raw_missing(df, col).alias("_miss"), (numeric_of(df, col) == 0).alias("_zero"),
                       _clean(df, col, drop_neg, drop_zero, log10).alias("v"))
    mom = staged.agg(
        F.count("v").alias("count"), F.sum(F.col("_miss").cast("long")).alias("missing"),
        F.sum(F.coalesce(F.col("_zero"), F.lit(False)).cast("long")).alias("zero"),
        F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"),
        F.stddev_samp("v").alias("std"), F.skewness("v").alias("_g1"), F.kurtosis("v").alias("_g2"))
    vals = staged.where(F.col("v").isNotNull()).select("v")
    qs = grouped_quantiles(vals, "v", [0.05, 0.25, 0.5, 0.75, 0.95], names=["p5", "q1", "median", "q3", "p95"])
    mode = group_modes(vals, "v")
    stats = _join1(_join1(mom, qs, "quantiles"), mode, "mode")
    iqr = F.col("q3") - F.col("q1")
    stats = stats.withColumn("lower_fence", F.col("q1") - fence_k * iqr) \
                 .withColumn("upper_fence", F.col("q3") + fence_k * iqr)
    fences = stats.select("lower_fence", "upper_fence")
    outs = _join1(vals, fences, "fences").agg(
        F.sum(((F.col("v") < F.col("lower_fence")) | (F.col("v") > F.col("upper_fence"))).cast("long"))
        .alias("outliers"))
    j = _join1(stats, outs, "outliers")
    n = F.col("count")
    mean, std = F.col("mean"), F.col("std")
    cv = F.when((mean != 0) & std.isNotNull(), std / mean * 100.0)
    return j.select(
        "count", "missing", "zero", "min", "p5", "q1", "median", "mean", "mode", "q3", "p95", "max",
        F.when(n > 1, std).alias("std"), iqr.alias("iqr"), cv.alias("cv_pct"),
        F.when(n > 2, F.col("_g1")).alias("skew"), F.when(n > 3, F.col("_g2")).alias("kurt"),
        (F.col("max") - F.col("min")).alias("range"), "lower_fence", "upper_fence",
        F.coalesce(F.col("outliers"), F.lit(0).cast("long")).alias("outliers"),
        F.when(n > 0, F.coalesce(F.col("outliers"), F.lit(0)) / n * 100.0).otherwise(0.0).alias("outlier_pct"),
        F.when(n > 7, normality_p(n, F.col("_g1"), F.col("_g2"))).alias("p_normal"),
        adjusted_skew(n, F.col("_g1")).alias("skew_adj"), adjusted_kurt(n, F.col("_g2")).alias("kurt_adj"))


def profile_verdicts(profile: DataFrame) -> DataFrame:
    """Coded labels for a ``distribution_profile`` row: shape (adjusted
    skew ±0.5, adjusted kurtosis ±1), normality, centre (5 % band), spread
    (CV 20/50) and the audit action (outliers > 5 %, CV > 100, skew > 1)."""
    g1, g2 = F.col("skew_adj"), F.col("kurt_adj")
    mean, med = F.col("mean"), F.col("median")
    cv = F.coalesce(F.col("cv_pct"), F.lit(0.0))
    return profile.select(
        F.when(g1 > 0.5, "right_skewed").when(g1 < -0.5, "left_skewed").otherwise("symmetric").alias("shape"),
        F.when(g2 > 1, "leptokurtic").when(g2 < -1, "platykurtic").otherwise("mesokurtic").alias("tails"),
        F.when(F.col("p_normal") < 0.05, "not_normal").otherwise("normal_not_rejected").alias("normality"),
        F.when(F.abs(mean - med) / (F.abs(mean) + 1) < 0.05, "mean_near_median")
         .when(mean > med, "mean_above_median").otherwise("mean_below_median").alias("centre"),
        F.when(cv > 50, "very_high").when(cv > 20, "medium").otherwise("low").alias("spread"),
        F.when((F.col("outliers") > 0) & (F.col("outlier_pct") > 5), "sample_outliers")
         .when(cv > 100, "stratify").when(g1 > 1, "use_median").otherwise("analytical_review").alias("action"))


def tukey_outliers(df: DataFrame, col: str, k: float = 1.5) -> DataFrame:
    """Input rows whose value lies outside [Q1 − k·IQR, Q3 + k·IQR], with the
    fences attached."""
    v = numeric_of(df, col)
    qs = grouped_quantiles(df.select(v.alias("v")).where(F.col("v").isNotNull()), "v", [0.25, 0.75],
                           names=["q1", "q3"])
    iqr = F.col("q3") - F.col("q1")
    fences = qs.select((F.col("q1") - k * iqr).alias("fence_lo"), (F.col("q3") + k * iqr).alias("fence_hi"))
    j = _join1(df, fences, "fences")
    vv = numeric_of(df, col)
    return j.where((vv < F.col("fence_lo")) | (vv > F.col("fence_hi")))


def histogram(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """Equal-width bins between min and max, the last one closed (edges as
    an evenly spaced grid; a constant column gets the range ±0.5). Every bin
    is present: (bin, lo, hi, n, expected_normal) where expected_normal is
    n·width·pdf(centre) under N(mean, sd)."""
    spark = df.sparkSession
    vals = df.select(numeric_of(df, col).alias("v")).where(F.col("v").isNotNull())
    st = vals.agg(F.min("v").alias("_a"), F.max("v").alias("_b"), F.count("v").alias("_n"),
                  F.avg("v").alias("_mu"), F.stddev_samp("v").alias("_sd"))
    st = st.select(F.when(F.col("_a") == F.col("_b"), F.col("_a") - 0.5).otherwise(F.col("_a")).alias("_lo"),
                   F.when(F.col("_a") == F.col("_b"), F.col("_b") + 0.5).otherwise(F.col("_b")).alias("_hi"),
                   "_n", "_mu", "_sd")
    step = (F.col("_hi") - F.col("_lo")) / bins

    def edge(i: Column) -> Column:
        return F.when(i >= bins, F.col("_hi")).otherwise(F.col("_lo") + i.cast("double") * step)

    j = _join1(vals, st, "range")
    i0 = F.floor((F.col("v") - F.col("_lo")) * (F.lit(float(bins)) / (F.col("_hi") - F.col("_lo")))).cast("int")
    i0 = F.least(i0, F.lit(bins - 1))
    j = j.withColumn("_i", i0)
    j = j.withColumn("_i", F.when(F.col("v") < edge(F.col("_i")), F.col("_i") - 1).otherwise(F.col("_i")))
    j = j.withColumn("_i", F.when((F.col("v") >= edge(F.col("_i") + 1)) & (F.col("_i") != bins - 1),
                                  F.col("_i") + 1).otherwise(F.col("_i")))
    counts = j.groupBy(F.col("_i").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = _join1(spark.range(bins).select(F.col("id").cast("int").alias("bin")), st, "range")
    out = grid.join(counts, "bin", "left")
    lo, hi = edge(F.col("bin")), edge(F.col("bin") + 1)
    centre = (lo + hi) / 2
    z = (centre - F.col("_mu")) / F.col("_sd")
    pdf = F.exp(-0.5 * z * z) / (F.col("_sd") * math.sqrt(2 * math.pi))
    return out.select("bin", lo.alias("lo"), hi.alias("hi"),
                      F.coalesce(F.col("n"), F.lit(0).cast("long")).alias("n"),
                      F.when(F.col("_sd") > 0, F.col("_n") * step * pdf).alias("expected_normal"))
