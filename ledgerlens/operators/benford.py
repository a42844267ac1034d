"""Benford first- and second-digit tests (§2.9).

Leading digits are a native string expression reproducing the C ``%.15g``
text of |v| (digits only, leading zeros stripped; exponent digits kept in
scientific form), so no Python runs per row. Counting is a partial-
aggregated ``groupBy(digit)`` whose result has at most 9 or 90 rows; the
expected distribution is a 9/90-row frame built from the digit domain and
joined by broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.clean import numeric_of
from ledgerlens.functions.dist import chi2_p
from ledgerlens.plans.runtime import bounded_broadcast, shuffle_partitions

# Fixed values of the test: digit domains, the status threshold on the
# largest gap (as a ratio, Red at twice it), severity cut-offs on p and MAD,
# and the drill-down gap in percentage points.
DIGIT_RANGE = {1: (1, 9), 2: (10, 99)}
DIFF_THRESHOLD = 0.05
SEVERITY_P = (0.01, 0.05)
SEVERITY_MAD = (0.015, 0.012)
DRILL_MIN_PP = 5.0


def leading_digits(v: Column, digits: int = 1) -> Column:
    """First digit (1-9) or first two digits (10-99) of |v| as in the digit
    string of ``%.15g``; null when the value has fewer significant digits,
    is 0 or missing.

    Read straight from the ``%.14e`` text: the first digit is its first
    character; the second is the next mantissa digit unless digits 2-15 are
    all zero, in which case %.15g prints a single significant digit followed
    by exponent digits (scientific form, x < −4 or x ≥ 15), padding zeros
    (x ≥ 1) or nothing.
    """
    e = F.format_string("%.14e", F.abs(v))
    first = F.substring(e, 1, 1)
    valid = first != "0"
    if digits == 1:
        return F.when(valid, first.cast("int"))
    x = F.substring(e, 18, 5).cast("int")
    second = (F.when(F.substring(e, 3, 14) != "00000000000000", F.substring(e, 3, 1))
               .when((x < -4) | (x >= 15), F.substring(e, 19, 1))
               .when(x >= 1, F.lit("0")))
    return F.when(valid & second.isNotNull(), F.concat(first, second).cast("int"))


def _digit_counts(df: DataFrame, col: str, digits: int) -> DataFrame:
    """(digit, _c) over the digit domain."""
    lo, hi = DIGIT_RANGE[digits]
    d = leading_digits(numeric_of(df, col), digits)
    counts = df.select(d.alias("digit")).groupBy("digit").agg(F.count(F.lit(1)).alias("_c"))
    return counts.where(F.col("digit").between(lo, hi))


def benford(df: DataFrame, col: str, digits: int = 1) -> DataFrame:
    """Per digit: observed, expected (= n·log10(1+1/d)), observed_p,
    expected_p, diff, diff_pct (relative), diff_pp (percentage points)."""
    spark = df.sparkSession
    lo, hi = DIGIT_RANGE[digits]
    counts = _digit_counts(df, col, digits)
    domain = spark.range(lo, hi + 1).select(F.col("id").cast("int").alias("digit"))
    tot = counts.agg(F.sum("_c").alias("_n")).withColumn("_k", F.lit(0))
    j = (domain.join(bounded_broadcast(counts, hi - lo + 1, "digit counts"), "digit", "left")
               .withColumn("_k", F.lit(0)).join(bounded_broadcast(tot, 1, "n"), "_k"))
    n = F.col("_n").cast("double")
    obs = F.coalesce(F.col("_c"), F.lit(0)).cast("double")
    exp_p = F.log10(1.0 + 1.0 / F.col("digit").cast("double"))
    exp = exp_p * n
    return j.where(F.col("_n") > 0).select(
        "digit", obs.alias("observed"), exp.alias("expected"), (obs / n).alias("observed_p"),
        exp_p.alias("expected_p"), (obs - exp).alias("diff"), ((obs - exp) / exp).alias("diff_pct"),
        ((obs / n - exp_p) * 100.0).alias("diff_pp"))


def benford_summary(df: DataFrame, col: str, digits: int = 1, threshold: float = DIFF_THRESHOLD) -> DataFrame:
    """One row: n, chi2, dof, p_value, mad, max_diff_pp, diff_status (Green /
    Yellow / Red on the largest |gap| vs threshold and twice it), severity
    (Red: p < .01 or MAD > .015; Yellow: p < .05 or MAD > .012)."""
    b = benford(df, col, digits)
    lo, hi = DIGIT_RANGE[digits]
    dof = hi - lo
    s = b.agg(F.sum("observed").cast("long").alias("n"),
              F.sum((F.col("observed") - F.col("expected")) ** 2 / F.col("expected")).alias("chi2"),
              F.avg(F.abs(F.col("observed_p") - F.col("expected_p"))).alias("mad"),
              F.max(F.abs(F.col("diff_pp"))).alias("max_diff_pp"))
    s = s.withColumn("dof", F.lit(dof)).withColumn("p_value", chi2_p(F.col("chi2"), F.col("dof")))
    ratio = F.col("max_diff_pp") / 100.0
    status = F.when(ratio >= 2 * threshold, "Red").when(ratio >= threshold, "Yellow").otherwise("Green")
    p, mad = F.col("p_value"), F.col("mad")
    sev = (F.when((p < SEVERITY_P[0]) | (mad > SEVERITY_MAD[0]), "Red")
            .when((p < SEVERITY_P[1]) | (mad > SEVERITY_MAD[1]), "Yellow").otherwise("Green"))
    return s.select("n", "chi2", "dof", "p_value", "mad", "max_diff_pp", status.alias("diff_status"),
                    sev.alias("severity"))


def benford_ready(df: DataFrame, col: str, min_n: int = 1, max_unique: float = 0.95) -> DataFrame:
    """Gate: enough non-zero values and not ID-like (distinct/non-null share
    at most ``max_unique``). (n_nonzero, unique_ratio, ready, reason)."""
    v = numeric_of(df, col)
    s = df.select(v.alias("v")).agg(
        F.sum(((F.col("v") != 0) & F.col("v").isNotNull()).cast("long")).alias("n_nonzero"),
        F.count("v").alias("_nn"), F.count_distinct("v").alias("_nd"))
    ratio = F.when(F.col("_nn") > 0, F.col("_nd") / F.col("_nn"))
    few = F.coalesce(F.col("n_nonzero"), F.lit(0)) < min_n
    idlike = F.coalesce(ratio > max_unique, F.lit(False))
    reason = F.when(few, "too_few_nonzero").when(idlike, "id_like").otherwise("")
    return s.select(F.coalesce(F.col("n_nonzero"), F.lit(0).cast("long")).alias("n_nonzero"),
                    ratio.alias("unique_ratio"), (~few & ~idlike).alias("ready"), reason.alias("reason"))


def benford_quality(df: DataFrame, col: str) -> DataFrame:
    """Counts of total, NaN (not numeric), 'none'/'null' text, zero, positive,
    negative and used (non-zero numeric) values; % of total and % of the
    non-missing non-zero base, rounded to 2 places."""
    raw = F.col(col)
    v = numeric_of(df, col)
    s = df.select(v.alias("v"), F.lower(F.trim(raw.cast("string"))).isin("none", "null").alias("_nl")).agg(
        F.count(F.lit(1)).alias("total"), F.sum(F.col("v").isNull().cast("long")).alias("nan"),
        F.sum(F.col("_nl").cast("long")).alias("none_null"), F.sum((F.col("v") == 0).cast("long")).alias("zero"),
        F.sum((F.col("v") > 0).cast("long")).alias("positive"), F.sum((F.col("v") < 0).cast("long")).alias("negative"))
    s = s.withColumn("used", F.col("positive") + F.col("negative"))
    kinds = ["total", "nan", "none_null", "zero", "positive", "negative", "used"]
    long = s.select("total", "nan", "zero", F.inline(F.array(*[
        F.struct(F.lit(k).alias("type"), F.coalesce(F.col(k), F.lit(0)).cast("long").alias("n")) for k in kinds])))
    base = F.greatest(F.col("total") - F.col("nan") - F.coalesce(F.col("zero"), F.lit(0)), F.lit(0))
    return long.select("type", "n",
                       F.when(F.col("total") > 0, F.round(F.col("n") / F.col("total") * 100.0, 2)).otherwise(0.0)
                       .alias("pct_total"),
                       F.when(base > 0, F.round(F.col("n") / base * 100.0, 2)).otherwise(0.0).alias("pct_clean"))


def benford_drilldown(df: DataFrame, col: str, digits: int = 1, min_pp: float = DRILL_MIN_PP,
                      cap: int | None = None, order: list[str] | None = None) -> DataFrame:
    """Source rows whose leading digit deviates by at least ``min_pp``
    percentage points, tagged with the digit. ``cap`` keeps the first rows
    per digit in ``order`` (a display limit; ties by the row's hash); by default
    every row is kept. The first rows are chosen in two levels, in hashed parts
    of a digit and then among those, so a digit is not one task."""
    flagged = benford(df, col, digits).where(F.abs(F.col("diff_pp")) >= min_pp).select("digit")
    lo, hi = DIGIT_RANGE[digits]
    tagged = df.withColumn("digit", leading_digits(numeric_of(df, col), digits))
    out = tagged.join(bounded_broadcast(flagged, hi - lo + 1, "flagged digits"), "digit", "left_semi")
    if cap is not None:
        whole = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
        out = out.withColumn("_h", whole).withColumn("_part", F.pmod("_h", F.lit(shuffle_partitions(df.sparkSession))))
        for level in (["digit", "_part"], ["digit"]):
            first = Window.partitionBy(*level).orderBy(*(order or df.columns), "_h")
            out = out.withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") <= cap).drop("_rn")
        out = out.drop("_h", "_part")
    return out.select(*[c for c in df.columns if c != "digit"], "digit")
