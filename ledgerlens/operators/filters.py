"""Drill-down filters, period labels, value lists, mappings and top-N
bucketing (§2.2). All are projections, ``where`` clauses or small
aggregations; a list of chosen values is a left-semi join, whatever its length
(the session's size threshold and AQE decide how it is carried out)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.clean import clean_time_of, normalize_text, normalize_values
from ledgerlens.plans.runtime import bounded_broadcast

FREQS = {"month": "month", "quarter": "quarter", "year": "year"}
NA_LABEL = "(NA)"


def period_start(t: Column, freq: str) -> Column:
    """Start of the month / quarter / year containing t."""
    return F.date_trunc(FREQS[freq], t)


def period_label(t: Column, freq: str) -> Column:
    """'2024-03' for months, '2024Q1' for quarters, '2024' for years."""
    if freq == "month":
        return F.date_format(t, "yyyy-MM")
    if freq == "quarter":
        return F.concat(F.year(t).cast("string"), F.lit("Q"), F.quarter(t).cast("string"))
    return F.year(t).cast("string")


def as_text(col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return c.cast("string")


def _member(df: DataFrame, expr: Column, values: Sequence, tag: str) -> DataFrame:
    import pandas as pd

    chosen = pd.DataFrame({tag: sorted({str(v) for v in values})})
    lookup = df.sparkSession.createDataFrame(chosen, f"{tag} string")
    return df.withColumn(tag, expr).join(lookup, tag, "left_semi").drop(tag)


def drilldown_filter(df: DataFrame, filters: dict[str, Sequence] | None = None, time: str | None = None,
                     freq: str = "month", periods: Sequence[str] | None = None) -> DataFrame:
    """AND of ``text(col) IN values`` per column (an empty list means no
    filter) and, with ``time``, period label IN ``periods``. Rows with a
    missing or out-of-range time are dropped only when periods are given."""
    out = df
    for i, (col, values) in enumerate((filters or {}).items()):
        if values:
            out = _member(out, as_text(col), values, f"_ll_f{i}")
    if time and periods:
        # labels are bounded by the calendar: a plain predicate, which reaches the scan below the fact's joins
        out = out.where(period_label(clean_time_of(df, time), freq).isin(sorted({str(p) for p in periods})))
    return out


def distinct_periods(df: DataFrame, time: str, freq: str = "month") -> DataFrame:
    """Sorted distinct period labels (valid times only)."""
    lab = period_label(clean_time_of(df, time), freq).alias("period")
    return df.select(lab).where(F.col("period").isNotNull()).distinct().orderBy("period")


def period_filter(df: DataFrame, time: str, freq: str = "month", periods: Sequence[str] | None = None,
                  last: int = 3) -> DataFrame:
    """Keep rows in the chosen periods; by default the last ``last`` periods
    present. The default list is at most ``last`` labels, taken from the
    distinct-period aggregate."""
    if periods is None:
        rows = distinct_periods(df, time, freq).orderBy(F.col("period").desc()).limit(last).collect()
        periods = [r["period"] for r in rows]
    return drilldown_filter(df, None, time, freq, periods)


def filter_options(df: DataFrame, col: str, k: int = 200) -> DataFrame:
    """The k most frequent values (as text; missing counted as 'nan'), most
    frequent first, value ascending on ties: (value, n)."""
    v = F.coalesce(as_text(col), F.lit("nan")).alias("value")
    return (df.groupBy(v).agg(F.count(F.lit(1)).alias("n"))
              .orderBy(F.col("n").desc(), F.col("value").asc()).limit(k))


def distinct_values(df: DataFrame, col: str, normalize: bool = False) -> DataFrame:
    """Sorted distinct non-null values as text (optionally normalised)."""
    v = (normalize_text(col) if normalize else as_text(col)).alias("value")
    return df.select(v).where(F.col("value").isNotNull()).distinct().orderBy("value")


def latest_year(df: DataFrame, time: str) -> int | None:
    """Latest valid year (one scalar from a global max)."""
    r = df.select(F.max(F.year(clean_time_of(df, time))).alias("y")).first()
    return None if r is None else r["y"]


def year_scope(df: DataFrame, time: str, year: int | str | None = None) -> DataFrame:
    """Rows of one year ('All' keeps everything); default is the latest year
    (no row when no date is valid)."""
    if year == "All":
        return df
    if year is None:
        year = latest_year(df, time)
        if year is None:
            return df.where(F.lit(False))
    return df.where(F.year(clean_time_of(df, time)) == int(year))


def map_values(df: DataFrame, col: str, measure: str, groups: dict[str, Sequence]) -> DataFrame:
    """One column per mapping group: the measure (null → 0) where the
    normalised ``col`` is in the group's normalised values, else 0."""
    key = normalize_text(col)
    m = F.coalesce(F.col(measure).cast("double"), F.lit(0.0))
    out = df
    for name, values in groups.items():
        vals = normalize_values(values)
        out = out.withColumn(name, F.when(key.isin(vals), m).otherwise(F.lit(0.0)) if vals else F.lit(0.0))
    return out


def revenue_for_charts(df: DataFrame, revenue: str, sales_b: str | None = None) -> Column:
    """Sales(B) amount when a mapping B sales list is set, else revenue with
    null → 0."""
    if sales_b:
        return F.col(sales_b)
    return F.coalesce(F.col(revenue).cast("double"), F.lit(0.0))


def bucket_other(df: DataFrame, col: str, n: int = 10, by: str | None = None, other: str = "Other",
                 out: str | None = None, keep_na: bool = False) -> DataFrame:
    """Replace all but the top-n values of ``col`` (by row count, or by the sum
    of ``by``) with ``other``. The kept list has n rows and is broadcast."""
    out = out or col
    txt = as_text(col)
    if keep_na:
        txt = F.coalesce(txt, F.lit(NA_LABEL))
    weight = F.count(F.lit(1)) if by is None else F.sum(F.col(by))
    top = (df.where(txt.isNotNull()).groupBy(txt.alias("_ll_v")).agg(weight.alias("_ll_w"))
             .orderBy(F.col("_ll_w").desc(), F.col("_ll_v").asc()).limit(n)
             .select("_ll_v", F.lit(True).alias("_ll_keep")))
    tagged = df.withColumn("_ll_v", txt).join(bounded_broadcast(top, n, "top-n values"), "_ll_v", "left")
    bucket = F.when(F.col("_ll_keep"), F.col("_ll_v")).when(F.col("_ll_v").isNotNull(), F.lit(other))
    cols = [bucket.alias(out) if c == out else F.col(c) for c in df.columns]
    if out not in df.columns:
        cols.append(bucket.alias(out))
    return tagged.select(*cols)
