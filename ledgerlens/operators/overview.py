"""Sales overview (§2.4, §2.5): period series and growth, KPIs, discount
tables, revenue vs weight, average price, top contributors, region x
channel, custom pivot.

Every measure is reduced by one partial-aggregated ``groupBy``; windows only
run over already-aggregated series (one row per period, or the top-N rows),
whose length is bounded by the calendar or by N, never by the row count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.clean import clean_time_of, numeric_of
from ledgerlens.operators.filters import NA_LABEL, as_text, period_start
from ledgerlens.operators.ranks import grouped_quantiles
from ledgerlens.plans.runtime import bounded_broadcast, reliable_checkpoint

YOY_ROWS = {"month": 12, "quarter": 4, "year": 1}


def _m(df: DataFrame, col: str | Column) -> Column:
    """Measure with null → 0 (decimal kept exact, others as double)."""
    if isinstance(col, Column):
        return col
    dt = df.schema[col].dataType.simpleString()
    if dt.startswith("decimal"):
        return F.coalesce(F.col(col), F.lit(0).cast(dt))
    return F.coalesce(numeric_of(df, col), F.lit(0.0))


def period_agg(df: DataFrame, time: str, measures: dict[str, str | Column], freq: str = "month") -> DataFrame:
    """Sum of each measure per period start; invalid times dropped.
    (period, measure...)"""
    t = clean_time_of(df, time)
    return (df.where(t.isNotNull())
              .groupBy(period_start(t, freq).alias("period"))
              .agg(*[F.sum(_m(df, c)).alias(name) for name, c in measures.items()]))


def period_growth(df: DataFrame, time: str, measure: str | Column, freq: str = "month",
                  compare: str = "prev", calendar: bool = False) -> DataFrame:
    """(period, value, base, pct_change): %Δ against the previous period row
    ('prev') or the same period a year before ('yoy'). With ``calendar`` the
    base is the period exactly 1 (or 12/4/1) calendar steps back (absent →
    null); otherwise the offset counts rows present. pct_change is null when
    the base is missing or 0. The ordered window spans the period series
    only (bounded by the calendar)."""
    series = period_agg(df, time, {"value": measure}, freq)
    if calendar:
        series = reliable_checkpoint(series)        # joined to itself; the rows are read once
        step = 1 if compare == "prev" else YOY_ROWS[freq]
        months = {"month": 1, "quarter": 3, "year": 12}[freq] * step
        prev = series.select(F.add_months(F.col("period"), months).cast(series.schema["period"].dataType)
                             .alias("period"), F.col("value").alias("base"))
        out = series.join(prev, "period", "left")
    else:
        k = 1 if compare == "prev" else YOY_ROWS[freq]
        out = series.withColumn("base", F.lag("value", k).over(Window.orderBy("period")))
    v, b = F.col("value").cast("double"), F.col("base").cast("double")
    return out.select("period", "value", "base",
                      F.when(b != 0, (v / b - 1.0) * 100.0).alias("pct_change"))


def overview_kpis(df: DataFrame, revenue: str | Column, weight: str | None = None,
                  product: str | None = None, sales_a: str | None = None,
                  transfer_a: str | None = None) -> DataFrame:
    """One row: revenue total, row count, distinct products with revenue > 0,
    and the shares of |Sales(A)| and |Transfer(A)| weight in their sum
    (null when that sum is 0). ``sales_a``/``transfer_a`` are the mapped
    weight columns from ``map_values``."""
    rev = _m(df, revenue)
    aggs = [F.sum(rev).alias("revenue"), F.count(F.lit(1)).alias("n_rows")]
    aggs.append(F.count_distinct(F.when(rev > 0, F.col(product))).alias("n_products") if product
                else F.lit(None).cast("long").alias("n_products"))
    sa = F.sum(F.abs(F.col(sales_a))) if sales_a else F.lit(0.0)
    ta = F.sum(F.abs(F.col(transfer_a))) if transfer_a else F.lit(0.0)
    aggs += [sa.cast("double").alias("_sa"), ta.cast("double").alias("_ta")]
    base = F.col("_sa") + F.col("_ta")
    return df.agg(*aggs).select(
        "revenue", "n_rows", "n_products",
        F.when(base > 0, F.col("_sa") / base * 100.0).alias("pct_sales_a"),
        F.when(base > 0, F.col("_ta") / base * 100.0).alias("pct_transfer_a"))


def monthly_discount_all(df: DataFrame, time: str, sales: str, discount: str) -> DataFrame:
    """Months with Sales(B) > 0: (month, sales, discount, discount_pct),
    checkpointed: the year is chosen from it, the rows are read once."""
    mon = period_agg(df, time, {"sales": sales, "discount": discount}, "month").withColumnRenamed("period", "month")
    return reliable_checkpoint(mon.where(F.col("sales") > 0).withColumn(
        "discount_pct", -F.col("discount").cast("double") / F.col("sales").cast("double") * 100.0))


def _chosen_year(monthly: DataFrame, year: int | None) -> DataFrame:
    """One row (_year): ``year`` if some month of it has sales, else the latest."""
    y = F.year("month")
    present = F.max(F.when(y == F.lit(year), y)) if year is not None else F.lit(None).cast("int")
    return monthly.agg(F.coalesce(present, F.max(y)).alias("_year"))


def discount_kpis(df: DataFrame, time: str, sales: str, discount: str, year: int | None = None) -> DataFrame:
    """One row: year, mean of the monthly Discount%, and the year's
    −ΣDiscount/ΣSales·100, over months with Sales(B) > 0."""
    mon = monthly_discount_all(df, time, sales, discount)
    chosen = bounded_broadcast(_chosen_year(mon, year), 1, "chosen year")
    scoped = mon.join(chosen, F.year("month") == F.col("_year"))
    return scoped.groupBy("_year").agg(
        F.avg("discount_pct").alias("avg_monthly_pct"),
        (-F.sum("discount").cast("double") / F.sum("sales").cast("double") * 100.0).alias("year_pct"),
    ).withColumnRenamed("_year", "year")


def monthly_discount(df: DataFrame, time: str, sales: str, discount: str, year: int | None = None) -> DataFrame:
    """Monthly Sales(B), Discount(B) and Discount% for one year (default: the
    given year if present, else the latest)."""
    mon = monthly_discount_all(df, time, sales, discount)
    chosen = bounded_broadcast(_chosen_year(mon, year), 1, "chosen year")
    return mon.join(chosen, F.year("month") == F.col("_year")).drop("_year")


def discount_by_group(df: DataFrame, group: str, sales: str, discount: str, k: int | None = 15) -> DataFrame:
    """Per group with Sales(B) > 0: discount_rate = −ΣDisc/ΣSales·100,
    total_discount, total_revenue; highest rate first, top k."""
    g = F.coalesce(as_text(group), F.lit(NA_LABEL)).alias("grp")
    out = (df.groupBy(g).agg(F.sum(_m(df, sales)).alias("total_revenue"),
                             F.sum(_m(df, discount)).alias("total_discount"))
             .where(F.col("total_revenue") > 0)
             .withColumn("discount_rate", -F.col("total_discount").cast("double")
                         / F.col("total_revenue").cast("double") * 100.0)
             .select("grp", "discount_rate", "total_discount", "total_revenue"))
    if k:
        out = out.orderBy(F.col("discount_rate").desc(), F.col("grp").asc()).limit(k)
    return out


def revenue_vs_weight(df: DataFrame, time: str, revenue: str | Column, weight: str,
                      freq: str = "month") -> DataFrame:
    """Per period: revenue sum and weight sum with weight <= 0 counted as 0.
    Both measures come from one groupBy, so the two series are aligned on
    the same periods by construction."""
    w = numeric_of(df, weight)
    return period_agg(df, time, {"revenue": revenue,
                                 "weight": F.coalesce(F.greatest(w, F.lit(0.0)), F.lit(0.0))}, freq)


def avg_price(df: DataFrame, time: str, revenue: str | Column, weight: str) -> DataFrame:
    """Per month: revenue and Σrevenue/Σweight over rows with weight > 0
    (null when no such weight)."""
    w = numeric_of(df, weight)
    rev = _m(df, revenue)
    pos = w > 0
    t = clean_time_of(df, time)
    agg = (df.where(t.isNotNull()).groupBy(period_start(t, "month").alias("month"))
             .agg(F.sum(rev).alias("revenue"),
                  F.sum(F.when(pos, rev).otherwise(F.lit(0).cast(rev_type(df, revenue)))).alias("_num"),
                  F.sum(F.when(pos, w).otherwise(F.lit(0.0))).alias("_den")))
    return agg.select("month", "revenue",
                      (F.col("_num").cast("double") / F.nullif(F.col("_den"), F.lit(0.0))).alias("avg_price"))


def rev_type(df: DataFrame, col: str | Column) -> str:
    if isinstance(col, Column):
        return "double"
    dt = df.schema[col].dataType.simpleString()
    return dt if dt.startswith("decimal") else "double"


def _dim_sums(df: DataFrame, dim: str, measure: str | Column) -> DataFrame:
    """(label, value), checkpointed: top rows and totals are read from it, the fact only once."""
    label = F.coalesce(as_text(dim), F.lit(NA_LABEL)).alias("label")
    return reliable_checkpoint(df.groupBy(label).agg(F.sum(_m(df, measure)).alias("value")))


def _top_of(sums: DataFrame, n: int) -> DataFrame:
    return sums.orderBy(F.col("value").desc(), F.col("label").asc()).limit(n)


def top_contribution(df: DataFrame, dim: str, measure: str | Column, n: int = 10) -> DataFrame:
    """Top-n labels by summed measure: value, share_top (% of the top-n sum),
    share_total and cum_pct (% of the grand total, null unless it is > 0),
    rank. The running window covers the n top rows only."""
    sums = _dim_sums(df, dim, measure)
    total = sums.agg(F.sum("value").alias("_total")).withColumn("_k", F.lit(0))
    top = _top_of(sums, n).withColumn("_k", F.lit(0)).join(bounded_broadcast(total, 1, "grand total"), "_k")
    w = Window.orderBy(F.col("value").desc(), F.col("label").asc())
    tot = F.col("_total").cast("double")
    topsum = F.sum(F.col("value").cast("double")).over(Window.partitionBy("_k"))
    return top.select(
        "label", "value",
        F.when(topsum != 0, F.col("value").cast("double") / topsum * 100.0).alias("share_top"),
        F.when(tot > 0, F.col("value").cast("double") / tot * 100.0).alias("share_total"),
        F.when(tot > 0, F.sum(F.col("value")).over(w.rowsBetween(Window.unboundedPreceding, 0))
               .cast("double") / tot * 100.0).alias("cum_pct"),
        F.row_number().over(w).cast("long").alias("rank"))


def top_share_with_other(df: DataFrame, dim: str, measure: str | Column, n: int = 10,
                         other: str = "Other") -> DataFrame:
    """Top-n (label, value) plus one 'Other' row = max(0, total − top sum),
    present only when positive."""
    sums = _dim_sums(df, dim, measure)
    top = _top_of(sums, n)
    total = sums.agg(F.sum("value").alias("_total"))
    topsum = top.agg(F.sum("value").alias("_top"))
    rest = (total.withColumn("_k", F.lit(0))
            .join(topsum.withColumn("_k", F.lit(0)), "_k")
            .select(F.lit(other).alias("label"),
                    F.greatest(F.col("_total") - F.coalesce(F.col("_top"), F.lit(0)), F.lit(0)).alias("value"))
            .where(F.col("value") > 0))
    return top.select("label", "value").unionByName(rest)


def region_channel(df: DataFrame, region: str, channel: str, measure: str | Column, n: int = 6,
                   other: str = "Other") -> DataFrame:
    """Region x channel sums with channels outside the top n (by summed
    measure) folded into 'Other'; every region gets every channel (absent →
    0, as in the wide table); share_pct of the region total (null if that
    total is 0). A missing channel or region is the text level '(NA)'; a real
    channel called 'Other' is one level with the folded ones. The fact is read
    once, into (region, channel) sums."""
    level = lambda c: F.coalesce(as_text(c), F.lit(NA_LABEL))
    cells = reliable_checkpoint(df.select(level(region).alias("region"), level(channel).alias("ch"),
                                          _m(df, measure).alias("m"))
                                .groupBy("region", "ch").agg(F.sum("m").alias("v")))
    kept = (cells.groupBy("ch").agg(F.sum("v").alias("_s")).orderBy(F.col("_s").desc(), F.col("ch").asc()).limit(n)
            .select("ch", F.lit(True).alias("_keep")))
    tagged = cells.join(bounded_broadcast(kept, n, "top channels"), "ch", "left").select(
        "region", F.when(F.col("_keep"), F.col("ch")).otherwise(F.lit(other)).alias("channel"), "v")
    sums = reliable_checkpoint(tagged.groupBy("region", "channel").agg(F.sum("v").alias("v")))
    channels = sums.select("channel").distinct()        # at most n + 1
    grid = sums.select("region").distinct().withColumn("_k", F.lit(0)).join(
        bounded_broadcast(channels.withColumn("_k", F.lit(0)), n + 1, "channels"), "_k").drop("_k")
    zero = F.lit(0).cast(sums.schema["v"].dataType)
    long = grid.join(sums, ["region", "channel"], "left").select(
        "region", "channel", F.coalesce("v", zero).alias("value"))
    row_tot = F.sum(F.col("value")).over(Window.partitionBy("region")).cast("double")
    return long.select("region", "channel", "value",
                       F.try_divide(F.col("value").cast("double"), row_tot).alias("_s")).select(
        "region", "channel", "value", (F.col("_s") * 100.0).alias("share_pct"))


def _agg(kind: str, v: Column) -> Column:
    if kind == "sum":
        return F.sum(v)
    if kind == "mean":
        return F.avg(v)
    if kind == "count":
        return F.count(F.lit(1))
    raise ValueError(kind)


def custom_pivot(df: DataFrame, x: str, y: str, y_agg: str = "sum", z: str | None = None,
                 z_agg: str | None = None, z_mode: str | None = None, freq: str = "month") -> DataFrame:
    """X = period start (time column) or text category; y = sum / mean /
    median / count (count counts rows); z = '% share of y' (z_mode='share')
    or a second measure with its own aggregate (z_mode='measure').
    Medians come from the distributed exact quantile."""
    from pyspark.sql import types as T
    is_time = isinstance(df.schema[x].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)) \
        or "date" in x.lower() or "time" in x.lower()
    xe = period_start(clean_time_of(df, x), freq) if is_time else as_text(x)
    base = df.select(xe.alias("x"), numeric_of(df, y).alias("_y"),
                     (numeric_of(df, z) if z else F.lit(None).cast("double")).alias("_z"))
    base = base.where(F.col("x").isNotNull())

    def reduce(col: str, kind: str, name: str) -> DataFrame:
        if kind == "median":
            return grouped_quantiles(base, col, [0.5], by=["x"], names=[name])
        return base.groupBy("x").agg(_agg(kind, F.col(col)).alias(name))

    out = reduce("_y", y_agg, "y")
    if z_mode == "share":
        tot = out.agg(F.sum("y").alias("_t")).withColumn("_k", F.lit(0))
        out = (out.withColumn("_k", F.lit(0)).join(bounded_broadcast(tot, 1, "y total"), "_k")
                  .select("x", "y", F.when(F.col("_t") > 0, F.col("y") / F.col("_t") * 100.0).alias("z")))
    elif z_mode == "measure" and z:
        out = out.join(reduce("_z", z_agg or "sum", "z"), "x", "left")
    else:
        out = out.withColumn("z", F.lit(None).cast("double"))
    return out.select("x", F.col("y").cast("double").alias("y"), F.col("z").cast("double").alias("z"))
