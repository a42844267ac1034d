"""Correlation and trend (§2.8, §2.5 rolling/lagged windows).

Pearson statistics for every driver come from **one** aggregation (a
``corr`` and a pair count per driver, each over that pair's own cleaned
rows). Spearman counts every pair's cleaned (x, y) values first, ranks the
counted values in place (all pairs share one range-partitioned pass a side)
and correlates the ranks by weighted sums. Correlation matrices come from one
Gram-matrix pass, whatever the number of columns.
Trend windows (rolling, lagged) run on the aggregated period series, whose
length is bounded by the calendar.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.clean import clean_pair_expr, clean_time_of, numeric_of
from ledgerlens.functions.dist import t_p2
from ledgerlens.operators.filters import period_start
from ledgerlens.operators.profile import normality_p
from ledgerlens.operators.gram import pair_sums
from ledgerlens.operators.ranks import attach_midranks, grouped_quantiles, value_counts
from ledgerlens.plans.runtime import SMALL_ROWS, bounded_broadcast, reliable_checkpoint, small_side

# Normal 97.5 % quantile for the Fisher interval and the
# strength cut points on |r|.
Z975 = 1.959963984540054
FEW = SMALL_ROWS // 10      # values of a column whose ranks are a small table (an estimate is at most some per cent off)
STRENGTH_CUTS = [(0.1, "very_weak"), (0.3, "weak"), (0.5, "moderate"), (0.7, "strong"), (0.9, "very_strong")]


def strength_label(r_abs: Column) -> Column:
    out = F.when(r_abs.isNull() | F.isnan(r_abs), F.lit(None).cast("string"))
    for cut, name in STRENGTH_CUTS:
        out = out.when(r_abs < cut, name)
    return out.otherwise("near_perfect")


def safe_corr(x: Column, y: Column, over=None) -> Column:
    """Pearson r in [-1, 1] of two columns that are null together; null where
    one does not vary (the built-in raises there)."""
    parts = [F.covar_pop(x, y), F.stddev_pop(x), F.stddev_pop(y)]
    cov, sx, sy = parts if over is None else [p.over(over) for p in parts]
    r = F.try_divide(cov, sx * sy)
    return F.when(r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def fisher_ci(r: Column, n: Column) -> tuple[Column, Column]:
    ok = (n > 3) & (F.abs(r) < 0.9999)
    z = F.atanh(r)
    se = F.try_divide(F.lit(1.0), F.sqrt(F.greatest(n - 3, F.lit(0)).cast("double")))
    return F.when(ok, F.tanh(z - Z975 * se)), F.when(ok, F.tanh(z + Z975 * se))


def corr_p(r: Column, n: Column) -> Column:
    """Two-sided p of r under H0 (t with n−2 dof), as for Pearson and Spearman."""
    t = r * F.sqrt(F.try_divide((n - 2).cast("double"), F.greatest(1 - r * r, F.lit(0.0))))
    return F.when(n > 2, F.when(F.abs(r) >= 1, F.lit(0.0)).otherwise(t_p2(t, n - 2)))


def _pairs_long(df: DataFrame, y: str, xs: Sequence[str], drop_neg: bool, drop_zero: bool,
                log10: bool) -> DataFrame:
    """(x, xv, yv) for every row and driver whose pair passes cleaning."""
    yv = numeric_of(df, y)
    items = []
    for x in xs:
        ok, xc, yc = clean_pair_expr(numeric_of(df, x), yv, drop_neg, drop_zero, log10)
        items.append(F.when(ok, F.struct(F.lit(x).alias("x"), xc.alias("xv"), yc.alias("yv"))))
    return df.select(F.explode(F.array(*items)).alias("_p")).where(F.col("_p").isNotNull()).select("_p.*")


def _spearman_pairs(long: DataFrame, key: str = "x") -> DataFrame:
    """(key, n, r) with r the Pearson correlation of within-pair midranks.

    Keys (pairs of columns) where one side has few values rank that side's
    value counts and the other side's distinct values (``_few_valued``). The
    others are first counted by (key, xv, yv); then both ranks are written
    beside the counted rows, one range-partitioned pass each: nothing is joined
    on a value. r comes from weighted sums of the centred ranks, whose mean is
    (n + 1) / 2. The sides' sizes only choose the way, so estimates do."""
    sizes = long.groupBy(key).agg(F.approx_count_distinct("xv").alias("_x"), F.approx_count_distinct("yv").alias("_y")).collect()
    few_x = [s[key] for s in sizes if s["_x"] <= min(s["_y"], FEW)]
    few_y = [s[key] for s in sizes if s["_y"] <= FEW and s[key] not in few_x]
    rest = [s[key] for s in sizes if s[key] not in few_x + few_y]
    ways = [(few_x, lambda part: _few_valued(part, key, "xv", "yv")), (few_y, lambda part: _few_valued(part, key, "yv", "xv")),
            (rest, lambda part: _many_valued(part, key))]
    found = [way(long.where(F.col(key).isin(keys))) for keys, way in ways if keys]
    if not found:
        found = [_many_valued(long, key)]
    return functools.reduce(DataFrame.unionByName, found)


def _few_valued(long: DataFrame, key: str, few: str, many: str) -> DataFrame:
    """(key, n, r) where ``few`` has a small table of values: its centred ranks
    go to the rows by that table, rows become (key, many) with the sum of these
    ranks, and only the distinct values of ``many`` are ranked by range."""
    levels = attach_midranks(value_counts(long, few, [key]), few, "_rf", by=[key], weight="_c", size="n")
    levels = reliable_checkpoint(levels.select(key, few, "_c", (F.col("_rf") - (F.col("n") + 1) / 2.0).alias("_d")))
    rows = long.join(small_side(levels.select(key, few, "_d")), [key, few])
    sums = rows.groupBy(key, many).agg(F.count(F.lit(1)).alias("w"), F.sum("_d").alias("_s"))
    ranked = attach_midranks(sums, many, "_rm", by=[key], weight="w", size="n")
    dm = F.col("_rm") - (F.col("n") + 1) / 2.0
    sums = ranked.groupBy(key).agg(F.sum("w").alias("n"), F.sum(F.col("_s") * dm).alias("_xy"),
                                   F.sum(F.col("w") * dm * dm).alias("_mm"))
    own = levels.groupBy(key).agg(F.sum(F.col("_c") * F.col("_d") * F.col("_d")).alias("_ff"))
    return sums.join(own, key).select(key, "n", F.try_divide("_xy", F.sqrt("_ff") * F.sqrt("_mm")).alias("r"))


def _many_valued(long: DataFrame, key: str) -> DataFrame:
    joint = long.groupBy(key, "xv", "yv").agg(F.count(F.lit(1)).alias("w"))
    ranked = attach_midranks(joint, "xv", "rx", by=[key], weight="w", size="n")
    ranked = attach_midranks(ranked, "yv", "ry", by=[key], weight="w")
    dx, dy = F.col("rx") - (F.col("n") + 1) / 2.0, F.col("ry") - (F.col("n") + 1) / 2.0
    sums = ranked.groupBy(key).agg(F.sum("w").alias("n"), F.sum(F.col("w") * dx * dy).alias("_xy"),
                                   F.sum(F.col("w") * dx * dx).alias("_xx"), F.sum(F.col("w") * dy * dy).alias("_yy"))
    return sums.select(key, "n", F.try_divide("_xy", F.sqrt("_xx") * F.sqrt("_yy")).alias("r"))


def correlation_table(df: DataFrame, y: str, xs: Sequence[str], method: str = "pearson",
                      drop_neg: bool = False, drop_zero: bool = False, log10: bool = False) -> DataFrame:
    """Per driver x: n (pairwise complete after cleaning), r, p_value,
    ci_low/ci_high (Fisher, Pearson only), abs_r, direction, strength."""
    if method == "pearson":
        yv = numeric_of(df, y)
        aggs = []
        for i, x in enumerate(xs):
            ok, xc, yc = clean_pair_expr(numeric_of(df, x), yv, drop_neg, drop_zero, log10)
            aggs += [F.sum(ok.cast("long")).alias(f"n{i}"), safe_corr(F.when(ok, xc), F.when(ok, yc)).alias(f"r{i}")]
        wide = df.agg(*aggs)
        rows = [F.struct(F.lit(x).alias("x"), F.coalesce(F.col(f"n{i}"), F.lit(0).cast("long")).alias("n"),
                         F.col(f"r{i}").alias("r")) for i, x in enumerate(xs)]
        tab = wide.select(F.inline(F.array(*rows)))
    else:
        spark = df.sparkSession
        long = _pairs_long(df, y, xs, drop_neg, drop_zero, log10)
        per = _spearman_pairs(long)
        names = spark.createDataFrame([(x,) for x in xs], "x string")
        tab = names.join(per, "x", "left").select("x", F.coalesce("n", F.lit(0).cast("long")).alias("n"), "r")
    n, r = F.col("n"), F.col("r")
    r = F.when(n >= 3, F.when(~F.isnan(r), r))
    tab = tab.select("x", "n", r.alias("r"))
    lo, hi = fisher_ci(F.col("r"), n) if method == "pearson" else (F.lit(None).cast("double"),) * 2
    return tab.select(
        "x", "n", "r", corr_p(F.col("r"), n).alias("p_value"), lo.alias("ci_low"), hi.alias("ci_high"),
        F.abs("r").alias("abs_r"),
        F.when(F.col("r") > 0, "positive").when(F.col("r") < 0, "negative").alias("direction"),
        strength_label(F.abs("r")).alias("strength"))


def corr_kpis(table: DataFrame) -> DataFrame:
    """n_x, max_n, best_abs_r, pct_significant (share of p < .05, in %)."""
    return table.agg(F.count(F.lit(1)).alias("n_x"), F.max("n").alias("max_n"), F.max("abs_r").alias("best_abs_r"),
                     (F.avg((F.col("p_value") < 0.05).cast("double")) * 100.0).alias("pct_significant"))


def corr_insights(table: DataFrame) -> DataFrame:
    """(kind, x, r, rank): top 3 positive and negative by |r|, up to 5 whose
    CI crosses 0, up to 5 with |r| < .3 but p < .05."""
    order = [F.col("abs_r").desc(), F.col("x").asc()]
    w = Window.partitionBy("kind").orderBy(*order)
    tagged = table.select("x", "r", "abs_r", F.explode(F.array(
        F.when(F.col("r") > 0, F.lit("top_positive")), F.when(F.col("r") < 0, F.lit("top_negative")),
        F.when((F.col("ci_low") < 0) & (F.col("ci_high") > 0), F.lit("ci_crosses_zero")),
        F.when((F.col("abs_r") < 0.3) & (F.col("p_value") < 0.05), F.lit("weak_but_significant")))).alias("kind"))
    ranked = tagged.where(F.col("kind").isNotNull()).withColumn("rank", F.row_number().over(w))
    cap = F.when(F.col("kind").startswith("top_"), 3).otherwise(5)
    return ranked.where(F.col("rank") <= cap).select("kind", "x", "r", "rank")


def _listwise(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    vals = df.select(*[numeric_of(df, c).alias(c) for c in cols])
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).isNotNull()
    return vals.where(cond)


def corr_matrix(df: DataFrame, cols: Sequence[str], method: str = "pearson", min_rows: int = 3,
                listwise: bool = True) -> DataFrame:
    """Correlation matrix in long form (a, b, r), all ordered pairs with the
    diagonal. ``listwise``: over the rows complete in all columns; empty when
    fewer than min_rows. Else each pair over its own complete rows (null r
    below min_rows), and columns that are all null or constant are dropped."""
    cols = list(cols)
    if listwise:
        vals = _listwise(df, cols)
    else:
        vals = df.select(*[numeric_of(df, c).alias(c) for c in cols])
        spread = vals.agg(*[F.min(c).alias(f"lo{i}") for i, c in enumerate(cols)],
                          *[F.max(c).alias(f"hi{i}") for i, c in enumerate(cols)]).first()
        cols = [c for i, c in enumerate(cols) if spread[f"lo{i}"] is not None and spread[f"lo{i}"] < spread[f"hi{i}"]]
        vals = vals.select(*cols)
    schema = "a string, b string, r double"
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([], schema)
    if method == "spearman" and not listwise:
        return _pairwise_spearman(vals, cols, min_rows)
    weight = None
    if method == "spearman":        # listwise: one set of rows serves all columns, so each is ranked once, in place
        vals, weight = _ranked_columns(vals, cols), "_w"
        vals = vals.select(*[F.col(f"_r{i}").alias(c) for i, c in enumerate(cols)], weight)
    n, r = pair_sums(vals, cols, weight)
    if listwise and (not n.size or n[0, 0] < min_rows):
        return spark.createDataFrame([], schema)
    rows = [(a, b, 1.0 if i == j else float(r[i, j]) if n[i, j] >= min_rows and r[i, j] == r[i, j] else None)
            for i, a in enumerate(cols) for j, b in enumerate(cols)]
    return spark.createDataFrame(rows, schema)


def _ranked_columns(vals: DataFrame, cols: list[str]) -> DataFrame:
    """Distinct rows of complete ``cols`` with their count ``_w`` and every
    column's midrank as ``_r0``, ``_r1``, ... A column of few values is ranked in
    its table of value counts, which is joined to the rows; the others are
    ranked by a range-partitioned pass each. Estimated sizes choose the way."""
    sizes = vals.agg(*[F.approx_count_distinct(c).alias(f"d{i}") for i, c in enumerate(cols)]).first()
    few = [i for i in range(len(cols)) if sizes[f"d{i}"] <= FEW]
    rows = vals.groupBy(*cols).agg(F.count(F.lit(1)).alias("_w"))
    if few:
        long = vals.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(cols[i]).alias("v")) for i in few])).alias("_p"))
        levels = attach_midranks(value_counts(long.select("_p.*"), "v", ["i"]), "v", "r", by=["i"], weight="_c")
        levels = reliable_checkpoint(levels.select("i", "v", "r"))
        for i in few:
            own = levels.where(F.col("i") == i).select(F.col("v").alias(cols[i]), F.col("r").alias(f"_r{i}"))
            rows = rows.join(small_side(own), cols[i])
    many = [i for i in range(len(cols)) if i not in few]
    if not many:
        return reliable_checkpoint(rows)
    for i in many:
        rows = attach_midranks(rows, cols[i], f"_r{i}", weight="_w")
    return rows


def _pairwise_spearman(vals: DataFrame, cols: list[str], min_rows: int) -> DataFrame:
    """Every pair ranked over its own complete rows: all pairs in one counted table."""
    spark = vals.sparkSession
    pairs = [(i, a, b) for i, (a, b) in enumerate(itertools.combinations(cols, 2))]
    diag = spark.createDataFrame([(c, c, 1.0) for c in cols], "a string, b string, r double")
    if not pairs:
        return diag
    items = [F.when(F.col(a).isNotNull() & F.col(b).isNotNull(),
                    F.struct(F.lit(i).alias("x"), F.col(a).alias("xv"), F.col(b).alias("yv"))) for i, a, b in pairs]
    long = vals.select(F.explode(F.array(*items)).alias("_p")).where("_p is not null").select("_p.*")
    names = spark.createDataFrame(pairs, "x int, a string, b string")
    upper = names.join(_spearman_pairs(long).where(F.col("n") >= min_rows), "x", "left").select("a", "b", "r")
    return upper.unionByName(upper.select(F.col("b").alias("a"), F.col("a").alias("b"), "r")).unionByName(diag)


def collinearity_pairs(df: DataFrame, cols: Sequence[str], method: str = "pearson", k: int = 10,
                       min_rows: int = 5, high: float = 0.8) -> DataFrame:
    """Upper-triangle |r| of the drivers on listwise rows, highest first,
    top k, with the |r| > 0.8 flag: (x1, x2, abs_r, high)."""
    m = corr_matrix(df, cols, method, min_rows)
    pos = {c: i for i, c in enumerate(cols)}
    spark = df.sparkSession
    idx = spark.createDataFrame([(c, i) for c, i in pos.items()], "c string, i int")
    j = (m.join(bounded_broadcast(idx.withColumnRenamed("c", "a").withColumnRenamed("i", "ia"), len(cols), "cols"), "a")
          .join(bounded_broadcast(idx.withColumnRenamed("c", "b").withColumnRenamed("i", "ib"), len(cols), "cols"), "b")
          .where(F.col("ia") < F.col("ib")))
    return (j.select(F.col("a").alias("x1"), F.col("b").alias("x2"), F.abs("r").alias("abs_r"))
             .orderBy(F.col("abs_r").desc(), "x1", "x2").limit(k)
             .withColumn("high", F.col("abs_r") > high))


def scatter_fit(df: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    """Per driver: n, least-squares slope and intercept of y on x (null when
    x does not vary), r. One aggregation for all drivers, all rows."""
    yv = numeric_of(df, y)
    aggs = []
    for i, x in enumerate(xs):
        xv = numeric_of(df, x)
        ok = xv.isNotNull() & yv.isNotNull()
        xo, yo = F.when(ok, xv), F.when(ok, yv)
        aggs += [F.sum(ok.cast("long")).alias(f"n{i}"), F.regr_slope(yo, xo).alias(f"s{i}"),
                 F.regr_intercept(yo, xo).alias(f"b{i}"), safe_corr(xo, yo).alias(f"r{i}")]
    wide = df.agg(*aggs)
    rows = [F.struct(F.lit(x).alias("x"), F.col(f"n{i}").alias("n"), F.col(f"s{i}").alias("slope"),
                     F.col(f"b{i}").alias("intercept"), F.col(f"r{i}").alias("r")) for i, x in enumerate(xs)]
    out = wide.select(F.inline(F.array(*rows)))
    return out.select("x", "n", "slope", "intercept", F.when(~F.isnan("r"), F.col("r")).alias("r"))


def default_drivers(df: DataFrame, cols: Sequence[str], k: int = 10) -> DataFrame:
    """Numeric columns ranked by sample variance, top k: (x, variance)."""
    wide = df.agg(*[F.var_samp(numeric_of(df, c)).alias(f"v{i}") for i, c in enumerate(cols)])
    rows = [F.struct(F.lit(c).alias("x"), F.col(f"v{i}").alias("variance")) for i, c in enumerate(cols)]
    return (wide.select(F.inline(F.array(*rows))).where(F.col("variance").isNotNull())
                .orderBy(F.col("variance").desc(), "x").limit(k))


FREQ_CODES = {"M": "month", "Q": "quarter", "Y": "year"}


def trend_series(df: DataFrame, time: str, y: str, x: str, y_agg: str = "sum", x_agg: str = "sum",
                 freq: str = "M", min_periods: int = 12, drop_neg: bool = False, drop_zero: bool = False,
                 log10: bool = False) -> DataFrame:
    """Y and X aggregated (sum or mean) per period; the frequency used is the
    first of [freq, Q, M] giving at least ``min_periods`` periods. The rows are
    read once, into checkpointed month sums (bounded by the calendar); period
    counts and coarser periods come from these. Adds index_100 columns
    (value / first period's value · 100; null when that is 0)."""
    t = clean_time_of(df, time)
    ok, xc, yc = clean_pair_expr(numeric_of(df, x), numeric_of(df, y), drop_neg, drop_zero, log10)
    base = df.select(t.alias("_t"), yc.alias("y"), xc.alias("x"), ok.alias("_ok")).where(
        F.col("_t").isNotNull() & F.col("_ok"))
    order = [freq] + [f for f in ("Q", "M") if f != freq]
    months = reliable_checkpoint(base.groupBy(period_start(F.col("_t"), "month").alias("_t")).agg(
        F.sum("y").alias("y"), F.sum("x").alias("x"), F.count(F.lit(1)).alias("_n")))
    counts = months.agg(*[F.count_distinct(period_start(F.col("_t"), FREQ_CODES[c])).alias(c)
                          for c in order]).first()
    used = next((c for c in order if counts[c] >= min_periods), None)
    if used is None:
        return base.sparkSession.createDataFrame(
            [], "freq string, period timestamp, y double, x double, y_index double, x_index double")

    def agg(kind, c):
        return F.sum(c) if kind == "sum" else F.sum(c) / F.sum("_n")

    g = months.groupBy(period_start(F.col("_t"), FREQ_CODES[used]).alias("period")).agg(
        agg(y_agg, F.col("y")).alias("y"), agg(x_agg, F.col("x")).alias("x"))
    w = Window.orderBy("period").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return g.select(F.lit(used).alias("freq"), "period", "y", "x",
                    (F.try_divide("y", F.first("y").over(w)) * 100.0).alias("y_index"),
                    (F.try_divide("x", F.first("x").over(w)) * 100.0).alias("x_index"))


def rolling_corr(series: DataFrame, win: int = 6) -> DataFrame:
    """Pearson r of y and x over the last ``win`` periods (null until a full
    window): (period, r). ``series`` is a per-period table."""
    w = Window.orderBy("period").rowsBetween(-(win - 1), 0)
    full = F.count("y").over(w) == win
    real = F.col("y").isNotNull() & F.col("x").isNotNull()
    r = safe_corr(F.when(real, F.col("y")), F.when(real, F.col("x")), w)
    return series.select("period", F.when(full, r).alias("r"))


def lagged_corr(series: DataFrame, max_lag: int = 6) -> DataFrame:
    """For lag in −L..L: corr(Y_t, X_{t−lag}) over the pairs present (≥ 3);
    bound = 2/√(len − L) when len − L > 4; is_best marks the largest |r|.
    (lag, n, r, bound, is_best)."""
    rn = Window.orderBy("period")
    s = series.select(F.row_number().over(rn).alias("rn"), "y", "x")
    lags = F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag))).alias("lag")
    a = s.select("rn", "y", lags)
    b = s.select(F.col("rn").alias("rn_b"), F.col("x").alias("xb"))
    pairs = a.join(b, F.col("rn_b") == F.col("rn") - F.col("lag"))
    real = F.col("y").isNotNull() & F.col("xb").isNotNull()
    both_y, both_x = F.when(real, F.col("y")), F.when(real, F.col("xb"))
    per = pairs.groupBy("lag").agg(F.count(F.lit(1)).alias("n"), safe_corr(both_y, both_x).alias("r"))
    per = per.where((F.col("n") >= 3) & F.col("r").isNotNull() & ~F.isnan("r"))
    length = series.agg(F.count(F.lit(1)).alias("_len"))
    j = per.withColumn("_k", F.lit(0)).join(bounded_broadcast(length.withColumn("_k", F.lit(0)), 1, "len"), "_k")
    n_eff = F.col("_len") - max_lag
    best = F.max(F.abs("r")).over(Window.partitionBy("_k"))
    return j.select("lag", "n", "r", F.when(n_eff > 4, 2.0 / F.sqrt(n_eff.cast("double"))).alias("bound"),
                    (F.abs("r") == best).alias("is_best"))


def first_last_change(series: DataFrame) -> DataFrame:
    """(last/first − 1)·100 for y and x over the period series."""
    a = series.agg(F.min_by("y", "period").alias("y0"), F.max_by("y", "period").alias("y1"),
                   F.min_by("x", "period").alias("x0"), F.max_by("x", "period").alias("x1"))
    return a.select(F.when(F.col("y0") != 0, (F.col("y1") / F.col("y0") - 1) * 100.0).alias("y_change_pct"),
                    F.when(F.col("x0") != 0, (F.col("x1") / F.col("x0") - 1) * 100.0).alias("x_change_pct"))


def spearman_recommended(df: DataFrame, cols: Sequence[str], min_n: int = 50) -> DataFrame:
    """Per column with n ≥ min_n: |skew| > 1, |kurt| > 3, share
    above p99 > 2 %, or normality p < .05 (n > 20) → recommend Spearman.
    (column, n, skew, kurt, tail_share, p_normal, recommend)."""
    from ledgerlens.operators.profile import long_values
    lv = long_values(df, cols).where(F.col("v").isNotNull())
    p99 = grouped_quantiles(lv, "v", [0.99], by=["column"], names=["p99"])
    mom = lv.groupBy("column").agg(F.count("v").alias("n"), F.skewness("v").alias("skew"),
                                   F.kurtosis("v").alias("kurt"))
    tail = lv.join(bounded_broadcast(p99, len(cols), "one row a column"), "column").groupBy("column").agg(
        F.avg((F.col("v") > F.col("p99")).cast("double")).alias("tail_share"))
    j = mom.join(tail, "column").where(F.col("n") >= min_n)
    n = F.col("n")
    pn = F.when(n > 20, normality_p(n, F.col("skew"), F.col("kurt")))
    return j.select("column", "n", "skew", "kurt", "tail_share", pn.alias("p_normal"),
                    ((F.abs("skew") > 1) | (F.abs("kurt") > 3) | (F.col("tail_share") > 0.02)
                     | F.coalesce(pn < 0.05, F.lit(False))).alias("recommend"))
