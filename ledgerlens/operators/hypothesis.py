"""Hypothesis tests (§2.10): group summaries, Welch t, one-way ANOVA with
Brown-Forsythe Levene, two-way Type-II ANOVA, repeated-measures ANOVA,
Mann-Whitney, Kruskal-Wallis, Wilcoxon signed-rank, Friedman, and Holm-
adjusted post-hoc pairs.

The fact table is read once: ``group_counts`` aggregates it to (group, value,
count) and checkpoints that; the top levels, the merge of the others, the
moments, medians and midranks all come from this table. Groups are bucketed to
the top levels plus 'Other', so a test's sufficient statistics are at most
top + 1 group rows or their pairs: they come to the driver, where the test is
a closed form (or a least squares on the cells of the two-way design). Statistics that are not
defined (zero variance, all values tied, one group) come out as null.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ledgerlens.functions.clean import numeric_of
from ledgerlens.functions.dist import chi2_p, chi2_sf, f_p, f_sf, mw_test, t_sf2, wilcoxon_test
from ledgerlens.operators.filters import NA_LABEL, as_text, bucket_other
from ledgerlens.operators.ranks import attach_midranks, grouped_quantiles, ordered_prefix
from ledgerlens.plans.runtime import bounded_broadcast, reliable_checkpoint

# Group levels kept before 'Other' (factor A / factor B of the
# two-way design), the 95 % multiplier of the group summary and the effect
# size bands.
TOP_GROUPS = 10
TOP_B = 8
CI_MULT = 1.96
ETA_BANDS = (0.06, 0.14)
R_BANDS = (0.3, 0.5)
W_BANDS = (0.1, 0.3)


def group_counts(df: DataFrame, y: str, g: str, top: int = TOP_GROUPS, keep_na: bool = False) -> DataFrame:
    """(g, y, c): how often each numeric y occurs in each group; group as text,
    bucketed to the top levels by row count (rest 'Other'); rows with missing
    y or group do not count, but a missing y counts for a level's size. One
    pass over ``df``; the counted table is checkpointed."""
    txt = as_text(g)
    if keep_na:
        txt = F.coalesce(txt, F.lit(NA_LABEL))
    counted = reliable_checkpoint(df.select(txt.alias("g"), numeric_of(df, y).alias("y")).where("g is not null")
                                  .groupBy("g", "y").agg(F.count(F.lit(1)).alias("c")))
    sizes = counted.groupBy("g").agg(F.sum("c").alias("_w")).orderBy(F.col("_w").desc(), F.col("g").asc())
    levels = [r["g"] for r in sizes.limit(top + 1).collect()]
    counted = counted.where("y is not null")
    if len(levels) <= top:
        return counted
    bucket = F.when(F.col("g").isin(levels[:top]), F.col("g")).otherwise(F.lit("Other"))
    return reliable_checkpoint(counted.groupBy(bucket.alias("g"), "y").agg(F.sum("c").alias("c")))


def _one(df: DataFrame) -> DataFrame:
    return df.withColumn("_k", F.lit(0))


class GroupStats(NamedTuple):
    g: str
    n: int
    mean: float
    var: float | None       # n − 1; None for n = 1


def group_stats(gc: DataFrame) -> list[GroupStats]:
    """Per group of a counted table, highest mean first (name on ties): at most
    top + 1 rows, on the driver. Squares are summed about the group mean."""
    mean = gc.groupBy("g").agg((F.sum(F.col("c") * F.col("y")) / F.sum("c")).alias("mean"))
    dev = F.col("c") * (F.col("y") - F.col("mean")) ** 2
    rows = gc.join(F.broadcast(mean), "g").groupBy("g", "mean").agg(F.sum("c").alias("n"), F.sum(dev).alias("m2")).collect()
    return sorted((GroupStats(r["g"], r["n"], r["mean"], r["m2"] / (r["n"] - 1) if r["n"] > 1 else None) for r in rows),
                  key=lambda x: (-x.mean, x.g))


def group_medians(gc: DataFrame) -> dict[str, float]:
    """Median of each group, highest first (name on ties)."""
    rows = grouped_quantiles(gc, "y", [0.5], by=["g"], names=["med"], weight="c", distinct=True).collect()
    return dict(sorted(((r["g"], r["med"]) for r in rows), key=lambda x: (-x[1], x[0])))


def group_summary(df: DataFrame, y: str, g: str, top: int = TOP_GROUPS) -> DataFrame:
    """Per group: n, mean, std (n−1), median, se, ci95 (= 1.96·se);
    undefined values shown as 0."""
    gc = group_counts(df, y, g, top)
    medians = group_medians(gc)
    rows = []
    for st in group_stats(gc):
        std = math.sqrt(st.var or 0.0)
        se = std / math.sqrt(st.n)
        rows.append((st.g, st.n, st.mean, std, float(medians[st.g]), se, CI_MULT * se))
    return df.sparkSession.createDataFrame(rows, "grp string, n long, mean double, std double, median double, se double, "
                                                 "ci95 double")


def cell_means(df: DataFrame, y: str, a: str, b: str) -> DataFrame:
    """n and mean of y per (a, b) cell (both factors as text)."""
    v = numeric_of(df, y)
    base = df.select(v.alias("y"), F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b"))
    return (base.where(F.col("y").isNotNull() & F.col("a").isNotNull() & F.col("b").isNotNull())
                .groupBy("a", "b").agg(F.count("y").alias("n"), F.avg("y").alias("mean")))


# ------------------------------------------------------------ parametric
def _div(a: float, b: float) -> float | None:
    return a / b if b else None


def _welch(a: GroupStats, b: GroupStats) -> tuple[float | None, float | None, float | None]:
    """t, dof and p; None when both groups have no variance."""
    sa, sb = a.var / a.n, b.var / b.n
    t = _div(a.mean - b.mean, math.sqrt(sa + sb))
    dof = _div((sa + sb) ** 2, sa * sa / (a.n - 1) + sb * sb / (b.n - 1))
    return t, dof, None if t is None or dof is None else t_sf2(t, dof)


def welch_t(df: DataFrame, y: str, g: str, top: int = TOP_GROUPS) -> DataFrame:
    """Welch t-test of exactly two groups (higher mean first): group_a,
    group_b, t, dof, p_value. No row when there are not two groups, or when
    one has a single value; null t where neither group varies."""
    st = group_stats(group_counts(df, y, g, top))
    rows = [(st[0].g, st[1].g, *_welch(*st))] if len(st) == 2 and min(x.n for x in st) >= 2 else []
    return df.sparkSession.createDataFrame(rows, "group_a string, group_b string, t double, dof double, p_value double")


def _between_within(st: list[GroupStats]) -> tuple[float, float]:
    n = sum(x.n for x in st)
    grand = math.fsum(x.n * x.mean for x in st) / n
    return (math.fsum(x.n * (x.mean - grand) ** 2 for x in st),
            math.fsum((x.n - 1) * x.var for x in st if x.var is not None))


def anova_oneway(df: DataFrame, y: str, g: str, top: int = TOP_GROUPS) -> DataFrame:
    """F, p_value, df1, df2, eta2, omega2, levene_p (median-centred), the
    effect label on eta² and the group with the highest mean. F is infinite
    (p 0) where groups differ but do not vary inside, null where nothing
    varies; levene_p is null where the deviations do not vary."""
    gc = group_counts(df, y, g, top)
    st = group_stats(gc)
    schema = ("f double, p_value double, df1 double, df2 double, eta2 double, omega2 double, levene_p double, "
              "strength string, best_group string")
    k, n = len(st), sum(x.n for x in st)
    if k < 2 or n < 3:
        return df.sparkSession.createDataFrame([], schema)
    medians = group_medians(gc)
    med = df.sparkSession.createDataFrame(list(medians.items()), "g string, _med double")
    deviations = gc.join(bounded_broadcast(med, top + 1, "group medians"), "g")
    lev = group_stats(deviations.select("g", F.abs(F.col("y") - F.col("_med")).alias("y"), "c"))
    df1, df2 = float(k - 1), float(max(n - k, 1))
    ssb, ssw = _between_within(st)
    l_ssb, l_ssw = _between_within(lev)
    msw, eta2 = ssw / df2, _div(ssb, ssb + ssw)
    f = ssb / df1 / msw if msw > 0 else math.inf if ssb > 0 else None
    l_f = _div(l_ssb / df1, l_ssw / df2)
    strength = None if eta2 is None else "weak" if eta2 < ETA_BANDS[0] else "medium" if eta2 < ETA_BANDS[1] else "strong"
    row = (f, None if f is None else f_sf(f, df1, df2), df1, df2, eta2, _div(ssb - df1 * msw, ssb + ssw + msw),
           None if l_f is None else f_sf(l_f, df1, df2), strength, st[0].g)
    return df.sparkSession.createDataFrame([row], schema)


def _holm(pairs: DataFrame, p: str = "p_raw") -> DataFrame:
    """Holm step-down adjustment over a pair table; pairs whose p is not
    defined are no tests: they keep null and do not count."""
    real = F.col(p).isNotNull()
    part = Window.partitionBy(real)
    w = part.orderBy(F.col(p).asc(), F.col("group_a").asc(), F.col("group_b").asc())
    step = (F.count(F.lit(1)).over(part) - F.row_number().over(w) + 1) * F.col(p)
    stepped = pairs.withColumn("_step", step)
    running = F.max("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return stepped.withColumn("p_adj_holm", F.when(real, F.least(running, F.lit(1.0)))).drop("_step")


def _first_pairs(out: DataFrame, k: int | None) -> DataFrame:
    """Smallest adjusted p first; all pairs unless a report asks for the first k."""
    out = out.orderBy(F.col("p_adj_holm").asc_nulls_last(), "group_a", "group_b")
    return out if k is None else out.limit(k)


def posthoc_welch_holm(df: DataFrame, y: str, g: str, top: int = TOP_GROUPS, k: int | None = None) -> DataFrame:
    """All pairs of the kept groups (both n ≥ 2, order by mean descending): t,
    dof, Welch p, Holm adjustment, mean difference; smallest adjusted p first."""
    st = [x for x in group_stats(group_counts(df, y, g, top)) if x.n >= 2]
    rows = [(a.g, b.g, *_welch(a, b), a.mean - b.mean) for a, b in itertools.combinations(st, 2)]
    pp = df.sparkSession.createDataFrame(rows, "group_a string, group_b string, t double, dof double, p_raw double, "
                                               "mean_diff double")
    return _first_pairs(_holm(pp), k).select("group_a", "group_b", "t", "dof", "p_raw", "p_adj_holm", "mean_diff")


def anova_twoway(df: DataFrame, y: str, a: str, b: str, top_a: int = TOP_GROUPS, top_b: int = TOP_B) -> DataFrame:
    """Type-II ANOVA of y ~ A + B + A:B (A top 10, B top 8 levels + Other):
    term, sum_sq, dof, f, p_value, partial_eta2. ``df`` is read once, into
    checkpointed cells of all levels (n, mean, squares about the mean); top
    levels and the merge into Other come from these. The additive fit is a
    weighted least squares on the ≤ 99 cells left."""
    base = df.select(numeric_of(df, y).alias("y"), as_text(a).alias("a"), as_text(b).alias("b"))
    base = base.where(F.col("y").isNotNull() & F.col("a").isNotNull() & F.col("b").isNotNull())
    cells = reliable_checkpoint(base.groupBy("a", "b").agg(
        F.count("y").alias("n"), F.avg("y").alias("mean"), (F.var_pop("y") * F.count("y")).alias("m2")))
    cells = bucket_other(bucket_other(cells, "a", top_a, by="n"), "b", top_b, by="n")
    means = cells.groupBy("a", "b").agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_mean"))
    merged = F.col("m2") + F.col("n") * (F.col("mean") - F.col("_mean")) ** 2
    cells = cells.join(bounded_broadcast(means, (top_a + 1) * (top_b + 1), "cell means"), ["a", "b"]).groupBy(
        "a", "b", F.col("_mean").alias("mean")).agg(F.sum("n").alias("n"), F.sum(merged).alias("m2")).collect()
    spark = df.sparkSession
    schema = "term string, sum_sq double, dof double, f double, p_value double, partial_eta2 double"
    if not cells:
        return spark.createDataFrame([], schema)
    la = sorted({c["a"] for c in cells})
    lb = sorted({c["b"] for c in cells})
    n = np.array([c["n"] for c in cells], dtype=float)
    mean = np.array([c["mean"] for c in cells], dtype=float)
    within = math.fsum(c["m2"] for c in cells)
    ia = np.array([la.index(c["a"]) for c in cells])
    ib = np.array([lb.index(c["b"]) for c in cells])

    def rss(cols: list[np.ndarray]) -> tuple[float, int]:
        x = np.column_stack([np.ones(len(cells))] + cols)
        sw = np.sqrt(n)
        coef, *_ = np.linalg.lstsq(x * sw[:, None], mean * sw, rcond=None)
        fit = x @ coef
        return within + float(np.sum(n * (mean - fit) ** 2)), int(np.linalg.matrix_rank(x * sw[:, None]))

    da = [(ia == i).astype(float) for i in range(1, len(la))]
    db = [(ib == j).astype(float) for j in range(1, len(lb))]
    rss_a, _ = rss(da)
    rss_b, _ = rss(db)
    rss_ab, rank_ab = rss(da + db)
    total_n = float(n.sum())
    df_res = total_n - len(cells)
    ms_res = within / df_res if df_res > 0 else float("nan")
    terms = [("A", rss_b - rss_ab, float(len(la) - 1)), ("B", rss_a - rss_ab, float(len(lb) - 1)),
             ("A:B", rss_ab - within, float(len(cells) - rank_ab))]
    rows = []
    for term, ss, dof in terms:
        f = (ss / dof) / ms_res if dof > 0 and ms_res > 0 else float("nan")
        p = f_sf(f, dof, df_res) if dof > 0 and df_res > 0 else float("nan")
        eta = ss / (ss + within) if ss + within > 0 else float("nan")
        rows.append((term, float(ss), dof, float(f), float(p), float(eta)))
    rows.append(("Residual", within, df_res, None, None, None))
    return spark.createDataFrame(rows, schema)


# ------------------------------------------------------------ repeated measures
def subject_condition_means(df: DataFrame, y: str, subject: str, cond: str) -> DataFrame:
    """Mean y per (subject, condition) for subjects observed under every
    condition present (duplicates in a cell are averaged): (id, cond, y)."""
    base = df.select(F.col(subject).alias("id"), F.col(cond).cast("string").alias("cond"), numeric_of(df, y).alias("y"))
    base = base.where(F.col("id").isNotNull() & F.col("cond").isNotNull() & F.col("y").isNotNull())
    cells = base.groupBy("id", "cond").agg(F.avg("y").alias("y"))
    m = cells.agg(F.count_distinct("cond").alias("_m"))
    per = cells.groupBy("id").agg(F.count(F.lit(1)).alias("_c"))
    complete = _one(per).join(bounded_broadcast(_one(m), 1, "condition count"), "_k") \
        .where(F.col("_c") == F.col("_m")).select("id")
    return cells.join(complete, "id", "left_semi")


def anova_rm(df: DataFrame, y: str, subject: str, cond: str) -> DataFrame:
    """Within-subject ANOVA on complete subjects: f, df1 = m−1,
    df2 = (m−1)(n−1), p_value, n_subjects. F is infinite (p 0) where the
    conditions differ without any error, null where nothing varies."""
    sc = subject_condition_means(df, y, subject, cond)
    grand = sc.agg(F.avg("y").alias("_gm"), F.count_distinct("cond").alias("_m"), F.count_distinct("id").alias("_n"))
    j = _one(sc).join(bounded_broadcast(_one(grand), 1, "grand"), "_k")
    cm = j.groupBy("cond").agg(F.avg("y").alias("_cm"), F.first("_gm").alias("_gm"), F.first("_n").alias("_n"))
    sm = j.groupBy("id").agg(F.avg("y").alias("_sm"), F.first("_gm").alias("_gm"), F.first("_m").alias("_m"))
    ss_c = cm.agg(F.sum(F.col("_n") * (F.col("_cm") - F.col("_gm")) ** 2).alias("ss_c"))
    ss_s = sm.agg(F.sum(F.col("_m") * (F.col("_sm") - F.col("_gm")) ** 2).alias("ss_s"))
    ss_t = j.agg(F.sum((F.col("y") - F.col("_gm")) ** 2).alias("ss_t"), F.first("_m").alias("m"),
                 F.first("_n").alias("n"))
    r = _one(ss_c).join(_one(ss_s), "_k").join(_one(ss_t), "_k")
    df1 = (F.col("m") - 1).cast("double")
    df2 = ((F.col("m") - 1) * (F.col("n") - 1)).cast("double")
    left = F.col("ss_t") - F.col("ss_c") - F.col("ss_s")
    ss_e = F.when(left > 1e-12 * F.col("ss_t"), left).otherwise(F.lit(0.0))     # rounding is no error variance
    f = F.try_divide(F.try_divide(F.col("ss_c"), df1), F.try_divide(ss_e, df2))
    f = F.when(F.col("m") >= 2, F.coalesce(f, F.when((F.col("ss_c") > 0) & (df2 > 0), F.lit(float("inf")))))
    return r.select(f.alias("f"), df1.alias("df1"), df2.alias("df2"), f_p(f, df1, df2).alias("p_value"),
                    F.col("n").alias("n_subjects"))


# ------------------------------------------------------------ rank tests
def _rank_sums(gc: DataFrame) -> DataFrame:
    """(g, rank_sum, n_g, n, ties) of a counted table: rank sums of pooled
    midranks written beside the counted values, the pool's size, and the
    group's share of the pool's tie term (c tied values of t carry c (t² − 1))."""
    ranked = attach_midranks(gc, "y", "midrank", weight="c", size="n", ties="t")
    t = F.col("t").cast("double")
    return ranked.groupBy("g").agg(F.sum(F.col("c") * F.col("midrank")).alias("rank_sum"), F.sum("c").alias("n_g"),
                                   F.first("n").alias("n"), F.sum(F.col("c") * (t * t - 1)).alias("ties"))


def _pair_sums(gc: DataFrame, levels: list[str], pairs: list[tuple[str, str]]) -> list[tuple[dict, dict]]:
    """For each pair of groups what ``_mw`` asks of both. A distinct y is one
    row with its count in each group (at most top + 1 columns); running counts
    over y say how much of a group lies below it, so U of group a sums
    c_a (less_b + c_b / 2) and t tied values of the pair carry t (t² − 1)."""
    if not pairs:
        return []
    at = {lv: i for i, lv in enumerate(levels)}
    wide = gc.groupBy("y").agg(*[F.sum(F.when(F.col("g") == lv, F.col("c")).otherwise(F.lit(0))).alias(f"c{i}")
                                 for lv, i in at.items()])
    wide = ordered_prefix(wide, ["y"], {f"less{i}": F.col(f"c{i}") for i in at.values()}, inclusive=False)

    def c(lv: str) -> Column:
        return F.col(f"c{at[lv]}").cast("double")

    aggs = [F.sum(f"c{i}").alias(f"n{i}") for i in at.values()]
    for k, (a, b) in enumerate(pairs):
        t = c(a) + c(b)
        aggs += [F.sum(c(a) * (F.col(f"less{at[b]}") + c(b) / 2)).alias(f"u{k}"), F.sum(t * (t * t - 1)).alias(f"t{k}")]
    r = wide.agg(*aggs).first()
    out = []
    for k, (a, b) in enumerate(pairs):
        n1, n2 = r[f"n{at[a]}"], r[f"n{at[b]}"]
        out.append(({"n_g": n1, "rank_sum": r[f"u{k}"] + n1 * (n1 + 1) / 2, "ties": r[f"t{k}"]}, {"n_g": n2, "ties": 0.0}))
    return out


def _mw(a: Row | dict, b: Row | dict) -> tuple[float, float | None, float | None]:
    """U of group a, z and p. z is the tie- and continuity-corrected normal
    deviate; for a small untied sample p is exact and z taken back from it.
    None when all values are tied."""
    n1, n2 = a["n_g"], b["n_g"]
    n, ties = float(n1 + n2), a["ties"] + b["ties"]
    u = a["rank_sum"] - n1 * (n1 + 1) / 2
    var = n1 * n2 / 12.0 * ((n + 1) - ties / (n * (n - 1)))
    if var <= 1e-12 * n1 * n2 * n:
        return u, None, None
    z = max((max(u, n1 * n2 - u) - n1 * n2 / 2.0 - 0.5) / math.sqrt(var), 0.0)
    return u, *mw_test(u, z, n1, n2, ties > 0)


def _r_strength(r: float | None) -> str | None:
    return None if r is None else "strong" if r >= R_BANDS[1] else "medium" if r >= R_BANDS[0] else "weak"


def mann_whitney(df: DataFrame, y: str, g: str, top: int = TOP_GROUPS) -> DataFrame:
    """Exactly two groups (order: median descending): u (of the first group),
    z, p_value, r_effect = z/√n, strength (.3 / .5). p is exact for an untied
    sample whose smaller group has at most 8 values (and n1·n2 at most a
    million), and z is taken back from it; else z is the tie- and
    continuity-corrected normal deviate. No row when there are not two groups;
    null z when all values are tied."""
    schema = "u double, z double, p_value double, r_effect double, strength string"
    gc = group_counts(df, y, g, top)
    medians = list(group_medians(gc))
    if len(medians) != 2:
        return df.sparkSession.createDataFrame([], schema)
    sums = {r["g"]: r for r in _rank_sums(gc).collect()}
    a, b = (sums[x] for x in medians)
    u, z, p = _mw(a, b)
    r = None if z is None else z / math.sqrt(a["n"])
    return df.sparkSession.createDataFrame([(u, z, p, r, _r_strength(r))], schema)


def kruskal(df: DataFrame, y: str, g: str, top: int = TOP_GROUPS) -> DataFrame:
    """h (tie-corrected), dof = k−1, p_value (χ²), eps2 = (H−(k−1))/(n−k),
    strength (.06 / .14 on eps2). No row below two groups; null h when all
    values are tied."""
    schema = "h double, dof long, p_value double, eps2 double, strength string"
    sums = sorted(_rank_sums(group_counts(df, y, g, top)).collect(), key=lambda r: r["g"])
    k = len(sums)
    if k < 2:
        return df.sparkSession.createDataFrame([], schema)
    n = float(sums[0]["n"])
    left = 1 - math.fsum(r["ties"] for r in sums) / (n * n * n - n)
    h = None
    if left > 1e-12:
        h = (12.0 / (n * (n + 1)) * math.fsum(r["rank_sum"] ** 2 / r["n_g"] for r in sums) - 3 * (n + 1)) / left
    eps2 = None if h is None or n <= k else (h - (k - 1)) / (n - k)
    strength = "weak" if eps2 is None or eps2 < ETA_BANDS[0] else "medium" if eps2 < ETA_BANDS[1] else "strong"
    return df.sparkSession.createDataFrame([(h, k - 1, None if h is None else chi2_sf(h, k - 1), eps2, strength)], schema)


def posthoc_mw_holm(df: DataFrame, y: str, g: str, top: int = TOP_GROUPS, k: int | None = None) -> DataFrame:
    """Pairwise Mann-Whitney (groups ordered by median, descending): u, z, p,
    Holm adjustment; smallest adjusted p first. All pairs share one running
    count of the distinct values (``_pair_sums``)."""
    gc = group_counts(df, y, g, top)
    levels = list(group_medians(gc))        # at most top + 1
    pairs = list(itertools.combinations(levels, 2))
    spark = df.sparkSession
    rows = [(a, b, *_mw(*sums)) for (a, b), sums in zip(pairs, _pair_sums(gc, levels, pairs))]
    pp = spark.createDataFrame(rows, "group_a string, group_b string, u double, z double, p_raw double")
    return _first_pairs(_holm(pp), k).select("group_a", "group_b", "u", "z", "p_raw", "p_adj_holm")


def _paired_diffs(sc: DataFrame, a: str, b: str) -> DataFrame:
    return sc.groupBy("id").agg((F.max(F.when(F.col("cond") == a, F.col("y")))
                                 - F.max(F.when(F.col("cond") == b, F.col("y")))).alias("d"))


def _signed_rank(diffs: DataFrame, by: list[str]) -> dict[tuple, tuple]:
    """By key: W = min(W+, W−) over non-zero differences, z and p, and the
    number of complete subjects. z is the tie-corrected normal deviate without
    continuity correction; for up to 50 untied differences without a zero p is
    exact and z taken back from it. None without a non-zero difference."""
    zero = F.col("d") == 0
    counted = diffs.groupBy(*by, F.abs("d").alias("y")).agg(
        F.sum((F.col("d") > 0).cast("long")).alias("pos"), F.count(F.lit(1)).alias("c"))
    ranked = attach_midranks(counted.where("y > 0"), "y", "rank", by=by, weight="c", ties="t")
    t = F.col("t").cast("double")
    sums = ranked.groupBy(*by).agg(F.sum(F.col("pos") * F.col("rank")).alias("plus"), F.sum("c").alias("nr"),
                                   F.sum((F.col("c") - F.col("pos")) * F.col("rank")).alias("minus"),
                                   F.sum(F.col("c") * (t * t - 1)).alias("ties"))
    found = {tuple(r[b] for b in by): r for r in sums.collect()}
    out = {}
    for r in diffs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(zero).alias("zeros")).collect():
        key = tuple(r[b] for b in by)
        if key not in found or not found[key]["nr"]:
            out[key] = (None, None, None, r["n"])
            continue
        s = found[key]
        n, w = float(s["nr"]), min(s["plus"], s["minus"])
        var = n * (n + 1) * (2 * n + 1) / 24.0 - s["ties"] / 48.0
        z = abs(w - n * (n + 1) / 4.0) / math.sqrt(var)
        out[key] = (w, *wilcoxon_test(w, z, s["nr"], not r["zeros"] and s["ties"] == 0), r["n"])
    return out


def wilcoxon(df: DataFrame, y: str, subject: str, cond: str, pair: tuple[str, str] | None = None) -> DataFrame:
    """Two conditions (name order, or ``pair``; other conditions than a given
    pair's are left out before completeness is judged): w, z, p_value,
    r_effect = z/√(complete subjects), strength. p is exact for up to 50 untied
    non-zero differences, and z taken back from it; else the normal form. An
    error when there are not exactly two conditions; null statistics without a
    non-zero difference."""
    if pair is not None:
        df = df.where(F.col(cond).cast("string").isin(*map(str, pair)))
    sc = reliable_checkpoint(subject_condition_means(df, y, subject, cond))
    levels = [r["cond"] for r in sc.select("cond").distinct().orderBy("cond").limit(3).collect()]
    if len(levels) != 2:
        raise ValueError("wilcoxon needs exactly two conditions; name them with pair=(a, b)")
    a, b = map(str, pair) if pair is not None else levels
    w, z, p, n = _signed_rank(_paired_diffs(sc, a, b), [])[()]
    r = None if z is None else z / math.sqrt(n)
    return df.sparkSession.createDataFrame([(w, z, p, r, _r_strength(r))],
                                           "w double, z double, p_value double, r_effect double, strength string")


def posthoc_wilcoxon_holm(df: DataFrame, y: str, subject: str, cond: str, k: int | None = None,
                          max_conditions: int = 200) -> DataFrame:
    """Pairwise Wilcoxon over all condition pairs: w, z, p, Holm adjustment.
    The number of pairs is the square of the conditions', so more than
    ``max_conditions`` is refused with an error (a repeated-measures design
    has few); nothing is left out silently."""
    sc = reliable_checkpoint(subject_condition_means(df, y, subject, cond))
    names = sc.select("cond").distinct().orderBy("cond").limit(max_conditions + 1).collect()
    if len(names) > max_conditions:
        raise ValueError(f"more than {max_conditions} conditions")
    levels = [r["cond"] for r in names]
    pairs = list(itertools.combinations(levels, 2))
    spark = df.sparkSession
    if not pairs:
        return spark.createDataFrame([], "group_a string, group_b string, w double, z double, p_raw double, "
                                         "p_adj_holm double")
    place = spark.createDataFrame([(c, i) for i, c in enumerate(levels)], "cond string, i int")
    placed = sc.join(bounded_broadcast(place, max_conditions, "conditions"), "cond")
    # a value goes to the pairs of its condition: first in those with later ones, second in those with earlier ones
    last = F.lit(len(levels) - 1)
    other = F.filter(F.sequence(F.lit(0), last), lambda o: o != F.col("i"))
    ex = placed.select("id", "y", "i", F.explode(other).alias("o")).select(
        "id", F.least("i", "o").alias("a"), F.greatest("i", "o").alias("b"),
        F.when(F.col("i") < F.col("o"), F.col("y")).otherwise(-F.col("y")).alias("sy"))
    diffs = ex.groupBy("a", "b", "id").agg(F.sum("sy").alias("d"))
    rows = [(levels[i], levels[j], w, z, p) for (i, j), (w, z, p, _) in _signed_rank(reliable_checkpoint(diffs), ["a", "b"]).items()]
    pp = spark.createDataFrame(rows, "group_a string, group_b string, w double, z double, p_raw double")
    return _first_pairs(_holm(pp), k).select("group_a", "group_b", "w", "z", "p_raw", "p_adj_holm")


def friedman(df: DataFrame, y: str, subject: str, cond: str) -> DataFrame:
    """Friedman χ² (tie-corrected) over complete subjects, dof = m−1,
    p_value, w_ref = χ²/(n·m(m+1)/12) as the reference codes it,
    kendall_w = χ²/(n(m−1)), strength on w_ref (.1 / .3). Null statistics when
    all values of every subject are tied; no row without a complete subject.
    A subject's few rows are ranked in a window; tie terms are summed there."""
    sc = subject_condition_means(df, y, subject, cond)
    within = Window.partitionBy("id").orderBy("y")
    tie = Window.partitionBy("id", "y")
    ranked = sc.withColumn("_t", F.count(F.lit(1)).over(tie)) \
               .withColumn("_rk", F.rank().over(within) + (F.col("_t") - 1) / 2.0)
    # each of t tied rows carries t² − 1, so that a tie adds up to t³ − t
    rs = ranked.groupBy("cond").agg(F.sum("_rk").alias("R"), F.count(F.lit(1)).alias("n"),
                                    F.sum(F.col("_t").cast("double") ** 2 - 1).alias("ties"))
    j = rs.agg(F.sum(F.col("R") ** 2).alias("ssbn"), F.max("n").alias("n"), F.count(F.lit(1)).alias("m"),
               F.sum("ties").alias("ties")).where("m > 0")
    n, m = F.col("n").cast("double"), F.col("m").cast("double")
    c = 1 - F.try_divide("ties", m * (m * m - 1) * n)
    chi2 = F.try_divide(12.0 / (m * n * (m + 1)) * F.col("ssbn") - 3 * n * (m + 1), F.when(c > 1e-12, c))
    w_ref = chi2 / (n * m * (m + 1) / 12.0)
    return j.select(chi2.alias("chi2"), (F.col("m") - 1).alias("dof"), chi2_p(chi2, F.col("m") - 1).alias("p_value"),
                    w_ref.alias("w_ref"), F.try_divide(chi2, n * (m - 1)).alias("kendall_w"),
                    F.when(w_ref >= W_BANDS[1], "strong").when(w_ref >= W_BANDS[0], "medium")
                    .when(w_ref.isNotNull(), "weak").alias("strength"))
