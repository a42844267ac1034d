"""Hand-computed checks of operators on small frames."""

import math
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens.functions.clean import clean_time, normalize_text, to_numeric
from ledgerlens.operators.benford import benford, leading_digits
from ledgerlens.operators.hypothesis import _holm, friedman, kruskal
from ledgerlens.operators.pareto import abc_summary, concentration, pareto_abc
from ledgerlens.operators.profile import distribution_profile, histogram, kurtosistest_z, skewtest_z
from ledgerlens.operators.quality import data_quality
from ledgerlens.operators.ranks import grouped_quantiles, midranks


def test_to_numeric_dirty(spark):
    raw = ["1,234.50", " 7 ", "abc", "", "None", "null", "-3", "0", None, "NaN", "inf"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "id int, raw string")
    got = [r.v for r in df.orderBy("id").select(to_numeric("raw").alias("v")).collect()]
    assert got == [1234.5, 7.0, None, None, None, None, -3.0, 0.0, None, None, None]


def test_clean_time_ranges(spark):
    raw = ["2024-03-05", "1899-12-31", "2101-01-01", "2024-02-30", "zz", None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "id int, raw string")
    got = [r.t for r in df.orderBy("id").select(clean_time("raw").alias("t")).collect()]
    assert got[0].year == 2024 and got[1:] == [None] * 5


def test_normalize_text(spark):
    raw = ["A  b", " a B ", "a\tb", "", "   ", None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "id int, s string")
    got = [r.n for r in df.orderBy("id").select(normalize_text("s").alias("n")).collect()]
    assert got == ["a b", "a b", "a b", "", "", None]


def test_midranks_match_pandas(spark):
    vals = [3.0, 1.0, 3.0, 2.0, 5.0, 3.0, 1.0, 9.0, 2.0]
    df = spark.createDataFrame([(v,) for v in vals], "y double")
    got = {r.y: r.midrank for r in midranks(df, "y").collect()}
    expected = pd.Series(vals).rank(method="average")
    for v, r in zip(vals, expected):
        assert got[v] == r


@pytest.mark.parametrize("n", [1, 2, 7, 50])
def test_grouped_quantiles_match_numpy(spark, n):
    rng = np.random.default_rng(n)
    vals = np.round(rng.normal(size=n) * 10, 1)
    df = spark.createDataFrame([("a" if i % 3 else "b", float(v)) for i, v in enumerate(vals)], "g string, y double")
    probs = [0.0, 0.05, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = {r.g: r for r in grouped_quantiles(df, "y", probs, by=["g"]).collect()}
    pdf = pd.DataFrame({"g": ["a" if i % 3 else "b" for i in range(n)], "y": vals})
    for g, part in pdf.groupby("g"):
        for i, p in enumerate(probs):
            assert got[g][f"q{i}"] == pytest.approx(np.quantile(part.y, p), rel=1e-12, abs=1e-12)


@pytest.mark.parametrize("sketch", [20, 100_000])
def test_bracketed_quantiles_on_large_and_tied_groups(spark, monkeypatch, sketch):
    """With a coarse sketch only the values inside the brackets are ordered."""
    import ledgerlens.operators.ranks as ranks
    monkeypatch.setattr(ranks, "SKETCH", sketch)
    monkeypatch.setattr(ranks, "MARGIN", 2)
    rng = np.random.default_rng(0)
    vals = np.concatenate([rng.lognormal(size=3000), np.full(2000, 1.5), rng.integers(0, 5, 2000)])
    df = spark.createDataFrame([(float(v),) for v in vals], "y double").repartition(5)
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    row = grouped_quantiles(df, "y", probs).collect()[0]
    assert list(row) == pytest.approx(list(np.quantile(vals, probs)), rel=1e-12)


def test_leading_digits_edge_values(spark):
    vals = [0.0, -0.0, 5.0, 50.0, 0.05, 5e-7, 1e20, 0.1 + 0.2, -72.5, 1e15, 1e-5]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    rows = df.select("v", leading_digits(F.col("v"), 1).alias("d1"), leading_digits(F.col("v"), 2).alias("d2")).collect()
    for r in rows:
        ds = re.sub(r"[^0-9]", "", "%.15g" % abs(r.v)).lstrip("0")
        assert r.d1 == (int(ds[0]) if ds else None)
        assert r.d2 == (int(ds[:2]) if len(ds) >= 2 else None)


def test_benford_counts_sum_to_n(spark):
    df = spark.createDataFrame([(float(v),) for v in range(1, 500)], "v double")
    b = benford(df, "v", 1).collect()
    assert len(b) == 9
    assert sum(r.observed for r in b) == 499
    assert sum(r.expected_p for r in b) == pytest.approx(1.0)


def test_skew_and_kurtosis_tests_known_values(spark):
    def stats(vals):
        df = spark.createDataFrame([(float(v),) for v in vals], "v double")
        return df.agg(F.count("v").alias("n"), F.skewness("v").alias("g1"), F.kurtosis("v").alias("g2"))
    s1 = stats([2, 8, 0, 4, 1, 9, 9, 0]).select(skewtest_z(F.col("n"), F.col("g1")).alias("z")).first().z
    assert s1 == pytest.approx(0.446264, abs=1e-6)
    s2 = stats(range(20)).select(kurtosistest_z(F.col("n"), F.col("g2")).alias("z")).first().z
    assert s2 == pytest.approx(-1.705810, abs=1e-6)


def test_distribution_profile_small(spark):
    vals = [1.0, 2.0, 2.0, 3.0, 4.0, 100.0, None]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    p = distribution_profile(df, "v").first()
    s = pd.Series([v for v in vals if v is not None])
    assert p["count"] == 6 and p["missing"] == 1
    assert p["median"] == pytest.approx(s.median())
    assert p["mode"] == 2.0
    assert p["std"] == pytest.approx(s.std())
    q1, q3 = s.quantile(0.25), s.quantile(0.75)
    assert p["outliers"] == int(((s < q1 - 1.5 * (q3 - q1)) | (s > q3 + 1.5 * (q3 - q1))).sum())


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(1)
    vals = rng.gamma(2.0, 3.0, size=500)
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    got = [r.n for r in histogram(df, "v", 13).orderBy("bin").collect()]
    counts, _ = np.histogram(vals, bins=13)
    assert got == list(counts)


def test_pareto_edges(spark):
    rows = [("a", 90.0), ("b", 5.0), ("c", 5.0), ("d", 0.0), ("e", -3.0), (None, 7.0)]
    df = spark.createDataFrame(rows, "dim string, v double")
    p = {r.dim: r for r in pareto_abc(df, "dim", "v").collect()}
    assert set(p) == {"a", "b", "c"}            # non-positive and null keys removed
    assert p["a"]["class"] == "A"                # first item forced A though above 80 %
    assert p["b"]["rank"] == 2 and p["c"]["rank"] == 3   # tie broken by name
    assert p["c"]["cum_pct"] == pytest.approx(100.0)
    s = {r["class"]: r for r in abc_summary(pareto_abc(df, "dim", "v")).collect()}
    assert s["C"]["n"] == 1 and s["B"]["n"] == 1
    c = concentration(pareto_abc(df, "dim", "v")).first()
    shares = np.array([0.9, 0.05, 0.05])
    assert c.hhi == pytest.approx(float((shares ** 2).sum() * 10000))
    asc = np.sort(shares)
    n = len(asc)
    assert c.gini == pytest.approx(2 * np.sum(np.arange(1, n + 1) * asc) / (n * asc.sum()) - (n + 1) / n)
    cum = np.cumsum(np.sort(shares)[::-1])
    assert c.gini_ref == pytest.approx(1 - 2 * np.trapezoid(cum, np.arange(1, n + 1) / n))


def test_holm_adjustment(spark):
    pairs = spark.createDataFrame([("a", "b", 0.01), ("a", "c", 0.04), ("b", "c", 0.03)],
                                  "group_a string, group_b string, p_raw double")
    got = {(r.group_a, r.group_b): r.p_adj_holm for r in _holm(pairs).collect()}
    assert got[("a", "b")] == pytest.approx(0.03)
    assert got[("b", "c")] == pytest.approx(0.06)
    assert got[("a", "c")] == pytest.approx(0.06)


def test_kruskal_invariant_to_partitioning(spark):
    rng = np.random.default_rng(3)
    rows = [(str(g), float(round(v, 1))) for g in range(3) for v in rng.normal(g, 1, 40)]
    df = spark.createDataFrame(rows, "g string, y double")
    h1 = kruskal(df, "y", "g").first().h
    h7 = kruskal(df.repartition(7), "y", "g").first().h
    assert h1 == pytest.approx(h7, rel=1e-12)


def test_friedman_hand_computed(spark):
    rows = [(s, c, float(v)) for s, vals in enumerate([[1, 2, 3], [2, 3, 1], [1, 3, 2], [1, 2, 3]])
            for c, v in zip("xyz", vals)]
    df = spark.createDataFrame(rows, "id int, cond string, y double")
    r = friedman(df, "y", "id", "cond").first()
    ranks = {"x": 1 + 2 + 1 + 1, "y": 2 + 3 + 3 + 2, "z": 3 + 1 + 2 + 3}
    n, m = 4, 3
    chi2 = 12 / (n * m * (m + 1)) * sum(v * v for v in ranks.values()) - 3 * n * (m + 1)
    assert r.chi2 == pytest.approx(chi2)
    assert r.p_value == pytest.approx(math.exp(-chi2 / 2))


def test_data_quality_counts(spark):
    rows = [(1, "a", 0.0), (2, "  ", None), (3, None, 5.0), (4, "b", float("nan"))]
    df = spark.createDataFrame(rows, "id int, s string, v double")
    dq = {r.column: r for r in data_quality(df).collect()}
    assert dq["s"].type == "Text" and dq["s"].blank == 1 and dq["s"].valid == 2 and dq["s"].nan == 1
    assert dq["v"].type == "Numeric" and dq["v"].zero == 1 and dq["v"].nan == 2 and dq["v"].n_unique == 2


def test_exact_rank_tests_against_enumeration():
    import itertools

    from ledgerlens.functions.dist import mw_exact_p2, mw_test, rank_sum_counts, wilcoxon_exact_p2, wilcoxon_test

    for n1, n2 in ((1, 1), (3, 5), (5, 3), (4, 4), (2, 7)):
        us = [sum(c) - n1 * (n1 - 1) // 2 for c in itertools.combinations(range(n1 + n2), n1)]
        assert rank_sum_counts(n1, n2) == [us.count(u) for u in range(n1 * n2 + 1)]
        for u in range(n1 * n2 + 1):
            top = max(u, n1 * n2 - u)
            want = min(1.0, 2 * sum(x >= top for x in us) / len(us))
            assert mw_exact_p2(u, n1, n2) == pytest.approx(want)
            z, p = mw_test(u, -1.0, n1, n2, False)
            assert p == pytest.approx(want) and (p == 1.0 or 2 * (1 - 0.5 * math.erfc(-z / 2 ** 0.5)) == pytest.approx(p))
    for n in (1, 4, 9):
        sums = [sum(c) for k in range(n + 1) for c in itertools.combinations(range(1, n + 1), k)]
        for w in range(n * (n + 1) // 4 + 1):
            assert wilcoxon_exact_p2(w, n) == pytest.approx(min(1.0, 2 * sum(s <= w for s in sums) / 2 ** n))
    # ties, zeros and larger samples keep the normal form
    assert mw_test(10.0, 1.5, 4, 5, True)[0] == 1.5 and mw_test(10.0, 1.5, 9, 9, False)[0] == 1.5
    assert wilcoxon_test(3.0, 1.5, 8, False)[0] == 1.5 and wilcoxon_test(3.0, 1.5, 51, True)[0] == 1.5


def test_small_samples_are_exact(spark):
    from ledgerlens.operators.hypothesis import mann_whitney, wilcoxon

    rows = [("a", float(v)) for v in (1.1, 2.2, 3.3)] + [("b", float(v)) for v in (4.4, 5.5, 6.6, 0.5)]
    r = mann_whitney(spark.createDataFrame(rows, "g string, y double"), "y", "g").first()
    assert r.u == 9.0 and r.p_value == pytest.approx(2 * 7 / 35)      # U of b: 9 of 12
    rows = [(i, c, float(v)) for i, (x, y) in enumerate([(1, 3), (2, 5.5), (4, 3.5), (6, 9)]) for c, v in (("x", x), ("y", y))]
    r = wilcoxon(spark.createDataFrame(rows, "id int, c string, y double"), "y", "id", "c").first()
    assert r.w == 1.0 and r.p_value == pytest.approx(2 * 2 / 16)


def test_midranks_in_place_with_a_hot_value(spark):
    """One value on a third of the rows straddles partitions; no join on a value is in the plan."""
    from ledgerlens.operators.ranks import attach_midranks

    rng = np.random.default_rng(5)
    v = np.r_[np.full(1000, 7.0), rng.integers(0, 40, 1000), rng.normal(size=1000)]
    pdf = pd.DataFrame({"g": rng.choice(["a", "b"], 3000), "v": v, "z": rng.permutation(3000)})
    df = spark.createDataFrame(pdf).withColumn("w", F.lit(2))
    for by in ([], ["g"]):
        out = attach_midranks(df, "v", "r", by=by, weight="w", size="n", ties="t")
        got = out.toPandas()
        twice = pd.concat([got, got])
        of = twice.groupby("g").v if by else twice.v
        assert np.allclose(got.r, of.rank().iloc[:3000])
        assert (got.t == (twice.groupby([*by, "v"]).v.transform("size")).iloc[:3000]).all()
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join") == 1 and "_ll_pid" in plan[plan.index("Join"):].splitlines()[0]
    assert attach_midranks(df.where("false"), "v", "r").count() == 0


@pytest.mark.parametrize("counted", [False, True])
def test_quantile_brackets_are_narrowed(spark, monkeypatch, counted):
    """Rounds of pivots until a slot has at most ORDERED distinct values, in groups of any size."""
    from ledgerlens.operators import ranks

    for name, value in (("SKETCH", 100), ("MARGIN", 3), ("ORDERED", 16), ("PIVOTS", 3)):
        monkeypatch.setattr(ranks, name, value)
    held = []
    narrowed = ranks._narrowed
    monkeypatch.setattr(ranks, "_narrowed", lambda *a: held.append(narrowed(*a)) or held[-1])
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", "c"], 4000, p=[0.8, 0.19, 0.01]),
                        "v": np.r_[rng.normal(size=2500), np.full(1500, 0.25)]})
    df = spark.createDataFrame(pdf)
    if counted:
        df = df.groupBy("g", "v").agg(F.count(F.lit(1)).alias("w"))
    probs = [0.0, 0.01, 0.5, 0.77, 1.0]
    got = {r.g: r[1:] for r in grouped_quantiles(df, "v", probs, by=["g"], weight="w" if counted else None).collect()}
    want = pdf.groupby("g").v.quantile(probs).unstack()
    assert {g: pytest.approx(list(r)) for g, r in got.items()} == {g: list(want.loc[g]) for g in "abc"}
    # what a window orders: a slot's distinct values
    assert held[0].groupBy("g").agg(F.count("_v").alias("n")).agg(F.max("n")).first()[0] <= 16 * 2 * len(probs)


def test_matrix_of_many_columns(spark):
    """200 columns in one pass, equal to the pairwise form; constant columns and missing values."""
    from ledgerlens.operators.correlation import corr_matrix
    from ledgerlens.operators.gram import pair_sums

    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 200)) @ rng.normal(size=(200, 200)) * 0.05 + 1e6
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 7] = 3.0
    cols = [f"c{i}" for i in range(200)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=cols))
    clean = df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in cols])
    n, r = pair_sums(clean, cols)
    want = pd.DataFrame(x, columns=cols).corr()
    there = (~np.isnan(x)).astype(int)
    assert (n == there.T @ there).all()
    assert np.nanmax(np.abs(r - want.to_numpy())) < 1e-9 and np.isnan(r[7]).all()
    few = cols[:6] + ["c7"]
    got = {(a.a, a.b): a.r for a in corr_matrix(df, few, "spearman", listwise=False).collect()}
    rank = pd.DataFrame(x, columns=cols)[cols[:6]].corr("spearman")
    assert set(got) == {(a, b) for a in cols[:6] for b in cols[:6]}
    assert all(got[a, b] == pytest.approx(rank.loc[a, b]) for a, b in got)
