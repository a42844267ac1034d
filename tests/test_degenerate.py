"""Degenerate and hostile inputs: every statistic has a defined result, none is cut, none fails."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import correlation, filters, hypothesis, overview, regression
from ledgerlens.operators.benford import leading_digits
from ledgerlens.operators.quality import infer_column_types


def gy(spark, groups):
    return spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "g string, y double")


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_constant_groups(spark):
    df = gy(spark, {"a": [1, 1, 1], "b": [2, 2, 2], "c": [1, 2, 3]})
    flat = gy(spark, {"a": [1, 1], "b": [1, 1]})
    r = one(hypothesis.anova_oneway(df.where("g <> 'c'"), "y", "g"))
    assert r.f == math.inf and r.p_value == 0 and r.levene_p is None and r.best_group == "b"
    r = one(hypothesis.anova_oneway(flat, "y", "g"))
    assert r.f is None and r.p_value is None and r.eta2 is None and r.strength is None
    pairs = {(r.group_a, r.group_b): r for r in hypothesis.posthoc_welch_holm(df, "y", "g").collect()}
    assert set(pairs) == {("b", "a"), ("b", "c"), ("c", "a")}
    assert pairs[("b", "a")].p_raw is None and pairs[("b", "a")].p_adj_holm is None
    assert pairs[("c", "a")].p_adj_holm == pytest.approx(2 * pairs[("c", "a")].p_raw)
    r = one(hypothesis.welch_t(flat, "y", "g"))
    assert r.t is None and r.p_value is None


def test_all_tied(spark):
    flat = gy(spark, {"a": [4, 4, 4], "b": [4, 4]})
    assert one(hypothesis.kruskal(flat, "y", "g")).h is None
    r = one(hypothesis.mann_whitney(flat, "y", "g"))
    assert r.z is None and r.p_value is None and r.strength is None
    assert one(hypothesis.posthoc_mw_holm(flat, "y", "g")).p_adj_holm is None


@pytest.mark.parametrize("groups", [{"a": [1, 2, 3]}, {"a": [1, 2], "b": [2, 3], "c": [5, 6]}])
def test_two_group_tests_want_two_groups(spark, groups):
    df = gy(spark, groups)
    assert hypothesis.welch_t(df, "y", "g").count() == 0
    assert hypothesis.mann_whitney(df, "y", "g").count() == 0


def test_every_pair_is_returned(spark):
    df = spark.range(400).select((F.col("id") % 12).cast("string").alias("g"), F.rand(3).alias("y"))
    assert hypothesis.posthoc_welch_holm(df, "y", "g").count() == 55
    assert hypothesis.posthoc_mw_holm(df, "y", "g").count() == 55
    assert hypothesis.posthoc_welch_holm(df, "y", "g", k=5).count() == 5


def paired(spark, rows):
    return spark.createDataFrame([(i, c, float(v)) for i, c, v in rows], "id int, c string, y double")


def test_repeated_measures(spark):
    exact = paired(spark, [(i, c, i + {"a": 0, "b": 1, "c": 5}[c]) for i in range(4) for c in "abc"])
    r = one(hypothesis.anova_rm(exact, "y", "id", "c"))
    assert r.f == math.inf and r.p_value == 0 and r.n_subjects == 4
    flat = paired(spark, [(i, c, 1) for i in range(4) for c in "abc"])
    assert one(hypothesis.anova_rm(flat, "y", "id", "c")).f is None
    r = one(hypothesis.friedman(flat, "y", "id", "c"))
    assert r.chi2 is None and r.strength is None
    assert one(hypothesis.friedman(exact, "y", "id", "c")).chi2 == pytest.approx(8.0)
    assert hypothesis.friedman(exact.where("false"), "y", "id", "c").count() == 0


def test_wilcoxon_names_its_conditions(spark):
    df = paired(spark, [(i, c, i * k) for i in range(1, 7) for k, c in enumerate("abc", 1)])
    for bad in (df, df.where("c = 'a'")):
        with pytest.raises(ValueError):
            hypothesis.wilcoxon(bad, "y", "id", "c")
    assert one(hypothesis.wilcoxon(df, "y", "id", "c", pair=("a", "c"))).w == 0
    r = one(hypothesis.wilcoxon(paired(spark, [(1, "a", 1), (1, "b", 1)]), "y", "id", "c"))
    assert r.w is None and r.z is None and r.p_value is None
    got = {(r.group_a, r.group_b): r.w for r in hypothesis.posthoc_wilcoxon_holm(df, "y", "id", "c").collect()}
    assert got == {("a", "b"): 0, ("a", "c"): 0, ("b", "c"): 0}
    with pytest.raises(ValueError):
        hypothesis.posthoc_wilcoxon_holm(df, "y", "id", "c", max_conditions=2)


def test_twoway_matches_least_squares(spark):
    rng = np.random.default_rng(7)
    rows = [("pqr"[rng.integers(3)], "st"[rng.integers(2)], float(rng.normal())) for _ in range(60)]
    rows += [("z", None, 1.0)] * 80       # rows with a missing factor do not decide the kept levels
    df = spark.createDataFrame(rows, "a string, b string, y double")
    got = {r.term: r for r in hypothesis.anova_twoway(df, "y", "a", "b", top_a=3).collect()}
    rows = [r for r in rows if r[1]]
    y = np.array([r[2] for r in rows])
    da = np.array([[r[0] == k for k in "qr"] for r in rows], float)
    db = np.array([[r[1] == "t"] for r in rows], float)
    full = np.hstack([da, db, da * db])

    def rss(x):
        x = np.hstack([np.ones((len(y), 1)), x])
        return float(((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2).sum())
    both = rss(np.hstack([da, db]))
    assert got["A"].sum_sq == pytest.approx(rss(db) - both) and got["B"].sum_sq == pytest.approx(rss(da) - both)
    assert got["A:B"].sum_sq == pytest.approx(both - rss(full)) and got["Residual"].sum_sq == pytest.approx(rss(full))


def test_perfect_pair_and_constant_columns(spark):
    df = spark.createDataFrame([(float(k), 1.1 * k, -float(k), 3.0, None) for k in range(20)],
                               "net double, gross double, neg double, flat double, gap double")
    for method in ("pearson", "spearman"):
        got = {r.x: r for r in correlation.correlation_table(df, "net", ["gross", "neg", "flat", "gap"], method).collect()}
        assert got["gross"].r == pytest.approx(1) and got["neg"].r == pytest.approx(-1)
        assert got["gross"].p_value == pytest.approx(0) and got["flat"].r is None and got["gap"].r is None
        m = {(r.a, r.b): r.r for r in correlation.corr_matrix(df, df.columns, method, listwise=False).collect()}
        assert {a for a, _ in m} == {"net", "gross", "neg"} and m[("net", "neg")] == pytest.approx(-1)


def test_spearman_matches_pandas(spark):
    import pandas as pd

    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 5, 200).astype(float), rng.integers(0, 4, 200).astype(float)
    y += x * (rng.random(200) < 0.4)
    got = one(correlation.correlation_table(spark.createDataFrame(list(zip(x.tolist(), y.tolist())), "x double, y double"),
                                            "y", ["x"], "spearman"))
    assert got.r == pytest.approx(pd.Series(x).rank().corr(pd.Series(y).rank())) and got.n == 200


def test_spearman_recommended_takes_all_columns(spark):
    df = spark.range(60).select(*[(F.col("id") * (k + 1)).cast("double").alias(f"c{k}") for k in range(22)])
    assert correlation.spearman_recommended(df, df.columns).count() == 22


def test_first_period_of_zero(spark):
    df = spark.createDataFrame([(f"2024-{m:02d}-15", float(m - 1), float(m)) for m in range(1, 13)],
                               "t string, y double, x double").withColumn("t", F.to_timestamp("t"))
    got = correlation.trend_series(df, "t", "y", "x").orderBy("period").collect()
    assert got[0].y_index is None and got[1].x_index == pytest.approx(200)


def test_one_class_roc(spark):
    df = spark.createDataFrame([(1.0, 0.2), (1.0, 0.7)], "actual double, probability double")
    assert [(r.fpr, r.tpr) for r in regression.roc_curve(df).orderBy("threshold").collect()] == [(None, 1.0), (None, 0.5)]


def test_region_channel_levels(spark):
    df = spark.createDataFrame([("n", None, 1.0), ("n", "Other", 2.0), (None, "x'y", 3.0), ("s", "b", 0.5)],
                               "r string, c string, m double")
    got = {(r.region, r.channel): r.value for r in overview.region_channel(df, "r", "c", "m", 2).collect()}
    assert got[("n", "Other")] == 3.0 and got[("(NA)", "x'y")] == 3.0 and got[("s", "Other")] == 0.5
    assert len(got) == 3 * len({c for _, c in got})


def test_no_valid_date_and_long_lists(spark):
    df = spark.createDataFrame([("zz", 1), (None, 2)], "t string, v int")
    assert filters.year_scope(df, "t").count() == 0
    many = spark.range(5000).withColumn("id", F.col("id").cast("string"))
    assert filters.drilldown_filter(many, {"id": [str(k) for k in range(0, 1_200_000, 2)]}).count() == 2500


def test_types_are_read_from_all_rows(spark):
    df = spark.range(10_000).select(F.when(F.col("id") >= 4500, "2024-01-01").otherwise("x").alias("when"))
    r = one(infer_column_types(df).where("column = 'when'"))
    assert r.type == "Datetime" and r.parse_rate == pytest.approx(0.55)


def test_revenue_for_charts(spark):
    df = spark.createDataFrame([(None, 5.0), (2.0, 6.0)], "rev double, sales_b double")
    pick = lambda *a: [r[0] for r in df.select(filters.revenue_for_charts(df, *a)).collect()]
    assert pick("rev") == [0.0, 2.0] and pick("rev", "sales_b") == [5.0, 6.0]


def test_digit_carry_limit(spark):
    """The stated limit: a 16th digit 5 that carries through all fifteen."""
    df = spark.createDataFrame([(9.999999999999995,), (9.99999999999999,)], "v double")
    assert [r[0] for r in df.select(leading_digits(F.col("v"))).collect()] == [1, 9]


def test_stratified_split(spark):
    df = spark.range(1000).select("id", (F.col("id") % 10 == 0).cast("int").alias("k"))
    got = regression.train_test_split(df, "id", stratify="k")
    assert got.columns == ["id", "k", "is_test"] and got.count() == 1000
    assert {r.k: r.n for r in got.where("is_test").groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()} == {0: 180, 1: 20}


@pytest.mark.parametrize("name", ["group_summary", "anova_oneway", "kruskal", "mann_whitney", "posthoc_mw_holm"])
def test_the_fact_is_scanned_once(spark, tmp_path, name):
    """No scan of the fact is left in the result's plan: it was read once, for the counted table."""
    path = str(tmp_path / "fact")
    gy(spark, {"a": [1, 2, 4, 8], "b": [2, 3, 5]}).write.parquet(path)
    out = getattr(hypothesis, name)(spark.read.parquet(path), "y", "g")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" not in plan.lower()


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).selectExpr("id", "id % 3 as k", "'x' as other").write.parquet(path)
    df = filters.year_scope(spark.read.parquet(path).where("k = 1"), "id", "All").select("id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(k,1)" in plan and "other" not in plan


@pytest.mark.parametrize("digit", [2, 12])
def test_split_by_radix_descent(spark, monkeypatch, digit):
    """Exact shares per class whatever the digit size, a null class, repeated keys together, and no window over rows."""
    monkeypatch.setattr(regression, "DIGIT", digit)
    rows = [(k, "a" if k % 3 else ("b" if k % 2 else None)) for k in range(900)] + [(5000, "c")] * 5 + [(6000, "d")]
    got = regression.train_test_split(spark.createDataFrame(rows, "id long, g string"), "id", stratify="g").collect()
    tested = {}
    for r in got:
        tested.setdefault(r.g, []).append(r.is_test)
    assert {g: sum(v) for g, v in tested.items()} == {"a": 120, "b": 30, None: 30, "c": 5, "d": 0}
    from pyspark.sql.functions import xxhash64

    df = spark.createDataFrame([r for r in rows if r[1] == "a"], "id long, g string")
    first = [r.id for r in df.orderBy(xxhash64("id", F.lit(regression.SEED))).limit(120).collect()]
    assert {r.id for r in got if r.g == "a" and r.is_test} == set(first)
    many = spark.range(1200).selectExpr("id", "cast(id as string) as g")
    with pytest.raises(ValueError):
        regression.train_test_split(many, "id", stratify="g")
    assert regression.train_test_split(many.where("false"), "id", stratify="g").count() == 0


def test_logistic_against_gradient(spark):
    """The fitted coefficients make the gradient of the penalised loss vanish; both classes named by their values."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 3)) * [1, 5, 0.1] + [3, -2, 1000]
    y = np.where(x[:, 0] + 0.1 * x[:, 1] + rng.normal(size=400) > 3, 7.0, 2.0)
    df = spark.createDataFrame([(k, *map(float, r), float(v)) for k, (r, v) in enumerate(zip(x, y))],
                               "id long, a double, b double, c double, y double")
    fit = regression.fit_regression(df.repartition(5), "y", ["a", "b", "c"], "id", split="mod")
    train = np.arange(400) % 5 != 0
    z = (x - x[train].mean(axis=0)) / x[train].std(axis=0)
    c = {r.term: r.coef for r in fit.coefficients.collect()}
    theta = np.array([c["intercept"], c["a"], c["b"], c["c"]])
    full = np.column_stack([np.ones(400), z])
    p = 1 / (1 + np.exp(-full @ theta))
    t = (y == 7).astype(float)
    w = np.where(t == 1, train.sum() / (2 * t[train].sum()), train.sum() / (2 * (1 - t[train]).sum()))
    gradient = ((w * (p - t))[:, None] * full)[train].sum(axis=0) + np.r_[0, theta[1:]]
    assert np.abs(gradient).max() < 1e-8
    got = {r.id: (r.predicted, r.probability) for r in fit.predictions.collect()}
    assert set(got) == set(range(0, 400, 5))
    assert all(got[k] == (7.0 if p[k] > 0.5 else 2.0, pytest.approx(p[k])) for k in got)
    pos, neg = p[~train & (t == 1)], p[~train & (t == 0)]
    m = {r.metric: r.value for r in fit.metrics.collect()}
    assert m["auc"] == pytest.approx((pos[:, None] > neg).mean()) and m["accuracy"] == pytest.approx(((p > 0.5) == t)[~train].mean())
    scored = regression.score_scenarios(fit, df.select("id", "a", "b", "c").where("id < 3")).collect()
    assert [r.probability for r in sorted(scored, key=lambda r: r.id)] == pytest.approx(list(p[:3]))
    with pytest.raises(ValueError):
        regression.fit_regression(df.where("y = 7"), "y", ["a"], "id", kind="logistic")


def test_separated_classes_settle(spark):
    df = spark.createDataFrame([(k, float(k), float(k >= 50)) for k in range(100)], "id long, x double, y double")
    fit = regression.fit_regression(df, "y", ["x"], "id", split="mod")
    m = {r.metric: r.value for r in fit.metrics.collect()}
    assert m["auc"] == 1.0 and m["accuracy"] >= 0.95


def test_quality_of_a_hundred_columns(spark):
    """Distinct counts without an Expand, equal to plain ones: zeros of both signs, NaN, nulls, text, arrays and maps."""
    from ledgerlens.operators.quality import data_quality

    rng = np.random.default_rng(1)
    kinds = [lambda v: float(v) * (-0.0 if v == 0 else 1.0), lambda v: None if v % 3 == 0 else f"t{v}", lambda v: [v, v + 1],
             lambda v: float("nan") if v == 1 else v / 7]
    cols = [rng.integers(0, k + 1, 60) for k in range(100)]
    rows = [tuple(kinds[k % 4](int(c[i])) for k, c in enumerate(cols)) for i in range(60)]
    ddl = ", ".join(f"c{k} {('double', 'string', 'array<int>', 'double')[k % 4]}" for k in range(100))
    out = data_quality(spark.createDataFrame(rows, ddl).withColumn("m", F.create_map(F.lit("k"), "c0")))
    assert "Expand" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r.column: r.n_unique for r in out.collect()}
    for k in range(100):
        seen = {str(r[k]).replace("-0.0", "0.0") for r in rows if r[k] is not None and r[k] == r[k]}
        assert got[f"c{k}"] == len(seen)
    assert got["m"] == got["c0"]


def test_capped_drilldown_is_the_window(spark):
    from ledgerlens.operators.benford import benford_drilldown

    df = spark.range(3000).select("id", ((F.col("id") % 50) + 100).cast("double").alias("v"))
    out = benford_drilldown(df, "v", 1, cap=40, order=["v", "id"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "_part" in plan
    want = sorted((int(r.v), r.id) for r in df.collect())[:40]
    assert sorted((int(r.v), r.id) for r in out.collect()) == want
    assert out.columns == ["id", "v", "digit"]
