"""Regression queries: linear (lineitem price) and logistic (large orders)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators.regression import (confusion_matrix, fit_regression, regression_type, residual_audit,
                                             residual_risk, roc_curve, score_scenarios, train_test_split)
from ledgerlens.plans.registry import register
from ledgerlens.plans.sqlgen import valid_sql
from ledgerlens.sources.fixtures import binary_orders
from ledgerlens.sources.tables import load

LIN_X = ["l_quantity", "l_discount", "l_tax"]
LOG_X = ["n_lines", "sum_qty", "avg_discount"]

BINARY_ORDERS_SQL = """WITH med AS (SELECT quantile_cont(o_totalprice, 0.5) AS m FROM orders),
lines AS (SELECT l_orderkey, COUNT(*) AS n_lines, SUM(l_quantity) AS sum_qty, AVG(l_discount) AS avg_discount
          FROM lineitem GROUP BY 1),
bo AS (SELECT o_orderkey, CAST(o_totalprice > m AS INTEGER) AS is_large, n_lines, sum_qty, avg_discount
       FROM orders CROSS JOIN med JOIN lines ON lines.l_orderkey = orders.o_orderkey)"""


@register("regression_type", BINARY_ORDERS_SQL + """
SELECT CAST(MIN(is_large) AS DOUBLE) AS lo, CAST(MAX(is_large) AS DOUBLE) AS hi, 0 AS n_between,
       CASE WHEN COUNT(DISTINCT is_large) = 2 THEN 'logistic' ELSE 'linear' END AS kind FROM bo""")
def q_regression_type(spark, sf_dir):
    """Target kind of the large-order flag (binary → logistic)."""
    return regression_type(binary_orders(spark, sf_dir), "is_large")


@register("regression_type_linear", """
SELECT lo, hi, (SELECT COUNT(*) FROM lineitem WHERE l_extendedprice > lo AND l_extendedprice < hi) AS n_between,
       CASE WHEN (SELECT COUNT(DISTINCT l_extendedprice) FROM lineitem) = 2 THEN 'logistic' ELSE 'linear' END AS kind
FROM (SELECT MIN(l_extendedprice) AS lo, MAX(l_extendedprice) AS hi FROM lineitem)""")
def q_regression_type_linear(spark, sf_dir):
    """Target kind of the extended price (continuous → linear)."""
    return regression_type(load(spark, sf_dir, "lineitem"), "l_extendedprice")


@register("train_test_split", """
SELECT o_orderkey, o_orderkey % 5 = 0 AS is_test FROM orders""")
def q_train_test_split(spark, sf_dir):
    """Fold membership of every order (key mod 5)."""
    return train_test_split(load(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", method="mod")


@register("train_test_split_stratified", BINARY_ORDERS_SQL + """
SELECT is_large, COUNT(*) AS n, CAST(round(COUNT(*) / 5.0) AS BIGINT) AS n_test FROM bo GROUP BY is_large""")
def q_train_test_split_stratified(spark, sf_dir):
    """Stratified hash split of large/small orders: rows and test rows per class."""
    s = train_test_split(binary_orders(spark, sf_dir), "o_orderkey", stratify="is_large")
    return s.groupBy("is_large").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("is_test").cast("long")).alias("n_test"))


def _linear_one(spark, sf_dir):
    return fit_regression(load(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_quantity"], "l_orderkey",
                          kind="linear", split="mod")


def _lines(spark, sf_dir):
    """Lines under one unique number each."""
    return load(spark, sf_dir, "lineitem").withColumn("line", F.col("l_orderkey") * 10 + F.col("l_linenumber"))


def _linear_line(spark, sf_dir):
    return fit_regression(_lines(spark, sf_dir), "l_extendedprice", ["l_quantity"], "line", kind="linear", split="mod")


LINE_FIT_SQL = f"""WITH d AS (SELECT l_orderkey * 10 + l_linenumber AS line, l_quantity AS x, l_extendedprice AS y,
                  (l_orderkey * 10 + l_linenumber) % 5 = 0 AS is_test
           FROM lineitem WHERE {valid_sql('l_quantity')} AND {valid_sql('l_extendedprice')}),
fit AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM d WHERE NOT is_test),
e AS (SELECT line, y AS actual, a + b * x AS predicted, y - (a + b * x) AS error FROM d, fit WHERE is_test)"""


@register("linear_regression", f"""
WITH d AS (SELECT l_quantity AS x, l_extendedprice AS y, l_orderkey % 5 = 0 AS is_test FROM lineitem
           WHERE {valid_sql('l_quantity')} AND {valid_sql('l_extendedprice')}),
fit AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM d WHERE NOT is_test),
t AS (SELECT AVG(y) AS my FROM d WHERE is_test),
r2 AS (SELECT 1 - SUM(power(y - (a + b * x), 2)) / SUM(power(y - my, 2)) AS r2 FROM d, fit, t WHERE is_test)
SELECT 'intercept' AS term, round(a, 2) AS value FROM fit
UNION ALL SELECT 'l_quantity', round(b, 4) FROM fit
UNION ALL SELECT 'r2', round(r2, 9) FROM r2""")
def q_linear_regression(spark, sf_dir):
    """OLS of price on quantity fitted on four folds: raw intercept, slope and test R²."""
    fit = _linear_one(spark, sf_dir)
    c = fit.coefficients.select("term", F.when(F.col("term") == "intercept", F.round("coef_raw", 2))
                                .otherwise(F.round("coef_raw", 4)).alias("value"))
    r2 = fit.metrics.where(F.col("metric") == "r2").select(F.lit("r2").alias("term"), F.round("value", 9).alias("value"))
    return c.unionByName(r2)


def _linear_multi(spark, sf_dir):
    return fit_regression(load(spark, sf_dir, "lineitem"), "l_extendedprice", LIN_X, "l_orderkey", kind="linear", split="mod")


def _logistic(spark, sf_dir):
    return fit_regression(binary_orders(spark, sf_dir), "is_large", LOG_X, "o_orderkey", split="mod")


def _solve_sql(source: str, k: int, carry: str) -> str:
    """SELECT of ``carry`` and x0 .. x(k-1) with H x = g, from one-row-a-system columns h{i}_{j} (i <= j) and g{i}:
    elimination, one nested query a column, then back-substitution."""
    h = lambda i, j: f"h{min(i, j)}_{max(i, j)}"
    sql = f"SELECT * FROM {source}"
    for p in range(k - 1):
        new = [f"{h(i, j)} - {h(p, i)} * {h(p, j)} / {h(p, p)} AS {h(i, j)}" for i in range(p + 1, k) for j in range(i, k)]
        new += [f"g{i} - {h(p, i)} * g{p} / {h(p, p)} AS g{i}" for i in range(p + 1, k)]
        sql = f"SELECT * REPLACE ({', '.join(new)}) FROM ({sql})"
    for p in reversed(range(k)):
        known = "".join(f" - {h(p, j)} * x{j}" for j in range(p + 1, k))
        sql = f"SELECT *, (g{p}{known}) / {h(p, p)} AS x{p} FROM ({sql})"
    return f"SELECT {carry}, {', '.join(f'x{i}' for i in range(k))} FROM ({sql})"


def _lin_multi_sql() -> str:
    d = ", ".join(f"{x} AS x{i}" for i, x in enumerate(LIN_X))
    where = " AND ".join(valid_sql(c) for c in [*LIN_X, "l_extendedprice"])
    k = len(LIN_X)
    means = ", ".join(f"AVG(x{i}) AS m{i}, STDDEV_POP(x{i}) AS s{i}" for i in range(k))
    cov = [f"SUM((x{i} - m{i}) * (x{j} - m{j})) AS h{i}_{j}" for i in range(k) for j in range(i, k)]
    cov += [f"SUM((x{i} - m{i}) * (y - my)) AS g{i}" for i in range(k)]
    fit = " + ".join(f"b.x{i} * (d.x{i} - m{i})" for i in range(k))
    return f"""WITH d AS (SELECT l_orderkey % 5 = 0 AS is_test, l_extendedprice AS y, {d} FROM lineitem WHERE {where}),
m AS (SELECT AVG(y) AS my, {means} FROM d WHERE NOT is_test),
h AS (SELECT {', '.join(cov)} FROM d, m WHERE NOT is_test),
b AS ({_solve_sql('h', k, '1 AS one')}),
e AS (SELECT y, y - my - ({fit}) AS error FROM d, m, b WHERE is_test)"""


def _newton_sql(steps: int = 15) -> str:
    """Newton steps of the class-balanced L2 logistic model by a recursive CTE: z are standardised features, z0 = 1."""
    k = len(LOG_X)
    sums = [f"SUM(w * p * (1 - p) * z{i} * z{j}) + {1.0 if i == j and i else 0.0} AS h{i}_{j}" for i in range(k + 1) for j in range(i, k + 1)]
    sums += [f"SUM(w * (y - p) * z{i}) - {f't{i}' if i else '0.0'} AS g{i}" for i in range(k + 1)]
    t = [f"t{i}" for i in range(k + 1)]
    line = lambda t_: " + ".join(f"{t_}{i} * z{i}" for i in range(k + 1))
    source = f"""(SELECT it, {', '.join(t)}, {', '.join(sums)} FROM (SELECT f.*, z.*, 1 / (1 + exp(-({line('f.t')}))) AS p FROM f, z
    WHERE it < {steps} AND NOT is_test) GROUP BY it, {', '.join(t)})"""
    return BINARY_ORDERS_SQL.replace("WITH med", "WITH RECURSIVE med") + f""",
d AS (SELECT o_orderkey, is_large AS y, o_orderkey % 5 = 0 AS is_test, {', '.join(f'CAST({x} AS DOUBLE) AS x{i}' for i, x in enumerate(LOG_X))} FROM bo),
m AS (SELECT {', '.join(f'AVG(x{i}) AS m{i}, STDDEV_POP(x{i}) AS s{i}' for i in range(k))}, AVG(y) AS share FROM d WHERE NOT is_test),
z AS (SELECT o_orderkey, y, is_test, CASE WHEN y = 1 THEN 0.5 / share ELSE 0.5 / (1 - share) END AS w, 1.0 AS z0,
             {', '.join(f'(x{i} - m{i}) / s{i} AS z{i + 1}' for i in range(k))} FROM d, m),
f(it, {', '.join(t)}) AS (SELECT 0, {', '.join('CAST(0 AS DOUBLE)' for _ in t)} UNION ALL
  SELECT it + 1, {', '.join(f't{i} + x{i}' for i in range(k + 1))} FROM ({_solve_sql(source, k + 1, 'it, ' + ', '.join(t))})),
b AS (SELECT * FROM f WHERE it = {steps}),
sc AS (SELECT o_orderkey, y, 1 / (1 + exp(-({line('b.t')}))) AS p FROM z, b WHERE is_test)"""


@register("linear_regression_metrics", LINE_FIT_SQL + """,
m AS (SELECT 1 - SUM(error * error) / SUM(power(actual - (SELECT AVG(actual) FROM e), 2)) AS r2,
             sqrt(AVG(error * error)) AS rmse, AVG(abs(error)) AS mae FROM e)
SELECT 'r2' AS metric, round(r2, 6) AS value FROM m UNION ALL SELECT 'rmse', round(rmse, 4) FROM m
UNION ALL SELECT 'mae', round(mae, 4) FROM m""")
def q_linear_regression_metrics(spark, sf_dir):
    """R², RMSE and MAE of price on quantity (line number mod 5)."""
    m = _linear_line(spark, sf_dir).metrics
    return m.select("metric", F.when(F.col("metric") == "r2", F.round("value", 6)).otherwise(F.round("value", 4))
                    .alias("value"))


@register("linear_regression_metrics_multi", _lin_multi_sql() + """,
m2 AS (SELECT 1 - SUM(error * error) / SUM(power(y - (SELECT AVG(y) FROM e), 2)) AS r2, sqrt(AVG(error * error)) AS rmse, AVG(abs(error)) AS mae FROM e)
SELECT 'r2' AS metric, round(r2, 6) AS value FROM m2 UNION ALL SELECT 'rmse', round(rmse, 4) FROM m2 UNION ALL SELECT 'mae', round(mae, 4) FROM m2""")
def q_linear_regression_metrics_multi(spark, sf_dir):
    """R², RMSE and MAE of price on three drivers (order number mod 5)."""
    m = _linear_multi(spark, sf_dir).metrics
    return m.select("metric", F.when(F.col("metric") == "r2", F.round("value", 6)).otherwise(F.round("value", 4)).alias("value"))


@register("linear_coefficients", _lin_multi_sql() + """
SELECT 'intercept' AS term, round(my, 3) AS coef, round(my - (""" + " + ".join(f"x{i} * m{i}" for i in range(len(LIN_X))) + """), 3) AS coef_raw FROM b, m
""" + "\n".join(f"UNION ALL SELECT '{x}', round(x{i} * s{i}, 3), round(x{i}, 3) FROM b, m" for i, x in enumerate(LIN_X)))
def q_linear_coefficients(spark, sf_dir):
    """Standardised and raw coefficients of the three-driver price model."""
    return _linear_multi(spark, sf_dir).coefficients.select("term", F.round("coef", 3).alias("coef"), F.round("coef_raw", 3).alias("coef_raw"))


@register("logistic_regression", _newton_sql() + """,
rk AS (SELECT y, p, RANK() OVER (ORDER BY round(p, 12)) + (COUNT(*) OVER (PARTITION BY round(p, 12)) - 1) / 2.0 AS r FROM sc),
a AS (SELECT AVG(CASE WHEN (p > 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END) AS accuracy, SUM(y) AS n1, COUNT(*) - SUM(y) AS n0,
             SUM(CASE WHEN y = 1 THEN r END) AS r1 FROM rk)
SELECT 'accuracy' AS metric, round(accuracy, 6) AS value FROM a
UNION ALL SELECT 'auc', round((r1 - n1 * (n1 + 1) / 2.0) / (CAST(n1 AS DOUBLE) * n0), 6) FROM a""")
def q_logistic_regression(spark, sf_dir):
    """Accuracy and ROC-AUC of the class-balanced logistic model for large orders."""
    return _logistic(spark, sf_dir).metrics.select("metric", F.round("value", 6).alias("value"))


@register("logistic_coefficients", _newton_sql() + """
SELECT 'intercept' AS term, round(t0, 6) AS coef FROM b
""" + "\n".join(f"UNION ALL SELECT '{x}', round(t{i + 1}, 6) FROM b" for i, x in enumerate(LOG_X)))
def q_logistic_coefficients(spark, sf_dir):
    """Log-odds coefficients of the large-order model by |coef|."""
    return _logistic(spark, sf_dir).coefficients.select("term", F.round("coef", 6).alias("coef"))


@register("residual_audit", LINE_FIT_SQL + """
SELECT line, actual, round(predicted, 4) AS predicted, round(error, 4) AS error FROM e ORDER BY abs(error) DESC, line LIMIT 50""")
def q_residual_audit(spark, sf_dir):
    """50 test lines with the largest price residuals."""
    r = residual_audit(_linear_line(spark, sf_dir).predictions, "line", 50)
    return r.select("line", "actual", F.round("predicted", 4).alias("predicted"), F.round("error", 4).alias("error"))


@register("residual_risk", LINE_FIT_SQL + """,
s AS (SELECT AVG(abs(error)) AS mae, AVG(error) AS mean, STDDEV_SAMP(error) AS sigma, COUNT(*) AS n FROM e)
SELECT round(mae, 4) AS mae, round(mean, 4) AS mean, round(sigma, 4) AS sigma, round(2 * sigma, 4) AS threshold,
       (SELECT COUNT(*) FROM e, s WHERE abs(error) >= 2 * sigma) AS n_high,
       round((SELECT COUNT(*) FROM e, s WHERE abs(error) >= 2 * sigma) * 100.0 / n, 6) AS pct_high FROM s""")
def q_residual_risk(spark, sf_dir):
    """Residual MAE, mean, σ and share beyond 2σ."""
    r = residual_risk(_linear_line(spark, sf_dir).predictions)
    return r.select(*[F.round(c, 4).alias(c) for c in ("mae", "mean", "sigma", "threshold")], "n_high",
                    F.round("pct_high", 6).alias("pct_high"))


def _scored_orders(spark, sf_dir):
    """Orders with a fixed score (share of a large total quantity) in place of a model's."""
    return binary_orders(spark, sf_dir).select(
        "o_orderkey", F.col("is_large").cast("double").alias("actual"),
        F.round(F.least(F.col("sum_qty") / 300.0, F.lit(1.0)), 2).alias("probability"),
        (F.col("sum_qty") >= 150).cast("double").alias("predicted"))


_SCORED_SQL = BINARY_ORDERS_SQL + """,
sc AS (SELECT CAST(is_large AS DOUBLE) AS actual, round(least(sum_qty / 300.0, 1.0), 2) AS probability,
              CAST(sum_qty >= 150 AS DOUBLE) AS predicted FROM bo)"""


@register("roc_curve", _SCORED_SQL + """,
p AS (SELECT probability AS threshold, SUM(actual) AS tp, SUM(1 - actual) AS fp FROM sc GROUP BY 1)
SELECT threshold, round(SUM(fp) OVER (ORDER BY threshold DESC) / SUM(fp) OVER (), 9) AS fpr,
       round(SUM(tp) OVER (ORDER BY threshold DESC) / SUM(tp) OVER (), 9) AS tpr FROM p""")
def q_roc_curve(spark, sf_dir):
    """ROC points of a fixed score of orders."""
    r = roc_curve(_scored_orders(spark, sf_dir))
    return r.select("threshold", F.round("fpr", 9).alias("fpr"), F.round("tpr", 9).alias("tpr"))


@register("roc_curve_model", _newton_sql() + """,
pt AS (SELECT round(p, 6) AS threshold, SUM(y) AS tp, SUM(1 - y) AS fp FROM sc GROUP BY 1)
SELECT threshold, round(SUM(fp) OVER (ORDER BY threshold DESC) / SUM(fp) OVER (), 9) AS fpr,
       round(SUM(tp) OVER (ORDER BY threshold DESC) / SUM(tp) OVER (), 9) AS tpr FROM pt""")
def q_roc_curve_model(spark, sf_dir):
    """ROC points of the large-order model (probabilities to 6 places) on the test fold."""
    scored = _logistic(spark, sf_dir).predictions.withColumn("probability", F.round("probability", 6))
    r = roc_curve(scored)
    return r.select("threshold", F.round("fpr", 9).alias("fpr"), F.round("tpr", 9).alias("tpr"))


@register("confusion_matrix", _SCORED_SQL + """
SELECT actual AS label, predicted AS prediction, COUNT(*) AS n FROM sc GROUP BY 1, 2""")
def q_confusion_matrix(spark, sf_dir):
    """Actual x predicted counts of a fixed rule on orders."""
    return confusion_matrix(_scored_orders(spark, sf_dir))


@register("confusion_matrix_model", _newton_sql() + """
SELECT CAST(y AS DOUBLE) AS label, CAST(p > 0.5 AS DOUBLE) AS prediction, COUNT(*) AS n FROM sc GROUP BY 1, 2""")
def q_confusion_matrix_model(spark, sf_dir):
    """Actual x predicted counts of the large-order model."""
    return confusion_matrix(_logistic(spark, sf_dir).predictions)


@register("score_scenarios", LINE_FIT_SQL + """,
m AS (SELECT AVG(l_extendedprice) AS m FROM lineitem),
s AS (SELECT l_returnflag, AVG(l_quantity) AS l_quantity FROM lineitem GROUP BY 1)
SELECT l_returnflag, round(l_quantity, 6) AS l_quantity, round(a + b * l_quantity, 4) AS prediction,
       round(a + b * l_quantity - m, 4) AS diff, round((a + b * l_quantity - m) / m * 100.0, 6) AS diff_pct FROM s, fit, m""")
def q_score_scenarios(spark, sf_dir):
    """Score per-return-flag average lines (what-if scenarios) with the price model."""
    li = load(spark, sf_dir, "lineitem")
    scen = li.groupBy("l_returnflag").agg(F.avg("l_quantity").alias("l_quantity"))
    mean_y = li.agg(F.avg("l_extendedprice")).first()[0]
    out = score_scenarios(_linear_line(spark, sf_dir), scen, mean_y)
    return out.select("l_returnflag", F.round("l_quantity", 6).alias("l_quantity"), F.round("prediction", 4)
                      .alias("prediction"), F.round("diff", 4).alias("diff"), F.round("diff_pct", 6).alias("diff_pct"))
