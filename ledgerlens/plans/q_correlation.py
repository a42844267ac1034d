"""Correlation and trend queries (lineitem drivers; monthly sales series)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators.correlation import (collinearity_pairs, corr_insights, corr_kpis, corr_matrix,
                                              correlation_table, default_drivers, first_last_change,
                                              lagged_corr, rolling_corr, scatter_fit, spearman_recommended,
                                              trend_series)
from ledgerlens.plans.registry import SALES_FACT_SQL, register
from ledgerlens.plans.sqlgen import k2_pvalue_sql, t_p2_sql, valid_sql
from ledgerlens.sources.fixtures import sales_fact
from ledgerlens.sources.tables import load

Y = "l_extendedprice"
XS = ["l_quantity", "l_discount", "l_tax"]
Z975 = 1.959963984540054
STRENGTH_SQL = """CASE WHEN abs(r) < 0.1 THEN 'very_weak' WHEN abs(r) < 0.3 THEN 'weak' WHEN abs(r) < 0.5 THEN 'moderate'
     WHEN abs(r) < 0.7 THEN 'strong' WHEN abs(r) < 0.9 THEN 'very_strong' ELSE 'near_perfect' END"""


def _r9(*cols):
    return [F.round(c, 9).alias(c) for c in cols]


def _pair_where(x, drop_zero=False, log10=False):
    cond = f"{valid_sql(x)} AND {valid_sql(Y)}"
    if drop_zero:
        cond += f" AND {x} <> 0 AND {Y} <> 0"
    if log10:
        cond += f" AND {x} > 0 AND {Y} > 0"
    return cond


def _val(c, log10):
    return f"log10({c})" if log10 else c


def _pearson_sql(drop_zero=False, log10=False):
    parts = "\nUNION ALL ".join(
        f"SELECT '{x}' AS x, COUNT(*) AS n, corr({_val(x, log10)}, {_val(Y, log10)}) AS r FROM lineitem "
        f"WHERE {_pair_where(x, drop_zero, log10)}" for x in XS)
    return f"""WITH t AS ({parts}),
t2 AS (SELECT x, n, CASE WHEN n >= 3 AND NOT isnan(r) THEN r END AS r FROM t)
SELECT x, n, round(r, 9) AS r,
       round(CASE WHEN n > 3 AND abs(r) < 0.9999 THEN tanh(atanh(r) - {Z975} / sqrt(n - 3)) END, 9) AS ci_low,
       round(CASE WHEN n > 3 AND abs(r) < 0.9999 THEN tanh(atanh(r) + {Z975} / sqrt(n - 3)) END, 9) AS ci_high,
       round(abs(r), 9) AS abs_r, CASE WHEN r > 0 THEN 'positive' WHEN r < 0 THEN 'negative' END AS direction,
       {STRENGTH_SQL} AS strength
FROM t2"""


def _table_out(t):
    return t.select("x", "n", *_r9("r", "ci_low", "ci_high", "abs_r"), "direction", "strength")


@register("correlation_table", _pearson_sql())
def q_correlation_table(spark, sf_dir):
    """Pearson r, Fisher CI and strength of price against three drivers."""
    return _table_out(correlation_table(load(spark, sf_dir, "lineitem"), Y, XS, "pearson"))


@register("correlation_table_log", _pearson_sql(drop_zero=True, log10=True))
def q_correlation_table_log(spark, sf_dir):
    """Pearson on log10 values with zeros dropped per pair."""
    return _table_out(correlation_table(load(spark, sf_dir, "lineitem"), Y, XS, "pearson", drop_zero=True, log10=True))


_CORR_P_SQL = f"""WITH t AS ({_pearson_sql()}),
raw AS (""" + "\nUNION ALL ".join(f"SELECT '{x}' AS x, COUNT(*) AS m, corr({x}, {Y}) AS rr FROM lineitem WHERE {_pair_where(x)}"
                                   for x in XS) + f"""),
p AS (SELECT t.*, {t_p2_sql('rr * sqrt((m - 2) / (1 - rr * rr))', 'm - 2')} AS p FROM t JOIN raw USING (x))"""


@register("correlation_table_p", _CORR_P_SQL + """
SELECT x, n, r, round(p, 7) AS p_value, ci_low, ci_high, abs_r, direction, strength FROM p""")
def q_correlation_table_p(spark, sf_dir):
    """Pearson table including t-based p-values."""
    t = correlation_table(load(spark, sf_dir, "lineitem"), Y, XS, "pearson")
    return t.select("x", "n", F.round("r", 9).alias("r"), F.round("p_value", 7).alias("p_value"),
                    *_r9("ci_low", "ci_high", "abs_r"), "direction", "strength")


def _spearman_sql():
    parts = "\nUNION ALL ".join(f"""SELECT '{x}' AS x, COUNT(*) AS n, corr(rx, ry) AS r FROM (
  SELECT RANK() OVER (ORDER BY {x}) + (COUNT(*) OVER (PARTITION BY {x}) - 1) / 2.0 AS rx,
         RANK() OVER (ORDER BY {Y}) + (COUNT(*) OVER (PARTITION BY {Y}) - 1) / 2.0 AS ry
  FROM lineitem WHERE {_pair_where(x)})""" for x in XS)
    return f"""WITH t AS ({parts})
SELECT x, n, round(r, 9) AS r, round(abs(r), 9) AS abs_r,
       CASE WHEN r > 0 THEN 'positive' WHEN r < 0 THEN 'negative' END AS direction, {STRENGTH_SQL} AS strength FROM t"""


@register("correlation_spearman", _spearman_sql())
def q_correlation_spearman(spark, sf_dir):
    """Spearman rank correlation of price against three drivers (average ranks, all rows)."""
    t = correlation_table(load(spark, sf_dir, "lineitem"), Y, XS, "spearman")
    return t.select("x", "n", *_r9("r", "abs_r"), "direction", "strength")


@register("corr_kpis", _CORR_P_SQL + """
SELECT COUNT(*) AS n_x, MAX(n) AS max_n, MAX(abs_r) AS best_abs_r,
       round(AVG(CASE WHEN p < 0.05 THEN 100.0 ELSE 0.0 END), 9) AS pct_significant FROM p""")
def q_corr_kpis(spark, sf_dir):
    """Number of drivers, max n, strongest |r| and share significant."""
    k = corr_kpis(correlation_table(load(spark, sf_dir, "lineitem"), Y, XS, "pearson"))
    return k.select("n_x", "max_n", *_r9("best_abs_r", "pct_significant"))


@register("corr_insights", _CORR_P_SQL + """,
k AS (SELECT 'top_positive' AS kind, * FROM p WHERE r > 0 UNION ALL SELECT 'top_negative', * FROM p WHERE r < 0
      UNION ALL SELECT 'ci_crosses_zero', * FROM p WHERE ci_low < 0 AND ci_high > 0
      UNION ALL SELECT 'weak_but_significant', * FROM p WHERE abs_r < 0.3 AND p < 0.05),
o AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY abs_r DESC, x) AS rank FROM k)
SELECT kind, x, r, CAST(rank AS INTEGER) AS rank FROM o
WHERE rank <= CASE WHEN kind LIKE 'top%' THEN 3 ELSE 5 END""")
def q_corr_insights(spark, sf_dir):
    """Top positive/negative drivers, unstable CIs, weak-but-significant drivers."""
    i = corr_insights(correlation_table(load(spark, sf_dir, "lineitem"), Y, XS, "pearson"))
    return i.select("kind", "x", F.round("r", 9).alias("r"), "rank")


MCOLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


def _matrix_sql():
    pairs = [(a, b) for i, a in enumerate(MCOLS) for b in MCOLS[i + 1:]]
    where = " AND ".join(valid_sql(f"CAST({c} AS DOUBLE)") for c in MCOLS)
    up = "\nUNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM lw" for a, b in pairs)
    diag = "\nUNION ALL ".join(f"SELECT '{c}', '{c}', 1.0 FROM lw HAVING COUNT(*) >= 3" for c in MCOLS)
    return f"""WITH lw AS (SELECT * FROM lineitem WHERE {where}),
up AS ({up})
SELECT a, b, round(r, 9) AS r FROM up UNION ALL SELECT b, a, round(r, 9) FROM up
UNION ALL {diag}"""


@register("corr_matrix", _matrix_sql())
def q_corr_matrix(spark, sf_dir):
    """Listwise Pearson matrix of five lineitem columns (long form)."""
    m = corr_matrix(load(spark, sf_dir, "lineitem"), MCOLS)
    return m.select("a", "b", F.round("r", 9).alias("r"))


def _spearman_matrix_sql():
    where = " AND ".join(valid_sql(f"CAST({c} AS DOUBLE)") for c in MCOLS)
    ranks = ", ".join(f"RANK() OVER (ORDER BY {c}) + (COUNT(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in MCOLS)
    cells = "\nUNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {'max(1.0)' if a == b else f'round(corr({a}, {b}), 9)'} AS r FROM lw"
                                for a in MCOLS for b in MCOLS)
    return f"WITH lw AS (SELECT {ranks} FROM lineitem WHERE {where})\n{cells}"


@register("corr_matrix_spearman", _spearman_matrix_sql())
def q_corr_matrix_spearman(spark, sf_dir):
    """Listwise Spearman matrix of five lineitem columns (average ranks, all rows)."""
    m = corr_matrix(load(spark, sf_dir, "lineitem"), MCOLS, "spearman")
    return m.select("a", "b", F.round("r", 9).alias("r"))


SPARSE = {"o_totalprice": "o_totalprice", "n_open": "CASE WHEN o_orderstatus <> 'F' THEN o_totalprice * o_custkey END",
          "n_urgent": "CASE WHEN o_orderpriority <> '1-URGENT' THEN o_custkey END", "flat": "1.5"}


def _sparse_sql(rank: bool):
    """Pairs over their own complete rows; the constant column is left out."""
    names = [c for c in SPARSE if c != "flat"]
    view = ", ".join(f"CAST({e} AS DOUBLE) AS {c}" for c, e in SPARSE.items())
    of = (lambda c: f"RANK() OVER (ORDER BY {c}) + (COUNT(*) OVER (PARTITION BY {c}) - 1) / 2.0") if rank else (lambda c: c)
    cells = "\nUNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, {'max(1.0)' if a == b else 'round(corr(x, y), 9)'} AS r FROM "
        f"(SELECT {of(a)} AS x, {of(b)} AS y FROM v WHERE {a} IS NOT NULL AND {b} IS NOT NULL)" for a in names for b in names)
    return f"WITH v AS (SELECT {view} FROM orders)\n{cells}"


def _sparse(spark, sf_dir, method):
    v = load(spark, sf_dir, "orders").select(*[F.expr(e).cast("double").alias(c) for c, e in SPARSE.items()])
    return corr_matrix(v, list(SPARSE), method, listwise=False).select("a", "b", F.round("r", 9).alias("r"))


@register("corr_matrix_pairwise", _sparse_sql(False))
def q_corr_matrix_pairwise(spark, sf_dir):
    """Pearson matrix, each pair over its own complete rows, constant columns left out."""
    return _sparse(spark, sf_dir, "pearson")


@register("corr_matrix_pairwise_spearman", _sparse_sql(True))
def q_corr_matrix_pairwise_spearman(spark, sf_dir):
    """Spearman matrix, each pair ranked over its own complete rows."""
    return _sparse(spark, sf_dir, "spearman")


def _collin_sql():
    pairs = [(a, b) for i, a in enumerate(MCOLS) for b in MCOLS[i + 1:]]
    where = " AND ".join(valid_sql(f"CAST({c} AS DOUBLE)") for c in MCOLS)
    up = "\nUNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM lw" for a, b in pairs)
    return f"""WITH lw AS (SELECT * FROM lineitem WHERE {where}),
up AS ({up})
SELECT a AS x1, b AS x2, round(abs(r), 9) AS abs_r, abs(r) > 0.8 AS high FROM up
WHERE (SELECT COUNT(*) FROM lw) >= 5 ORDER BY abs(r) DESC, a, b LIMIT 10"""


@register("collinearity_pairs", _collin_sql())
def q_collinearity_pairs(spark, sf_dir):
    """Driver pairs by |r| with the >0.8 flag."""
    c = collinearity_pairs(load(spark, sf_dir, "lineitem"), MCOLS)
    return c.select("x1", "x2", F.round("abs_r", 9).alias("abs_r"), "high")


@register("scatter_fit", "\nUNION ALL ".join(
    f"""SELECT '{x}' AS x, COUNT(*) AS n, round(regr_slope({Y}, {x}), 9) AS slope,
       round(regr_intercept({Y}, {x}), 6) AS intercept, round(corr({x}, {Y}), 9) AS r
FROM lineitem WHERE {valid_sql(x)} AND {valid_sql(Y)}""" for x in XS))
def q_scatter_fit(spark, sf_dir):
    """Least-squares line of price on each driver (all rows)."""
    s = scatter_fit(load(spark, sf_dir, "lineitem"), Y, XS)
    return s.select("x", "n", F.round("slope", 9).alias("slope"), F.round("intercept", 6).alias("intercept"),
                    F.round("r", 9).alias("r"))


@register("default_drivers", "WITH v AS (" + "\nUNION ALL ".join(
    f"SELECT '{c}' AS x, var_samp({c}) AS variance FROM lineitem" for c in MCOLS) + """)
SELECT x, round(variance, 1) AS variance FROM v WHERE variance IS NOT NULL ORDER BY variance DESC, x LIMIT 3""")
def q_default_drivers(spark, sf_dir):
    """Three highest-variance numeric columns."""
    d = default_drivers(load(spark, sf_dir, "lineitem"), MCOLS, 3)
    return d.select("x", F.round("variance", 1).alias("variance"))


# ------------------------------------------------------------ trend
_SERIES_SQL = "WITH " + SALES_FACT_SQL + f""",
g AS (SELECT date_trunc('month', l_shipdate) AS period, SUM(l_extendedprice) AS y, SUM(l_quantity) AS x
      FROM sales_fact WHERE l_shipdate IS NOT NULL AND year(l_shipdate) BETWEEN 1900 AND 2100
        AND {valid_sql('l_extendedprice')} AND {valid_sql('l_quantity')} GROUP BY 1)"""


def _series(spark, sf_dir):
    return trend_series(sales_fact(spark, sf_dir), "l_shipdate", "l_extendedprice", "l_quantity", "sum", "sum", "M")


@register("trend_series", _SERIES_SQL + """
SELECT 'M' AS freq, period, round(y, 4) AS y, round(x, 4) AS x,
       round(y / FIRST_VALUE(y) OVER (ORDER BY period) * 100.0, 6) AS y_index,
       round(x / FIRST_VALUE(x) OVER (ORDER BY period) * 100.0, 6) AS x_index FROM g""")
def q_trend_series(spark, sf_dir):
    """Monthly revenue and quantity with index-100 series."""
    s = _series(spark, sf_dir)
    return s.select("freq", "period", F.round("y", 4).alias("y"), F.round("x", 4).alias("x"),
                    F.round("y_index", 6).alias("y_index"), F.round("x_index", 6).alias("x_index"))


@register("rolling_corr", _SERIES_SQL + """
SELECT period, round(CASE WHEN COUNT(y) OVER w = 6 THEN corr(y, x) OVER w END, 6) AS r FROM g
WINDOW w AS (ORDER BY period ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)""")
def q_rolling_corr(spark, sf_dir):
    """Six-month rolling Pearson r of revenue and quantity."""
    r = rolling_corr(_series(spark, sf_dir), 6)
    return r.select("period", F.round("r", 6).alias("r"))


@register("lagged_corr", _SERIES_SQL + """,
s AS (SELECT ROW_NUMBER() OVER (ORDER BY period) AS rn, y, x FROM g),
l AS (SELECT range AS lag FROM range(-6, 7)),
p AS (SELECT l.lag, COUNT(*) AS n, corr(a.y, b.x) AS r FROM l JOIN s a ON TRUE JOIN s b ON b.rn = a.rn - l.lag GROUP BY l.lag),
q AS (SELECT * FROM p WHERE n >= 3 AND r IS NOT NULL AND NOT isnan(r)),
len AS (SELECT COUNT(*) AS len FROM g)
SELECT CAST(lag AS INTEGER) AS lag, n, round(r, 6) AS r,
       round(CASE WHEN len - 6 > 4 THEN 2.0 / sqrt(len - 6) END, 9) AS bound,
       abs(r) = MAX(abs(r)) OVER () AS is_best
FROM q, len""")
def q_lagged_corr(spark, sf_dir):
    """Revenue vs quantity correlation for lags −6..6 with the ±2/√n band."""
    lc = lagged_corr(_series(spark, sf_dir), 6)
    return lc.select("lag", "n", F.round("r", 6).alias("r"), F.round("bound", 9).alias("bound"), "is_best")


@register("first_last_change", _SERIES_SQL + """
SELECT round((arg_max(y, period) / arg_min(y, period) - 1) * 100.0, 6) AS y_change_pct,
       round((arg_max(x, period) / arg_min(x, period) - 1) * 100.0, 6) AS x_change_pct FROM g""")
def q_first_last_change(spark, sf_dir):
    """Change from first to last month for revenue and quantity."""
    c = first_last_change(_series(spark, sf_dir))
    return c.select(F.round("y_change_pct", 6).alias("y_change_pct"), F.round("x_change_pct", 6).alias("x_change_pct"))


SR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _sr_sql():
    unions = "\nUNION ALL ".join(f"SELECT '{c}' AS col, {c} AS v FROM lineitem WHERE {valid_sql(c)}" for c in SR_COLS)
    return f"""WITH lv AS ({unions}),
mm AS (SELECT col, COUNT(v) AS n, AVG(v) AS mean, quantile_cont(v, 0.99) AS p99 FROM lv GROUP BY col),
cm AS (SELECT col, AVG(power(v - mean, 2)) AS m2, AVG(power(v - mean, 3)) AS m3, AVG(power(v - mean, 4)) AS m4,
              AVG(CASE WHEN v > p99 THEN 1.0 ELSE 0.0 END) AS tail_share FROM lv JOIN mm USING (col) GROUP BY col),
x AS (SELECT mm.col, n, m3 / power(m2, 1.5) AS g1, m4 / power(m2, 2) - 3.0 AS g2, tail_share FROM mm JOIN cm USING (col)),
y AS (SELECT *, CASE WHEN n > 20 THEN {k2_pvalue_sql('CAST(n AS DOUBLE)', 'g1', 'g2')} END AS pn FROM x WHERE n >= 50)
SELECT col AS "column", n, round(g1, 6) AS skew, round(g2, 6) AS kurt, round(tail_share, 9) AS tail_share,
       round(pn, 6) AS p_normal,
       (abs(g1) > 1 OR abs(g2) > 3 OR tail_share > 0.02 OR COALESCE(pn < 0.05, FALSE)) AS recommend FROM y"""


@register("spearman_recommended", _sr_sql())
def q_spearman_recommended(spark, sf_dir):
    """Per column: skew, kurtosis, tail share and normality behind the Spearman advice."""
    s = spearman_recommended(load(spark, sf_dir, "lineitem"), SR_COLS)
    return s.select("column", "n", F.round("skew", 6).alias("skew"), F.round("kurt", 6).alias("kurt"),
                    F.round("tail_share", 9).alias("tail_share"), F.round("p_normal", 6).alias("p_normal"), "recommend")
