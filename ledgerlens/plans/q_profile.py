"""Data quality, distribution profile and Benford queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators.benford import (benford, benford_drilldown, benford_quality, benford_ready,
                                          benford_summary)
from ledgerlens.operators.profile import (PROFILE_NAMES, category_freq, distribution_profile, histogram,
                                          numeric_profile, profile_verdicts, tukey_outliers)
from ledgerlens.operators.quality import data_quality, infer_column_types
from ledgerlens.plans.registry import register
from ledgerlens.plans.sqlgen import chi2_even_sf_sql, chi2_sf_sql, digits_sql, k2_pvalue_sql, valid_sql
from ledgerlens.sources.tables import load

R6 = 6


def _r(cols, d=R6):
    return [F.round(c, d).alias(c) for c in cols]


# ------------------------------------------------------------ data quality
def _dirty_orders(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    return o.select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority",
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit("   ")).otherwise(F.col("o_orderstatus")).alias("status_text"),
        (F.col("o_totalprice") > 100000).alias("is_big"),
        F.when(F.col("o_orderstatus") == "F", F.lit(None)).otherwise(F.col("o_totalprice")).alias("price_gaps"),
        F.when(F.col("o_orderstatus") == "O", F.lit(0.0)).otherwise(F.col("o_totalprice")).alias("price_zeros"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("ship_date_text"))


_DQ_COLS = [("o_orderkey", "Numeric"), ("o_custkey", "Numeric"), ("o_orderstatus", "Text"),
            ("o_totalprice", "Numeric"), ("o_orderdate", "Datetime"), ("o_orderpriority", "Text"),
            ("status_text", "Text"), ("is_big", "Boolean"), ("price_gaps", "Numeric"),
            ("price_zeros", "Numeric"), ("ship_date_text", "Datetime")]


def _dq_sql():
    src = """WITH d AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority,
  CASE WHEN o_orderpriority = '5-LOW' THEN '   ' ELSE o_orderstatus END AS status_text,
  o_totalprice > 100000 AS is_big,
  CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_totalprice END AS price_gaps,
  CASE WHEN o_orderstatus = 'O' THEN 0.0 ELSE o_totalprice END AS price_zeros,
  strftime(o_orderdate, '%Y-%m-%d') AS ship_date_text FROM orders)
"""
    parts = []
    for c, kind in _DQ_COLS:
        nn = f"COUNT({c})"
        blank = f"COUNT(CASE WHEN trim(CAST({c} AS VARCHAR)) = '' THEN 1 END)" if kind == "Text" else "CAST(NULL AS BIGINT)"
        zero = f"COUNT(CASE WHEN {c} = 0 THEN 1 END)" if kind == "Numeric" else "CAST(NULL AS BIGINT)"
        valid = f"({nn} - {blank})" if kind == "Text" else nn
        parts.append(f"""SELECT '{c}' AS column, '{kind}' AS type, COUNT(*) AS n_rows, {valid} AS valid,
  round({valid} / COUNT(*), 4) AS valid_pct, COUNT(*) - {nn} AS nan, round((COUNT(*) - {nn}) / COUNT(*), 4) AS nan_pct,
  {blank} AS blank, round({blank} / COUNT(*), 4) AS blank_pct, {zero} AS zero, round({zero} / COUNT(*), 4) AS zero_pct,
  COUNT(DISTINCT {c}) AS n_unique FROM d""")
    return src + "\nUNION ALL\n".join(parts)


@register("data_quality", _dq_sql())
def q_data_quality(spark, sf_dir):
    """Per-column quality profile of orders with blank, missing and zero variants."""
    return data_quality(_dirty_orders(spark, sf_dir))


@register("infer_column_types", """
WITH h AS (SELECT strftime(ts, '%Y-%m-%d') AS day_text, props, event_type FROM events),
r AS (SELECT avg(CASE WHEN TRY_CAST(day_text AS TIMESTAMP) IS NOT NULL THEN 1.0 ELSE 0.0 END) AS r_day,
             avg(CASE WHEN TRY_CAST(props AS TIMESTAMP) IS NOT NULL THEN 1.0 ELSE 0.0 END) AS r_props,
             avg(CASE WHEN TRY_CAST(event_type AS TIMESTAMP) IS NOT NULL THEN 1.0 ELSE 0.0 END) AS r_type FROM h)
SELECT 'event_id' AS column, 'Numeric' AS type, CAST(NULL AS DOUBLE) AS parse_rate
UNION ALL SELECT 'ts', 'Datetime', NULL
UNION ALL SELECT 'user_id', 'Numeric', NULL
UNION ALL SELECT 'value', 'Numeric', NULL
UNION ALL SELECT 'day_text', CASE WHEN r_day >= 0.5 THEN 'Datetime' ELSE 'Text' END, r_day FROM r
UNION ALL SELECT 'props', CASE WHEN r_props >= 0.5 THEN 'Datetime' ELSE 'Text' END, r_props FROM r
UNION ALL SELECT 'event_type', CASE WHEN r_type >= 0.5 THEN 'Datetime' ELSE 'Text' END, r_type FROM r""")
def q_infer_column_types(spark, sf_dir):
    """Column types of events plus a text column of dates (parse-rate rule)."""
    e = load(spark, sf_dir, "events")
    df = e.select("event_id", "ts", "user_id", "value", F.date_format("ts", "yyyy-MM-dd").alias("day_text"),
                  "props", "event_type")
    return infer_column_types(df)


# ------------------------------------------------------------ profiles
_NP_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _moments_sql(src: str, by: str | None, value: str = "v") -> str:
    """CTE text: per group n, mean, std, min, max, g1, g2 (biased) over ``src``."""
    g = f"{by}, " if by else ""
    gb = f"GROUP BY {by}" if by else ""
    using = f"USING ({by})" if by else "ON TRUE"
    return f"""mm AS (SELECT {g}COUNT({value}) AS n, AVG({value}) AS mean, STDDEV_SAMP({value}) AS std,
                  MIN({value}) AS vmin, MAX({value}) AS vmax FROM {src} {gb}),
cm AS (SELECT {g}AVG(power({value} - mean, 2)) AS m2, AVG(power({value} - mean, 3)) AS m3,
              AVG(power({value} - mean, 4)) AS m4 FROM {src} JOIN mm {using} {gb}),
mom AS (SELECT mm.*, cm.m3 / power(cm.m2, 1.5) AS g1, cm.m4 / power(cm.m2, 2) - 3.0 AS g2
        FROM mm JOIN cm {using.replace('ON TRUE', 'ON TRUE')})"""


def _np_sql():
    unions = "\nUNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS v FROM lineitem WHERE {valid_sql(c)}" for c in _NP_COLS)
    qs = ", ".join(f"round(quantile_cont(v, {p}), 6) AS {nm}" for p, nm in
                   zip([0.01, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99], PROFILE_NAMES))
    return f"""WITH lv AS ({unions}),
q AS (SELECT "column", {qs}, AVG(CASE WHEN v = 0 THEN 1.0 ELSE 0.0 END) AS zero_ratio FROM lv GROUP BY "column"),
{_moments_sql('lv', '"column"')}
SELECT mom."column", n, round(mean, 6) AS mean, round(std, 6) AS std, round(vmin, 6) AS min, {', '.join(PROFILE_NAMES)},
       round(vmax, 6) AS max, round(CASE WHEN n > 2 THEN g1 END, 6) AS skew, round(CASE WHEN n > 3 THEN g2 END, 6) AS kurt,
       round(CASE WHEN n > 7 THEN {k2_pvalue_sql('CAST(n AS DOUBLE)', 'g1', 'g2')} END, 6) AS p_normal,
       round(zero_ratio, 6) AS zero_ratio
FROM mom JOIN q ON mom."column" = q."column" """


@register("numeric_profile", _np_sql())
def q_numeric_profile(spark, sf_dir):
    """Moments, percentiles, skew/kurtosis and normality p of four lineitem measures."""
    p = numeric_profile(load(spark, sf_dir, "lineitem"), _NP_COLS)
    return p.select("column", "n", *_r(["mean", "std", "min", *PROFILE_NAMES, "max", "skew", "kurt",
                                        "p_normal", "zero_ratio"]))


@register("category_freq", """
WITH c AS (SELECT CAST(c_mktsegment AS VARCHAR) AS category, COUNT(*) AS count FROM customer
           WHERE c_mktsegment IS NOT NULL GROUP BY 1)
SELECT category, count, count / SUM(count) OVER () AS share FROM c""")
def q_category_freq(spark, sf_dir):
    """Market segment frequencies and shares."""
    return category_freq(load(spark, sf_dir, "customer"), "c_mktsegment")


_DP_COLS = ["count", "missing", "zero", "min", "p5", "q1", "median", "mean", "mode", "q3", "p95", "max", "std",
            "iqr", "cv_pct", "skew", "kurt", "range", "lower_fence", "upper_fence", "outliers", "outlier_pct",
            "p_normal", "skew_adj", "kurt_adj"]
_DP_INT = {"count", "missing", "zero", "outliers"}


def _dp_sql(table: str, col: str, clean_where: str, value_expr: str, raw_missing: str) -> str:
    return f"""WITH raw AS (SELECT {col} AS raw_v FROM {table}),
s AS (SELECT {value_expr} AS v FROM raw WHERE {clean_where}),
q AS (SELECT quantile_cont(v, 0.05) AS p5, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median,
             quantile_cont(v, 0.75) AS q3, quantile_cont(v, 0.95) AS p95 FROM s),
md AS (SELECT v AS mode FROM s GROUP BY v ORDER BY COUNT(*) DESC, v ASC LIMIT 1),
{_moments_sql('s', None)},
o AS (SELECT COUNT(*) AS outliers FROM s, q WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)),
r AS (SELECT COUNT(CASE WHEN {raw_missing} THEN 1 END) AS missing, COUNT(CASE WHEN raw_v = 0 THEN 1 END) AS zero FROM raw)
SELECT n AS count, missing, zero, round(vmin, 6) AS min, round(p5, 6) AS p5, round(q1, 6) AS q1,
       round(median, 6) AS median, round(mean, 6) AS mean, round(mode, 6) AS mode, round(q3, 6) AS q3,
       round(p95, 6) AS p95, round(vmax, 6) AS max, round(std, 6) AS std, round(q3 - q1, 6) AS iqr,
       round(CASE WHEN mean <> 0 THEN std / mean * 100.0 END, 6) AS cv_pct, round(g1, 6) AS skew, round(g2, 6) AS kurt,
       round(vmax - vmin, 6) AS range, round(q1 - 1.5 * (q3 - q1), 6) AS lower_fence,
       round(q3 + 1.5 * (q3 - q1), 6) AS upper_fence, outliers, round(outliers / n * 100.0, 6) AS outlier_pct,
       round({k2_pvalue_sql('CAST(n AS DOUBLE)', 'g1', 'g2')}, 6) AS p_normal,
       round(g1 * sqrt(CAST(n AS DOUBLE) * (n - 1)) / (n - 2), 6) AS skew_adj,
       round((n - 1.0) / ((n - 2.0) * (n - 3.0)) * ((n + 1.0) * g2 + 6), 6) AS kurt_adj
FROM mom, q, md, o, r"""


def _dp_out(p):
    return p.select(*[F.col(c) if c in _DP_INT else F.round(c, R6).alias(c) for c in _DP_COLS])


@register("distribution_profile", _dp_sql("lineitem", "l_extendedprice", valid_sql("raw_v"), "raw_v",
                                          "raw_v IS NULL OR isnan(raw_v)"))
def q_distribution_profile(spark, sf_dir):
    """Full profile (23 metrics) of the extended price."""
    return _dp_out(distribution_profile(load(spark, sf_dir, "lineitem"), "l_extendedprice"))


@register("distribution_profile_log", _dp_sql("customer", "c_acctbal",
                                              valid_sql("raw_v") + " AND raw_v >= 0 AND raw_v > 0",
                                              "log10(raw_v)", "raw_v IS NULL OR isnan(raw_v)"))
def q_distribution_profile_log(spark, sf_dir):
    """Profile of log10 account balance with negatives dropped."""
    return _dp_out(distribution_profile(load(spark, sf_dir, "customer"), "c_acctbal", drop_neg=True, log10=True))


@register("profile_verdicts", """
WITH s AS (SELECT l_extendedprice AS v FROM lineitem),
q AS (SELECT quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM s),
""" + _moments_sql("s", None) + """,
o AS (SELECT COUNT(*) AS outliers FROM s, q WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)),
x AS (SELECT *, g1 * sqrt(CAST(n AS DOUBLE) * (n - 1)) / (n - 2) AS sa,
             (n - 1.0) / ((n - 2.0) * (n - 3.0)) * ((n + 1.0) * g2 + 6) AS ka,
             COALESCE(CASE WHEN mean <> 0 THEN std / mean * 100.0 END, 0.0) AS cv,
             outliers / n * 100.0 AS opct, """ + k2_pvalue_sql("CAST(n AS DOUBLE)", "g1", "g2") + """ AS pn
      FROM mom, q, o)
SELECT CASE WHEN sa > 0.5 THEN 'right_skewed' WHEN sa < -0.5 THEN 'left_skewed' ELSE 'symmetric' END AS shape,
       CASE WHEN ka > 1 THEN 'leptokurtic' WHEN ka < -1 THEN 'platykurtic' ELSE 'mesokurtic' END AS tails,
       CASE WHEN pn < 0.05 THEN 'not_normal' ELSE 'normal_not_rejected' END AS normality,
       CASE WHEN abs(mean - median) / (abs(mean) + 1) < 0.05 THEN 'mean_near_median'
            WHEN mean > median THEN 'mean_above_median' ELSE 'mean_below_median' END AS centre,
       CASE WHEN cv > 50 THEN 'very_high' WHEN cv > 20 THEN 'medium' ELSE 'low' END AS spread,
       CASE WHEN outliers > 0 AND opct > 5 THEN 'sample_outliers' WHEN cv > 100 THEN 'stratify'
            WHEN sa > 1 THEN 'use_median' ELSE 'analytical_review' END AS action
FROM x""")
def q_profile_verdicts(spark, sf_dir):
    """Coded shape, centre, spread and audit-action labels for the price profile."""
    return profile_verdicts(distribution_profile(load(spark, sf_dir, "lineitem"), "l_extendedprice"))


@register("histogram", """
WITH s AS (SELECT value AS v FROM events WHERE """ + valid_sql("value") + """),
st AS (SELECT CASE WHEN MIN(v) = MAX(v) THEN MIN(v) - 0.5 ELSE MIN(v) END AS lo,
              CASE WHEN MIN(v) = MAX(v) THEN MAX(v) + 0.5 ELSE MAX(v) END AS hi,
              COUNT(v) AS n, AVG(v) AS mu, STDDEV_SAMP(v) AS sd FROM s),
b0 AS (SELECT v, lo, hi, LEAST(CAST(floor((v - lo) * (20.0 / (hi - lo))) AS INTEGER), 19) AS i FROM s, st),
b1 AS (SELECT v, lo, hi, CASE WHEN v < (CASE WHEN i >= 20 THEN hi ELSE lo + i * ((hi - lo) / 20) END) THEN i - 1 ELSE i END AS i FROM b0),
b2 AS (SELECT CASE WHEN v >= (CASE WHEN i + 1 >= 20 THEN hi ELSE lo + (i + 1) * ((hi - lo) / 20) END) AND i <> 19 THEN i + 1 ELSE i END AS i FROM b1),
c AS (SELECT i AS bin, COUNT(*) AS n FROM b2 GROUP BY 1),
g AS (SELECT CAST(range AS INTEGER) AS bin FROM range(0, 20))
SELECT g.bin, round(CASE WHEN g.bin >= 20 THEN hi ELSE lo + g.bin * ((hi - lo) / 20) END, 9) AS lo,
       round(CASE WHEN g.bin + 1 >= 20 THEN hi ELSE lo + (g.bin + 1) * ((hi - lo) / 20) END, 9) AS hi,
       COALESCE(c.n, 0) AS n,
       round(st.n * ((hi - lo) / 20) * exp(-0.5 * power(((lo + g.bin * ((hi - lo) / 20) + CASE WHEN g.bin + 1 >= 20 THEN hi ELSE lo + (g.bin + 1) * ((hi - lo) / 20) END) / 2 - mu) / sd, 2)) / (sd * sqrt(2 * pi())), 6) AS expected_normal
FROM g CROSS JOIN st LEFT JOIN c ON c.bin = g.bin""")
def q_histogram(spark, sf_dir):
    """20-bin histogram of event values with the normal-curve expectation."""
    h = histogram(load(spark, sf_dir, "events"), "value", 20)
    return h.select("bin", F.round("lo", 9).alias("lo"), F.round("hi", 9).alias("hi"), "n",
                    F.round("expected_normal", 6).alias("expected_normal"))


@register("tukey_outliers", """
WITH t AS (SELECT l_orderkey, l_linenumber, l_extendedprice * l_discount * l_tax AS v FROM lineitem),
q AS (SELECT quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM t)
SELECT l_orderkey, l_linenumber, v, round(q1 - 1.5 * (q3 - q1), 6) AS fence_lo, round(q3 + 1.5 * (q3 - q1), 6) AS fence_hi
FROM t, q WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)""")
def q_tukey_outliers(spark, sf_dir):
    """Lines whose tax on the discount (a skewed amount) lies outside the Tukey fences."""
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber",
                                                (F.col("l_extendedprice") * F.col("l_discount") * F.col("l_tax")).alias("v"))
    t = tukey_outliers(li, "v")
    return t.select("l_orderkey", "l_linenumber", "v", F.round("fence_lo", 6).alias("fence_lo"),
                    F.round("fence_hi", 6).alias("fence_hi"))


# ------------------------------------------------------------ Benford
def _benford_sql(table: str, col: str, digits: int) -> str:
    lo, hi = (1, 9) if digits == 1 else (10, 99)
    return f"""WITH ds AS (SELECT {digits_sql(col)} AS ds FROM {table} WHERE {valid_sql(col)}),
d AS (SELECT CAST(substr(ds, 1, {digits}) AS INTEGER) AS digit FROM ds WHERE length(ds) >= {digits}),
c AS (SELECT digit, COUNT(*) AS c FROM d WHERE digit BETWEEN {lo} AND {hi} GROUP BY digit),
tot AS (SELECT SUM(c) AS n FROM c),
dom AS (SELECT CAST(range AS INTEGER) AS digit FROM range({lo}, {hi + 1})),
b AS (SELECT dom.digit, CAST(COALESCE(c.c, 0) AS DOUBLE) AS observed, CAST(n AS DOUBLE) AS n,
             log10(1.0 + 1.0 / dom.digit) AS expected_p
      FROM dom LEFT JOIN c ON c.digit = dom.digit CROSS JOIN tot WHERE n > 0),
bt AS (SELECT digit, observed, expected_p * n AS expected, observed / n AS observed_p, expected_p,
              observed - expected_p * n AS diff, (observed - expected_p * n) / (expected_p * n) AS diff_pct,
              (observed / n - expected_p) * 100.0 AS diff_pp FROM b)"""


def _benford_table_sql(table, col, digits):
    return _benford_sql(table, col, digits) + """
SELECT digit, observed, round(expected, 6) AS expected, round(observed_p, 9) AS observed_p,
       round(expected_p, 9) AS expected_p, round(diff, 6) AS diff, round(diff_pct, 9) AS diff_pct,
       round(diff_pp, 9) AS diff_pp FROM bt"""


def _benford_table(spark, sf_dir, table, col, digits):
    b = benford(load(spark, sf_dir, table), col, digits)
    return b.select("digit", "observed", F.round("expected", 6).alias("expected"),
                    *_r(["observed_p", "expected_p"], 9), F.round("diff", 6).alias("diff"),
                    *_r(["diff_pct", "diff_pp"], 9))


@register("benford_1d", _benford_table_sql("events", "value", 1))
def q_benford_1d(spark, sf_dir):
    """First-digit Benford table of event values."""
    return _benford_table(spark, sf_dir, "events", "value", 1)


@register("benford_2d", _benford_table_sql("events", "value", 2))
def q_benford_2d(spark, sf_dir):
    """First-two-digit Benford table of event values."""
    return _benford_table(spark, sf_dir, "events", "value", 2)


def _summary_sql(table, col, digits, with_p):
    dof = 8 if digits == 1 else 89
    head = _benford_sql(table, col, digits) + f""",
s AS (SELECT CAST(SUM(observed) AS BIGINT) AS n, SUM(power(observed - expected, 2) / expected) AS chi2,
             AVG(abs(observed_p - expected_p)) AS mad, MAX(abs(diff_pp)) AS max_diff_pp FROM bt)"""
    status = ("CASE WHEN max_diff_pp / 100.0 >= 0.1 THEN 'Red' WHEN max_diff_pp / 100.0 >= 0.05 THEN 'Yellow' "
              "ELSE 'Green' END AS diff_status")
    if with_p:
        p = chi2_even_sf_sql("chi2", dof) if dof % 2 == 0 else chi2_sf_sql("chi2", dof)
        return head + f""",
s2 AS (SELECT *, {p} AS p_value FROM s)
SELECT n, round(chi2, 6) AS chi2, {dof} AS dof, round(p_value, 7) AS p_value, round(mad, 9) AS mad,
       round(max_diff_pp, 9) AS max_diff_pp, {status},
       CASE WHEN p_value < 0.01 OR mad > 0.015 THEN 'Red' WHEN p_value < 0.05 OR mad > 0.012 THEN 'Yellow'
            ELSE 'Green' END AS severity FROM s2"""
    return head + f"""
SELECT n, round(chi2, 6) AS chi2, {dof} AS dof, round(mad, 9) AS mad, round(max_diff_pp, 9) AS max_diff_pp, {status}
FROM s"""


@register("benford_summary_1d", _summary_sql("events", "value", 1, True))
def q_benford_summary_1d(spark, sf_dir):
    """χ² (8 dof), p, MAD, largest gap, status and severity of the first-digit test."""
    s = benford_summary(load(spark, sf_dir, "events"), "value", 1)
    return s.select("n", F.round("chi2", 6).alias("chi2"), "dof", F.round("p_value", 7).alias("p_value"),
                    *_r(["mad", "max_diff_pp"], 9), "diff_status", "severity")


@register("benford_summary_2d", _summary_sql("events", "value", 2, False))
def q_benford_summary_2d(spark, sf_dir):
    """χ² (89 dof), MAD, largest gap and status of the two-digit test (p by unit test)."""
    s = benford_summary(load(spark, sf_dir, "events"), "value", 2)
    return s.select("n", F.round("chi2", 6).alias("chi2"), "dof", *_r(["mad", "max_diff_pp"], 9), "diff_status")


@register("benford_summary_2d_p", _summary_sql("events", "value", 2, True))
def q_benford_summary_2d_p(spark, sf_dir):
    """χ² (89 dof), p, MAD, largest gap, status and severity of the two-digit test."""
    s = benford_summary(load(spark, sf_dir, "events"), "value", 2)
    return s.select("n", F.round("chi2", 6).alias("chi2"), "dof", F.round("p_value", 7).alias("p_value"),
                    *_r(["mad", "max_diff_pp"], 9), "diff_status", "severity")


def _ready_sql(table, col):
    return f"""WITH s AS (SELECT {col} AS v FROM {table} WHERE {valid_sql(col)}),
a AS (SELECT COUNT(CASE WHEN v <> 0 THEN 1 END) AS n_nonzero, COUNT(*) AS nn, COUNT(DISTINCT v) AS nd FROM s)
SELECT n_nonzero, CASE WHEN nn > 0 THEN nd / nn END AS unique_ratio,
       (n_nonzero >= 1 AND NOT COALESCE(nd / nn > 0.95, FALSE)) AS ready,
       CASE WHEN n_nonzero < 1 THEN 'too_few_nonzero' WHEN COALESCE(nd / nn > 0.95, FALSE) THEN 'id_like' ELSE '' END AS reason
FROM a"""


@register("benford_ready", _ready_sql("events", "value"))
def q_benford_ready(spark, sf_dir):
    """Benford gate on event values (passes)."""
    return benford_ready(load(spark, sf_dir, "events"), "value")


@register("benford_ready_idlike", _ready_sql("orders", "o_totalprice"))
def q_benford_ready_idlike(spark, sf_dir):
    """Benford gate on order totals (refused as ID-like)."""
    return benford_ready(load(spark, sf_dir, "orders"), "o_totalprice")


@register("benford_quality", """
WITH d AS (SELECT CASE WHEN event_type = 'error' THEN 'null' WHEN event_type = 'click' THEN ' None ' ELSE CAST(value AS VARCHAR) END AS raw
           FROM events),
s AS (SELECT raw, CASE WHEN isnan(TRY_CAST(trim(raw) AS DOUBLE)) OR isinf(TRY_CAST(trim(raw) AS DOUBLE)) THEN NULL
                       ELSE TRY_CAST(trim(raw) AS DOUBLE) END AS v FROM d),
a AS (SELECT COUNT(*) AS total, COUNT(*) - COUNT(v) AS nan,
             COUNT(CASE WHEN lower(trim(raw)) IN ('none', 'null') THEN 1 END) AS none_null,
             COUNT(CASE WHEN v = 0 THEN 1 END) AS zero, COUNT(CASE WHEN v > 0 THEN 1 END) AS positive,
             COUNT(CASE WHEN v < 0 THEN 1 END) AS negative FROM s),
l AS (SELECT 'total' AS type, total AS n, * FROM a UNION ALL SELECT 'nan', nan, * FROM a
      UNION ALL SELECT 'none_null', none_null, * FROM a UNION ALL SELECT 'zero', zero, * FROM a
      UNION ALL SELECT 'positive', positive, * FROM a UNION ALL SELECT 'negative', negative, * FROM a
      UNION ALL SELECT 'used', positive + negative, * FROM a)
SELECT type, CAST(n AS BIGINT) AS n,
       CASE WHEN total > 0 THEN round(n / total * 100.0, 2) ELSE 0.0 END AS pct_total,
       CASE WHEN greatest(total - nan - zero, 0) > 0 THEN round(n / greatest(total - nan - zero, 0) * 100.0, 2) ELSE 0.0 END AS pct_clean
FROM l""")
def q_benford_quality(spark, sf_dir):
    """Input quality counts for a text column of event values with 'null'/'None' markers."""
    e = load(spark, sf_dir, "events")
    raw = (F.when(F.col("event_type") == "error", F.lit("null"))
            .when(F.col("event_type") == "click", F.lit(" None ")).otherwise(F.col("value").cast("string")))
    return benford_quality(e.select(raw.alias("raw")), "raw")


@register("benford_drilldown", _benford_sql("events", "value", 1) + f""",
flag AS (SELECT digit FROM bt WHERE abs(diff_pp) >= 0.05)
SELECT CAST(substr({digits_sql('value')}, 1, 1) AS INTEGER) AS digit, event_id, user_id, event_type, value
FROM events WHERE {valid_sql('value')} AND length({digits_sql('value')}) >= 1
  AND CAST(substr({digits_sql('value')}, 1, 1) AS INTEGER) IN (SELECT digit FROM flag)""")
def q_benford_drilldown(spark, sf_dir):
    """Events whose first digit deviates from Benford by at least 0.05 points (all such rows)."""
    e = load(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    return benford_drilldown(e, "value", 1, min_pp=0.05).select("digit", "event_id", "user_id", "event_type", "value")
