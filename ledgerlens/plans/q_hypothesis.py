"""Hypothesis-test queries.

Groups: l_returnflag (3 levels, so the F tail has 2 numerator dof and the
Kruskal χ² has 2 dof, both closed forms in SQL), l_linestatus (2 levels),
p_brand (25 levels, bucketed to top 10 + Other), c_mktsegment (5).
Repeated measures: events, subject user_id, condition event_type (5, so the
RM-ANOVA F has 4 numerator dof and the Friedman χ² 4 dof: closed forms).
Where the p-value has no closed form, a ``_p`` variant compares it with a
numerical integral of the density in SQL, to 7 places. The exact rank tests
are repeated by enumeration in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators.hypothesis import (anova_oneway, anova_rm, anova_twoway, cell_means, friedman,
                                             group_summary, kruskal, mann_whitney, posthoc_mw_holm,
                                             posthoc_welch_holm, posthoc_wilcoxon_holm, subject_condition_means,
                                             welch_t, wilcoxon)
from ledgerlens.plans.registry import SALES_FACT_SQL, register
from ledgerlens.plans.sqlgen import (chi2_even_sf_sql, f2_sf_sql, f_even_sf_sql, holm_sql, norm_isf_sql, norm_p2_sql,
                                     t_p2_sql, valid_sql)
from ledgerlens.sources.fixtures import sales_fact
from ledgerlens.sources.tables import load

Y = "l_extendedprice"


def _r(*cols, d=6):
    return [F.round(c, d).alias(c) for c in cols]


def _gy_sql(table_cte: str, table: str, g: str, top: int = 10) -> str:
    """CTE text ending in gy(g, y): group bucketed to top levels by row count."""
    return f"""{table_cte}
top AS (SELECT CAST({g} AS VARCHAR) AS g FROM {table} WHERE {g} IS NOT NULL GROUP BY 1 ORDER BY COUNT(*) DESC, g ASC LIMIT {top}),
gy AS (SELECT CASE WHEN CAST({g} AS VARCHAR) IN (SELECT g FROM top) THEN CAST({g} AS VARCHAR) ELSE 'Other' END AS g,
              {Y} AS y FROM {table} WHERE {g} IS NOT NULL AND {valid_sql(Y)})"""


# ------------------------------------------------------------ parametric
@register("group_summary", _gy_sql("WITH " + SALES_FACT_SQL + ",", "sales_fact", "p_brand") + """
SELECT g AS grp, COUNT(*) AS n, round(AVG(y), 6) AS mean, round(COALESCE(STDDEV_SAMP(y), 0.0), 6) AS std,
       round(quantile_cont(y, 0.5), 6) AS median,
       round(COALESCE(STDDEV_SAMP(y) / sqrt(COUNT(*)), 0.0), 6) AS se,
       round(COALESCE(1.96 * STDDEV_SAMP(y) / sqrt(COUNT(*)), 0.0), 6) AS ci95
FROM gy GROUP BY g""")
def q_group_summary(spark, sf_dir):
    """n, mean, std, median, se, ci95 of price per brand (top 10 + Other)."""
    s = group_summary(sales_fact(spark, sf_dir), Y, "p_brand")
    return s.select("grp", "n", *_r("mean", "std", "median", "se", "ci95"))


_WELCH_SQL = _gy_sql("WITH", "lineitem", "l_linestatus") + """,
st AS (SELECT g, COUNT(*) AS n, AVG(y) AS mean, VAR_SAMP(y) AS var FROM gy GROUP BY g),
o AS (SELECT *, ROW_NUMBER() OVER (ORDER BY mean DESC, g ASC) AS r FROM st),
a AS (SELECT * FROM o WHERE r = 1), b AS (SELECT * FROM o WHERE r = 2)
SELECT a.g AS group_a, b.g AS group_b,
       round((a.mean - b.mean) / sqrt(a.var / a.n + b.var / b.n), 6) AS t,
       round(power(a.var / a.n + b.var / b.n, 2) / (power(a.var / a.n, 2) / (a.n - 1) + power(b.var / b.n, 2) / (b.n - 1)), 4) AS dof
FROM a, b"""


@register("welch_t", _WELCH_SQL)
def q_welch_t(spark, sf_dir):
    """Welch t and Satterthwaite dof of price between the two line statuses."""
    w = welch_t(load(spark, sf_dir, "lineitem"), Y, "l_linestatus")
    return w.select("group_a", "group_b", F.round("t", 6).alias("t"), F.round("dof", 4).alias("dof"))


def _with_p(sql: str, cols: str) -> str:
    """The main query's CTEs with an unrounded last SELECT."""
    return sql[:sql.rindex("\nSELECT")] + "\n" + cols


_WELCH_TD = """(a.mean - b.mean) / sqrt(a.var / a.n + b.var / b.n) AS t,
       power(a.var / a.n + b.var / b.n, 2) / (power(a.var / a.n, 2) / (a.n - 1) + power(b.var / b.n, 2) / (b.n - 1)) AS dof"""


@register("welch_t_p", f"WITH w AS ({_with_p(_WELCH_SQL, f'SELECT a.g AS group_a, b.g AS group_b, {_WELCH_TD} FROM a, b')})" + f"""
SELECT group_a, group_b, round(t, 6) AS t, round(dof, 4) AS dof, round({t_p2_sql('t', 'dof')}, 7) AS p_value FROM w""")
def q_welch_t_p(spark, sf_dir):
    """Welch t-test with its p-value."""
    w = welch_t(load(spark, sf_dir, "lineitem"), Y, "l_linestatus")
    return w.select("group_a", "group_b", F.round("t", 6).alias("t"), F.round("dof", 4).alias("dof"),
                    F.round("p_value", 7).alias("p_value"))


_ANOVA_SQL = _gy_sql("WITH", "lineitem", "l_returnflag") + f""",
st AS (SELECT g, COUNT(*) AS n, AVG(y) AS mean, VAR_SAMP(y) AS var, quantile_cont(y, 0.5) AS med FROM gy GROUP BY g),
gm AS (SELECT SUM(n * mean) / SUM(n) AS gm FROM st),
a AS (SELECT SUM(n * power(mean - gm, 2)) AS ssb, SUM(COALESCE((n - 1) * var, 0)) AS ssw, SUM(n) AS n, COUNT(*) AS k FROM st, gm),
dev AS (SELECT gy.g, abs(gy.y - st.med) AS z FROM gy JOIN st ON gy.g = st.g),
lst AS (SELECT g, COUNT(*) AS n, AVG(z) AS mean, VAR_SAMP(z) AS var FROM dev GROUP BY g),
lgm AS (SELECT SUM(n * mean) / SUM(n) AS gm FROM lst),
l AS (SELECT SUM(n * power(mean - gm, 2)) AS ssb, SUM(COALESCE((n - 1) * var, 0)) AS ssw, SUM(n) AS n, COUNT(*) AS k FROM lst, lgm),
best AS (SELECT g AS best_group FROM st ORDER BY mean DESC, g ASC LIMIT 1),
x AS (SELECT a.*, CAST(a.k - 1 AS DOUBLE) AS df1, CAST(greatest(a.n - a.k, 1) AS DOUBLE) AS df2,
             (l.ssb / (l.k - 1)) / (l.ssw / greatest(l.n - l.k, 1)) AS lf, CAST(greatest(l.n - l.k, 1) AS DOUBLE) AS ldf2
      FROM a, l),
y AS (SELECT *, (ssb / df1) / (ssw / df2) AS f, ssw / df2 AS msw, ssb + ssw AS sst FROM x)
SELECT round(f, 6) AS f, round({f2_sf_sql('f', 'df2')}, 9) AS p_value, df1, df2, round(ssb / sst, 9) AS eta2,
       round((ssb - df1 * msw) / (sst + msw), 9) AS omega2, round({f2_sf_sql('lf', 'ldf2')}, 9) AS levene_p,
       CASE WHEN ssb / sst < 0.06 THEN 'weak' WHEN ssb / sst < 0.14 THEN 'medium' ELSE 'strong' END AS strength,
       best_group
FROM y, best"""


@register("anova_oneway", _ANOVA_SQL)
def q_anova_oneway(spark, sf_dir):
    """One-way ANOVA of price by return flag with η², ω², Levene p and effect label."""
    a = anova_oneway(load(spark, sf_dir, "lineitem"), Y, "l_returnflag")
    return a.select(F.round("f", 6).alias("f"), F.round("p_value", 9).alias("p_value"), "df1", "df2",
                    *_r("eta2", "omega2", "levene_p", d=9), "strength", "best_group")


_POSTHOC_WELCH = _gy_sql("WITH " + SALES_FACT_SQL + ",", "sales_fact", "p_brand") + """,
st AS (SELECT g, COUNT(*) AS n, AVG(y) AS mean, VAR_SAMP(y) AS var FROM gy GROUP BY g),
o AS (SELECT *, row_number() OVER (ORDER BY mean DESC, g ASC) AS r FROM st),
p AS (SELECT a.g AS group_a, b.g AS group_b, a.mean - b.mean AS mean_diff, a.var / a.n AS sa, b.var / b.n AS sb, a.n AS na, b.n AS nb
      FROM o a JOIN o b ON a.r < b.r WHERE a.n >= 2 AND b.n >= 2),
q AS (SELECT group_a, group_b, mean_diff, mean_diff / sqrt(sa + sb) AS t,
             power(sa + sb, 2) / (sa * sa / (na - 1) + sb * sb / (nb - 1)) AS dof FROM p)"""


@register("posthoc_welch_holm", _POSTHOC_WELCH + """
SELECT group_a, group_b, round(t, 6) AS t, round(dof, 4) AS dof, round(mean_diff, 6) AS mean_diff FROM q""")
def q_posthoc_welch_holm(spark, sf_dir):
    """Welch t, dof and mean difference of all pairs of brands (top 10 + Other)."""
    p = posthoc_welch_holm(sales_fact(spark, sf_dir), Y, "p_brand")
    return p.select("group_a", "group_b", F.round("t", 6).alias("t"), F.round("dof", 4).alias("dof"),
                    F.round("mean_diff", 6).alias("mean_diff"))


@register("posthoc_welch_holm_p", _POSTHOC_WELCH + f""",
pr AS (SELECT *, {t_p2_sql('t', 'dof')} AS p_raw FROM q),
{holm_sql('pr')}
SELECT group_a, group_b, round(t, 6) AS t, round(dof, 4) AS dof, round(p_raw, 7) AS p_raw, round(p_adj, 6) AS p_adj_holm,
       round(mean_diff, 6) AS mean_diff FROM h""")
def q_posthoc_welch_holm_p(spark, sf_dir):
    """Pairwise Welch tests of price across brands (top 10 + Other), Holm-adjusted."""
    p = posthoc_welch_holm(sales_fact(spark, sf_dir), Y, "p_brand")
    return p.select("group_a", "group_b", F.round("t", 6).alias("t"), F.round("dof", 4).alias("dof"),
                    F.round("p_raw", 7).alias("p_raw"), F.round("p_adj_holm", 6).alias("p_adj_holm"),
                    F.round("mean_diff", 6).alias("mean_diff"))


@register("cell_means", "WITH " + SALES_FACT_SQL + f"""
SELECT CAST(l_returnflag AS VARCHAR) AS a, CAST(c_mktsegment AS VARCHAR) AS b, COUNT(*) AS n, round(AVG({Y}), 6) AS mean
FROM sales_fact WHERE {valid_sql(Y)} AND l_returnflag IS NOT NULL AND c_mktsegment IS NOT NULL GROUP BY 1, 2""")
def q_cell_means(spark, sf_dir):
    """n and mean price per return flag x market segment cell."""
    c = cell_means(sales_fact(spark, sf_dir), Y, "l_returnflag", "c_mktsegment")
    return c.select("a", "b", "n", F.round("mean", 6).alias("mean"))


_TWOWAY_SQL = "WITH " + SALES_FACT_SQL + f""",
base AS (SELECT c_mktsegment AS a, l_linestatus AS b, {Y} AS y FROM sales_fact
         WHERE c_mktsegment IS NOT NULL AND l_linestatus IS NOT NULL AND {valid_sql(Y)}),
cells AS (SELECT a, b, COUNT(*) AS n, AVG(y) AS m, VAR_POP(y) * COUNT(*) AS w FROM base GROUP BY a, b),
am AS (SELECT a, SUM(n * m) / SUM(n) AS m FROM cells GROUP BY a), bm AS (SELECT b, SUM(n * m) / SUM(n) AS m FROM cells GROUP BY b),
v AS (SELECT SUM(w) AS within, SUM(n) AS n, COUNT(*) AS k FROM cells),
ra AS (SELECT SUM(c.n * power(c.m - am.m, 2)) AS ss FROM cells c JOIN am USING (a)),
rb AS (SELECT SUM(c.n * power(c.m - bm.m, 2)) AS ss FROM cells c JOIN bm USING (b)),
d AS (SELECT f.n * o.n / CAST(f.n + o.n AS DOUBLE) AS h, o.m - f.m AS d
      FROM cells f JOIN cells o ON f.a = o.a AND f.b = 'F' AND o.b = 'O'),
e AS (SELECT power(SUM(h * d), 2) / SUM(h) AS ss_b FROM d),
t AS (SELECT 'A' AS term, rb.ss - (ra.ss - ss_b) AS ss, (SELECT COUNT(*) - 1 FROM am) AS df FROM ra, rb, e
      UNION ALL SELECT 'B', ss_b, 1 FROM e
      UNION ALL SELECT 'A:B', ra.ss - ss_b, k - (SELECT COUNT(*) FROM am) - 1 FROM ra, e, v),
f AS (SELECT term, ss, CAST(df AS DOUBLE) AS df, (ss / df) / (within / (n - k)) AS f, CAST(n - k AS DOUBLE) AS rest, within FROM t, v)
"""


@register("anova_twoway", _TWOWAY_SQL + f"""
SELECT term, round(ss / 1e6, 6) AS sum_sq, df AS dof, round(f, 6) AS f, round(CASE WHEN df = 1 THEN {t_p2_sql('sqrt(f)', 'rest')}
       ELSE {f_even_sf_sql('f', 4, 'rest')} END, 7) AS p_value, round(ss / (ss + within), 9) AS partial_eta2 FROM f
UNION ALL SELECT 'Residual', round(within / 1e6, 6), CAST(n - k AS DOUBLE), NULL, NULL, NULL FROM v""")
def q_anova_twoway(spark, sf_dir):
    """Type-II two-way ANOVA of price on market segment (5 levels) and line status (2 levels) with interaction; sums
    of squares in millions."""
    t = anova_twoway(sales_fact(spark, sf_dir), Y, "c_mktsegment", "l_linestatus")
    return t.select("term", F.round(F.col("sum_sq") / 1e6, 6).alias("sum_sq"), "dof", F.round("f", 6).alias("f"),
                    F.round("p_value", 7).alias("p_value"), F.round("partial_eta2", 9).alias("partial_eta2"))


# ------------------------------------------------------------ repeated measures
_SC_SQL = """WITH cells AS (SELECT user_id AS id, CAST(event_type AS VARCHAR) AS cond, AVG(value) AS y FROM events
  WHERE user_id IS NOT NULL AND event_type IS NOT NULL AND """ + valid_sql("value") + """ GROUP BY 1, 2),
mm AS (SELECT COUNT(DISTINCT cond) AS m FROM cells),
complete AS (SELECT id FROM cells GROUP BY id HAVING COUNT(*) = (SELECT m FROM mm)),
sc AS (SELECT * FROM cells WHERE id IN (SELECT id FROM complete))"""


@register("subject_condition_means", _SC_SQL + """
SELECT id, cond, round(y, 9) AS y FROM sc""")
def q_subject_condition_means(spark, sf_dir):
    """Mean event value per user x event type, complete users only."""
    s = subject_condition_means(load(spark, sf_dir, "events"), "value", "user_id", "event_type")
    return s.select("id", "cond", F.round("y", 9).alias("y"))


@register("anova_rm", _SC_SQL + """,
g AS (SELECT AVG(y) AS gm, COUNT(DISTINCT cond) AS m, COUNT(DISTINCT id) AS n FROM sc),
ssc AS (SELECT SUM(n * power(cm - gm, 2)) AS ss_c FROM (SELECT cond, AVG(y) AS cm FROM sc GROUP BY cond), g),
sss AS (SELECT SUM(m * power(sm - gm, 2)) AS ss_s FROM (SELECT id, AVG(y) AS sm FROM sc GROUP BY id), g),
sst AS (SELECT SUM(power(y - gm, 2)) AS ss_t FROM sc, g),
x AS (SELECT ss_c, ss_t - ss_c - ss_s AS ss_e, CAST(m - 1 AS DOUBLE) AS df1, CAST((m - 1) * (n - 1) AS DOUBLE) AS df2, n
      FROM ssc, sss, sst, g),
f AS (SELECT *, (ss_c / df1) / (ss_e / df2) AS f, df2 / (df2 + df1 * (ss_c / df1) / (ss_e / df2)) AS bx FROM x)
SELECT round(f, 6) AS f, df1, df2, round(power(bx, df2 / 2.0) * (1 + df2 / 2.0 * (1 - bx)), 9) AS p_value,
       n AS n_subjects FROM f""")
def q_anova_rm(spark, sf_dir):
    """Repeated-measures ANOVA of event value across event types within users."""
    a = anova_rm(load(spark, sf_dir, "events"), "value", "user_id", "event_type")
    return a.select(F.round("f", 6).alias("f"), "df1", "df2", F.round("p_value", 9).alias("p_value"), "n_subjects")


# ------------------------------------------------------------ rank tests
_MW_SQL = _gy_sql("WITH", "lineitem", "l_linestatus") + """,
rk AS (SELECT g, y, RANK() OVER (ORDER BY y) + (COUNT(*) OVER (PARTITION BY y) - 1) / 2.0 AS r FROM gy),
med AS (SELECT g, quantile_cont(y, 0.5) AS med FROM gy GROUP BY g),
first AS (SELECT g FROM med ORDER BY med DESC, g ASC LIMIT 1),
s AS (SELECT SUM(CASE WHEN g = (SELECT g FROM first) THEN r END) AS r1,
             CAST(COUNT(CASE WHEN g = (SELECT g FROM first) THEN 1 END) AS DOUBLE) AS n1,
             CAST(COUNT(CASE WHEN g <> (SELECT g FROM first) THEN 1 END) AS DOUBLE) AS n2,
             CAST(COUNT(*) AS DOUBLE) AS n FROM rk),
t AS (SELECT SUM(power(CAST(c AS DOUBLE), 3) - c) AS ties FROM (SELECT y, COUNT(*) AS c FROM gy GROUP BY y)),
u AS (SELECT r1 - n1 * (n1 + 1) / 2 AS u1, n1, n2, n, ties FROM s, t),
z AS (SELECT u1, n, greatest((greatest(u1, n1 * n2 - u1) - n1 * n2 / 2.0 - 0.5)
                              / sqrt(n1 * n2 / 12.0 * ((n + 1) - ties / (n * (n - 1)))), 0.0) AS z FROM u)"""


@register("mann_whitney", _MW_SQL + """
SELECT round(u1, 6) AS u, round(z, 9) AS z, round(z / sqrt(n), 9) AS r_effect,
       CASE WHEN z / sqrt(n) >= 0.5 THEN 'strong' WHEN z / sqrt(n) >= 0.3 THEN 'medium' ELSE 'weak' END AS strength
FROM z""")
def q_mann_whitney(spark, sf_dir):
    """Mann-Whitney U, z and effect r of price between the two line statuses (all rows)."""
    m = mann_whitney(load(spark, sf_dir, "lineitem"), Y, "l_linestatus")
    return m.select(F.round("u", 6).alias("u"), F.round("z", 9).alias("z"), F.round("r_effect", 9).alias("r_effect"),
                    "strength")


@register("mann_whitney_p", _MW_SQL + f"""
SELECT round(u1, 6) AS u, round(z, 9) AS z, round({norm_p2_sql('z')}, 7) AS p_value, round(z / sqrt(n), 9) AS r_effect FROM z""")
def q_mann_whitney_p(spark, sf_dir):
    """Mann-Whitney test with its normal-approximation p-value."""
    m = mann_whitney(load(spark, sf_dir, "lineitem"), Y, "l_linestatus")
    return m.select("u", F.round("z", 9).alias("z"), F.round("p_value", 7).alias("p_value"), F.round("r_effect", 9).alias("r_effect"))


def _nation_wealth(spark, sf_dir):
    """Summed account balances of every nation, Asia's nations against the others'."""
    c = load(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double").alias("y"))
    n = load(spark, sf_dir, "nation").join(load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "y", F.when(F.col("r_name") == "ASIA", "asia").otherwise("else").alias("g"))


@register("mann_whitney_exact", """
WITH RECURSIVE v AS (SELECT CAST(SUM(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS y, any_value(CASE WHEN r_name = 'ASIA' THEN 'asia' ELSE 'else' END) AS g
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY c_nationkey),
rk AS (SELECT g, y, row_number() OVER (ORDER BY y) AS r FROM v),
top AS (SELECT g FROM v GROUP BY g ORDER BY quantile_cont(y, 0.5) DESC, g LIMIT 1),
s AS (SELECT SUM(r) FILTER (g = (SELECT g FROM top)) AS r1, COUNT(*) FILTER (g = (SELECT g FROM top)) AS n1, COUNT(*) AS n FROM rk),
u AS (SELECT r1 - n1 * (n1 + 1) / 2.0 AS u, n1, n - n1 AS n2, n FROM s),
f(i, j, sum, c) AS (SELECT 0, 0, 0, CAST(1 AS DOUBLE) UNION ALL
  SELECT i + 1, j + d, sum + d * (i + 1), SUM(c) FROM f, (VALUES (0), (1)) t(d), u WHERE i < u.n AND j + d <= u.n1 GROUP BY 1, 2, 3),
p AS (SELECT u.u, u.n, least(2 * SUM(c) FILTER (sum - n1 * (n1 + 1) / 2.0 >= greatest(u.u, n1 * n2 - u.u)) / SUM(c), 1.0) AS p
      FROM f, u WHERE i = u.n AND j = u.n1 GROUP BY u.u, u.n)
SELECT u, round(p, 9) AS p_value FROM p""")
def q_mann_whitney_exact(spark, sf_dir):
    """Exact Mann-Whitney of five nations against the others (summed balances, untied); SQL counts all rank sums."""
    m = mann_whitney(_nation_wealth(spark, sf_dir), "y", "g")
    return m.select("u", F.round("p_value", 9).alias("p_value"))


@register("kruskal", _gy_sql("WITH", "lineitem", "l_returnflag") + f""",
rk AS (SELECT g, RANK() OVER (ORDER BY y) + (COUNT(*) OVER (PARTITION BY y) - 1) / 2.0 AS r FROM gy),
s AS (SELECT SUM(power(rs, 2) / ng) AS s, COUNT(*) AS k FROM (SELECT g, SUM(r) AS rs, COUNT(*) AS ng FROM rk GROUP BY g)),
t AS (SELECT SUM(power(CAST(c AS DOUBLE), 3) - c) AS ties, CAST(SUM(c) AS DOUBLE) AS n FROM (SELECT y, COUNT(*) AS c FROM gy GROUP BY y)),
h AS (SELECT (12.0 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - ties / (n * n * n - n)) AS h, k, n FROM s, t)
SELECT round(h, 6) AS h, k - 1 AS dof, round({chi2_even_sf_sql('h', 2)}, 9) AS p_value,
       round((h - (k - 1)) / (n - k), 9) AS eps2,
       CASE WHEN (h - (k - 1)) / (n - k) < 0.06 THEN 'weak' WHEN (h - (k - 1)) / (n - k) < 0.14 THEN 'medium'
            ELSE 'strong' END AS strength
FROM h""")
def q_kruskal(spark, sf_dir):
    """Kruskal-Wallis H, χ² p and ε² of price by return flag (all rows)."""
    k = kruskal(load(spark, sf_dir, "lineitem"), Y, "l_returnflag")
    return k.select(F.round("h", 6).alias("h"), "dof", F.round("p_value", 9).alias("p_value"),
                    F.round("eps2", 9).alias("eps2"), "strength")


_POSTHOC_MW = _gy_sql("WITH " + SALES_FACT_SQL + ",", "sales_fact", "c_mktsegment") + """,
o AS (SELECT g, row_number() OVER (ORDER BY quantile_cont(y, 0.5) DESC, g ASC) AS r FROM gy GROUP BY g),
p AS (SELECT a.g AS group_a, b.g AS group_b FROM o a JOIN o b ON a.r < b.r),
e AS (SELECT group_a, group_b, g = group_a AS is_a, y FROM p JOIN gy ON gy.g IN (group_a, group_b)),
rk AS (SELECT *, RANK() OVER (PARTITION BY group_a, group_b ORDER BY y)
                 + (COUNT(*) OVER (PARTITION BY group_a, group_b, y) - 1) / 2.0 AS r FROM e),
s AS (SELECT group_a, group_b, SUM(CASE WHEN is_a THEN r ELSE 0 END) AS r1, CAST(SUM(CASE WHEN is_a THEN 1 ELSE 0 END) AS DOUBLE) AS n1,
             CAST(SUM(CASE WHEN is_a THEN 0 ELSE 1 END) AS DOUBLE) AS n2, CAST(COUNT(*) AS DOUBLE) AS n FROM rk GROUP BY 1, 2),
t AS (SELECT group_a, group_b, SUM(power(CAST(c AS DOUBLE), 3) - c) AS ties
      FROM (SELECT group_a, group_b, y, COUNT(*) AS c FROM e GROUP BY 1, 2, 3) GROUP BY 1, 2),
u AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u1 FROM s JOIN t USING (group_a, group_b)),
z AS (SELECT group_a, group_b, u1, greatest((greatest(u1, n1 * n2 - u1) - n1 * n2 / 2.0 - 0.5)
             / sqrt(n1 * n2 / 12.0 * ((n + 1) - ties / (n * (n - 1)))), 0.0) AS z FROM u)"""


@register("posthoc_mw_holm", _POSTHOC_MW + """
SELECT group_a, group_b, round(u1, 6) AS u, round(z, 9) AS z FROM z""")
def q_posthoc_mw_holm(spark, sf_dir):
    """Mann-Whitney U and z of price for all pairs of market segments."""
    p = posthoc_mw_holm(sales_fact(spark, sf_dir), Y, "c_mktsegment")
    return p.select("group_a", "group_b", F.round("u", 6).alias("u"), F.round("z", 9).alias("z"))


@register("posthoc_mw_holm_p", _POSTHOC_MW.replace("\ns AS", "\nsr AS").replace("FROM s JOIN t", "FROM sr JOIN t") + f""",
pr AS (SELECT *, {norm_p2_sql('z')} AS p_raw FROM z),
{holm_sql('pr')}
SELECT group_a, group_b, round(u1, 6) AS u, round(z, 9) AS z, round(p_raw, 7) AS p_raw, round(p_adj, 6) AS p_adj_holm FROM h""")
def q_posthoc_mw_holm_p(spark, sf_dir):
    """Pairwise Mann-Whitney of price across market segments, Holm-adjusted."""
    p = posthoc_mw_holm(sales_fact(spark, sf_dir), Y, "c_mktsegment")
    return p.select("group_a", "group_b", F.round("u", 6).alias("u"), F.round("z", 9).alias("z"),
                    F.round("p_raw", 7).alias("p_raw"), F.round("p_adj_holm", 6).alias("p_adj_holm"))


def _two_cond(spark, sf_dir):
    return load(spark, sf_dir, "events").where(F.col("event_type").isin("view", "purchase"))


#: How many subsets of 1..i have each sum: the null distribution of W for i untied differences.
_SUBSETS = """f(i, sum, c) AS (SELECT 0, 0, CAST(1 AS DOUBLE) UNION ALL
  SELECT i + 1, sum + x * (i + 1), SUM(c) FROM f, (VALUES (0), (1)) t(x) WHERE i < 50 GROUP BY 1, 2)"""


def _exact_z(table: str) -> str:
    """CTE z over ``table`` (w, z, nr, ties, n, ...): exact p and its z for up to 50 differences, none zero or tied."""
    return f"""ex AS (SELECT *, CASE WHEN nr <= 50 AND nr = n AND ties = 0 THEN
  least(1.0, 2 * (SELECT SUM(c) FROM f WHERE i = nr AND sum <= w) / power(2.0, nr)) END AS pe FROM {table}),
z AS (SELECT * REPLACE (CASE WHEN pe IS NULL THEN z ELSE zi END AS z), COALESCE(pe, {norm_p2_sql('z')}) AS p
      FROM ({norm_isf_sql('ex', 'pe')}))"""


_WX_SQL = f"WITH RECURSIVE {_SUBSETS}, " + """cells AS (SELECT user_id AS id, CAST(event_type AS VARCHAR) AS cond, AVG(value) AS y FROM events
  WHERE event_type IN ('view', 'purchase') AND user_id IS NOT NULL AND """ + valid_sql("value") + """ GROUP BY 1, 2),
complete AS (SELECT id FROM cells GROUP BY id HAVING COUNT(*) = (SELECT COUNT(DISTINCT cond) FROM cells)),
d AS (SELECT id, MAX(CASE WHEN cond = 'purchase' THEN y END) - MAX(CASE WHEN cond = 'view' THEN y END) AS d
      FROM cells WHERE id IN (SELECT id FROM complete) GROUP BY id),
nz AS (SELECT abs(d) AS a, d > 0 AS pos FROM d WHERE d <> 0),
rk AS (SELECT pos, RANK() OVER (ORDER BY a) + (COUNT(*) OVER (PARTITION BY a) - 1) / 2.0 AS r FROM nz),
s AS (SELECT SUM(CASE WHEN pos THEN r ELSE 0 END) AS wp, SUM(CASE WHEN pos THEN 0 ELSE r END) AS wm,
             CAST(COUNT(*) AS DOUBLE) AS nr FROM rk),
t AS (SELECT COALESCE(SUM(power(CAST(c AS DOUBLE), 3) - c), 0) AS ties FROM (SELECT a, COUNT(*) AS c FROM nz GROUP BY a)),
ns AS (SELECT CAST(COUNT(*) AS DOUBLE) AS n FROM d),
zn AS (SELECT least(wp, wm) AS w, abs((least(wp, wm) - nr * (nr + 1) / 4.0)
             / sqrt(nr * (nr + 1) * (2 * nr + 1) / 24.0 - ties / 48.0)) AS z, n, nr, ties FROM s, t, ns),
""" + _exact_z("zn")


@register("wilcoxon", _WX_SQL + """
SELECT round(w, 6) AS w, round(z, 9) AS z, round(z / sqrt(n), 9) AS r_effect,
       CASE WHEN z / sqrt(n) >= 0.5 THEN 'strong' WHEN z / sqrt(n) >= 0.3 THEN 'medium' ELSE 'weak' END AS strength
FROM z""")
def q_wilcoxon(spark, sf_dir):
    """Wilcoxon signed-rank of user means, purchase vs view."""
    w = wilcoxon(_two_cond(spark, sf_dir), "value", "user_id", "event_type")
    return w.select(F.round("w", 6).alias("w"), F.round("z", 9).alias("z"), F.round("r_effect", 9).alias("r_effect"),
                    "strength")


@register("wilcoxon_p", _WX_SQL + f"""
SELECT round(w, 6) AS w, round(z, 9) AS z, round(p, 7) AS p_value, round(z / sqrt(n), 9) AS r_effect FROM z""")
def q_wilcoxon_p(spark, sf_dir):
    """Wilcoxon signed-rank with its p-value."""
    w = wilcoxon(_two_cond(spark, sf_dir), "value", "user_id", "event_type")
    return w.select("w", F.round("z", 9).alias("z"), F.round("p_value", 7).alias("p_value"), F.round("r_effect", 9).alias("r_effect"))


@register("wilcoxon_exact", """
WITH RECURSIVE m AS (SELECT c_nationkey AS id, l_returnflag AS f, AVG(CAST(l_extendedprice AS DOUBLE)) AS y FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_returnflag IN ('A', 'R') GROUP BY 1, 2),
d AS (SELECT a.y - r.y AS d FROM m a JOIN m r ON a.id = r.id AND a.f = 'A' AND r.f = 'R'),
rk AS (SELECT d, row_number() OVER (ORDER BY abs(d)) AS r FROM d),
s AS (SELECT COUNT(*) AS n, least(COALESCE(SUM(r) FILTER (d > 0), 0), COALESCE(SUM(r) FILTER (d < 0), 0)) AS w FROM rk),
f(i, sum, c) AS (SELECT 0, 0, CAST(1 AS DOUBLE) UNION ALL
  SELECT i + 1, sum + x * (i + 1), SUM(c) FROM f, (VALUES (0), (1)) t(x), s WHERE i < s.n GROUP BY 1, 2)
SELECT CAST(s.w AS DOUBLE) AS w, round(least(2 * SUM(c) FILTER (sum <= s.w) / SUM(c), 1.0), 9) AS p_value
FROM f, s WHERE i = s.n GROUP BY s.w""")
def q_wilcoxon_exact(spark, sf_dir):
    """Exact signed-rank test of nations' mean price, accepted against returned lines; SQL counts all subset sums."""
    li = load(spark, sf_dir, "lineitem").where(F.col("l_returnflag").isin("A", "R"))
    rows = (li.join(load(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
              .join(load(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")))
    return wilcoxon(rows, Y, "c_nationkey", "l_returnflag").select("w", F.round("p_value", 9).alias("p_value"))


@register("friedman", _SC_SQL + f""",
rk AS (SELECT id, cond, y, RANK() OVER (PARTITION BY id ORDER BY y) + (COUNT(*) OVER (PARTITION BY id, y) - 1) / 2.0 AS r,
              COUNT(*) OVER (PARTITION BY id, y) AS t FROM sc),
rs AS (SELECT SUM(power(R, 2)) AS ssbn FROM (SELECT cond, SUM(r) AS R FROM rk GROUP BY cond)),
tt AS (SELECT COALESCE(SUM(power(CAST(t AS DOUBLE), 3) - t), 0) AS ties FROM (SELECT DISTINCT id, y, t FROM rk WHERE t > 1)),
dm AS (SELECT CAST(COUNT(DISTINCT id) AS DOUBLE) AS n, CAST(COUNT(DISTINCT cond) AS DOUBLE) AS m FROM sc),
c AS (SELECT (12.0 / (m * n * (m + 1)) * ssbn - 3 * n * (m + 1)) / (1 - ties / (m * (m * m - 1) * n)) AS chi2, n, m
      FROM rs, tt, dm)
SELECT round(chi2, 6) AS chi2, CAST(m - 1 AS BIGINT) AS dof, round({chi2_even_sf_sql('chi2', 4)}, 9) AS p_value,
       round(chi2 / (n * m * (m + 1) / 12.0), 9) AS w_ref, round(chi2 / (n * (m - 1)), 9) AS kendall_w,
       CASE WHEN chi2 / (n * m * (m + 1) / 12.0) >= 0.3 THEN 'strong'
            WHEN chi2 / (n * m * (m + 1) / 12.0) >= 0.1 THEN 'medium' ELSE 'weak' END AS strength
FROM c""")
def q_friedman(spark, sf_dir):
    """Friedman χ², p, Kendall W (as coded and textbook) across event types within users."""
    f = friedman(load(spark, sf_dir, "events"), "value", "user_id", "event_type")
    return f.select(F.round("chi2", 6).alias("chi2"), "dof", F.round("p_value", 9).alias("p_value"),
                    F.round("w_ref", 9).alias("w_ref"), F.round("kendall_w", 9).alias("kendall_w"), "strength")


_POSTHOC_WX = _SC_SQL.replace("WITH cells", f"WITH RECURSIVE {_SUBSETS}, cells", 1) + """,
d AS (SELECT a.cond AS group_a, b.cond AS group_b, a.y - b.y AS d FROM sc a JOIN sc b ON a.id = b.id AND a.cond < b.cond),
nz AS (SELECT *, abs(d) AS a FROM d WHERE d <> 0),
rk AS (SELECT *, RANK() OVER (PARTITION BY group_a, group_b ORDER BY a)
                 + (COUNT(*) OVER (PARTITION BY group_a, group_b, a) - 1) / 2.0 AS r FROM nz),
sr AS (SELECT group_a, group_b, SUM(CASE WHEN d > 0 THEN r ELSE 0 END) AS wp, SUM(CASE WHEN d > 0 THEN 0 ELSE r END) AS wm,
             CAST(COUNT(*) AS DOUBLE) AS nr FROM rk GROUP BY 1, 2),
t AS (SELECT group_a, group_b, SUM(power(CAST(c AS DOUBLE), 3) - c) AS ties
      FROM (SELECT group_a, group_b, a, COUNT(*) AS c FROM nz GROUP BY 1, 2, 3) GROUP BY 1, 2),
ns AS (SELECT group_a, group_b, COUNT(*) AS n FROM d GROUP BY 1, 2),
zn AS (SELECT group_a, group_b, least(wp, wm) AS w, abs((least(wp, wm) - nr * (nr + 1) / 4.0)
             / sqrt(nr * (nr + 1) * (2 * nr + 1) / 24.0 - ties / 48.0)) AS z, n, nr, ties
       FROM sr JOIN t USING (group_a, group_b) JOIN ns USING (group_a, group_b)),
""" + _exact_z("zn")


@register("posthoc_wilcoxon_holm", _POSTHOC_WX + """
SELECT group_a, group_b, round(w, 6) AS w, round(z, 9) AS z FROM z""")
def q_posthoc_wilcoxon_holm(spark, sf_dir):
    """Wilcoxon W and z of user means for all pairs of event types."""
    p = posthoc_wilcoxon_holm(load(spark, sf_dir, "events"), "value", "user_id", "event_type")
    return p.select("group_a", "group_b", F.round("w", 6).alias("w"), F.round("z", 9).alias("z"))


@register("posthoc_wilcoxon_holm_p", _POSTHOC_WX + f""",
pr AS (SELECT *, p AS p_raw FROM z),
{holm_sql('pr')}
SELECT group_a, group_b, round(w, 6) AS w, round(z, 9) AS z, round(p_raw, 7) AS p_raw, round(p_adj, 6) AS p_adj_holm FROM h""")
def q_posthoc_wilcoxon_holm_p(spark, sf_dir):
    """Pairwise Wilcoxon of user means across event types, Holm-adjusted."""
    p = posthoc_wilcoxon_holm(load(spark, sf_dir, "events"), "value", "user_id", "event_type")
    return p.select("group_a", "group_b", F.round("w", 6).alias("w"), F.round("z", 9).alias("z"),
                    F.round("p_raw", 7).alias("p_raw"), F.round("p_adj_holm", 6).alias("p_adj_holm"))


# ------------------------------------------------------------ degenerate groups
@register("anova_constant_groups", """
WITH v AS (SELECT l_linestatus AS g, CASE WHEN l_linestatus = 'F' THEN 3.0 ELSE 5.0 END AS y FROM lineitem)
SELECT CAST('Infinity' AS DOUBLE) AS f, 0.0 AS p_value, 1.0 AS eta2, 'strong' AS strength,
       (SELECT g FROM v GROUP BY g ORDER BY AVG(y) DESC LIMIT 1) AS best_group
FROM (SELECT 1) WHERE (SELECT COUNT(DISTINCT g) FROM v) = 2""")
def q_anova_constant_groups(spark, sf_dir):
    """One-way ANOVA of a value that is constant inside each line status: infinite F, p 0."""
    li = load(spark, sf_dir, "lineitem").select("l_linestatus", F.when(F.col("l_linestatus") == "F", 3.0).otherwise(5.0)
                                                .alias("y"))
    a = anova_oneway(li, "y", "l_linestatus")
    return a.select("f", "p_value", F.round("eta2", 9).alias("eta2"), "strength", "best_group")
