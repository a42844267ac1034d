"""Overview, filter and cleaning queries on the sales fact / ledger tables.

Roles: time l_shipdate, customer o_custkey, product p_brand, region r_name,
channel o_orderpriority, revenue l_extendedprice (exact cents), weight
l_quantity, mapping A l_linestatus (O = Sales, F = Transfer), mapping B
value_type of the ledger (Sales / Discount)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.functions.clean import clean_time, clean_values, normalize_text, to_numeric
from ledgerlens.operators.filters import (bucket_other, distinct_values, drilldown_filter, filter_options,
                                          map_values, period_filter, year_scope)
from ledgerlens.operators.overview import (avg_price, custom_pivot, discount_by_group, discount_kpis,
                                           monthly_discount, overview_kpis, period_agg, period_growth,
                                           region_channel, revenue_vs_weight, top_contribution,
                                           top_share_with_other)
from ledgerlens.plans.registry import SALES_FACT_SQL, SALES_LEDGER_SQL, register
from ledgerlens.sources.fixtures import sales_fact, sales_ledger
from ledgerlens.sources.tables import load

REV = "CAST(l_extendedprice AS DECIMAL(18,2))"
VALID_T = "l_shipdate IS NOT NULL AND year(l_shipdate) BETWEEN 1900 AND 2100"


def fact(spark, sf_dir):
    return (sales_fact(spark, sf_dir)
            .withColumn("revenue", F.col("l_extendedprice").cast("decimal(18,2)"))
            .withColumn("weight", F.col("l_quantity").cast("decimal(18,2)")))


def ledger_b(spark, sf_dir):
    """Ledger with mapping B applied: sales_b / disc_b as exact amounts."""
    led = sales_ledger(spark, sf_dir).withColumn("amount", F.col("amount").cast("decimal(18,4)"))
    mapped = map_values(led, "value_type", "amount", {"sales_b": ["Sales"], "disc_b": [" discount "]})
    return (mapped.withColumn("sales_b", F.col("sales_b").cast("decimal(18,4)"))
                  .withColumn("disc_b", F.col("disc_b").cast("decimal(18,4)")))


LEDGER_B_SQL = "WITH " + SALES_LEDGER_SQL + """,
ledger_b AS (
  SELECT *, CAST(CASE WHEN value_type = 'Sales' THEN CAST(amount AS DECIMAL(18,4)) ELSE 0 END AS DECIMAL(18,4)) AS sales_b,
            CAST(CASE WHEN value_type = 'Discount' THEN CAST(amount AS DECIMAL(18,4)) ELSE 0 END AS DECIMAL(18,4)) AS disc_b
  FROM sales_ledger)"""


def _dbl(*names):
    return [F.col(n).cast("double").alias(n) for n in names]


# ---------------------------------------------------------------- periods
@register("period_agg", "WITH " + SALES_FACT_SQL + f"""
SELECT date_trunc('month', l_shipdate) AS period, CAST(SUM({REV}) AS DOUBLE) AS revenue,
       CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS weight
FROM sales_fact WHERE {VALID_T} GROUP BY 1""")
def q_period_agg(spark, sf_dir):
    """Monthly revenue and weight sums."""
    out = period_agg(fact(spark, sf_dir), "l_shipdate", {"revenue": "revenue", "weight": "weight"}, "month")
    return out.select("period", *_dbl("revenue", "weight"))


@register("period_agg_quarter", "WITH " + SALES_FACT_SQL + f"""
SELECT date_trunc('quarter', l_shipdate) AS period, CAST(SUM({REV}) AS DOUBLE) AS revenue
FROM sales_fact WHERE {VALID_T} GROUP BY 1""")
def q_period_agg_quarter(spark, sf_dir):
    """Quarterly revenue sums."""
    out = period_agg(fact(spark, sf_dir), "l_shipdate", {"revenue": "revenue"}, "quarter")
    return out.select("period", *_dbl("revenue"))


def _growth_sql(freq, k):
    return "WITH " + SALES_FACT_SQL + f""",
s AS (SELECT date_trunc('{freq}', l_shipdate) AS period, SUM({REV}) AS value
      FROM sales_fact WHERE {VALID_T} GROUP BY 1),
g AS (SELECT period, value, LAG(value, {k}) OVER (ORDER BY period) AS base FROM s)
SELECT period, CAST(value AS DOUBLE) AS value, CAST(base AS DOUBLE) AS base,
       CASE WHEN CAST(base AS DOUBLE) <> 0 THEN (CAST(value AS DOUBLE) / CAST(base AS DOUBLE) - 1.0) * 100.0 END AS pct_change
FROM g"""


def _growth(spark, sf_dir, freq, compare, calendar=False):
    out = period_growth(fact(spark, sf_dir), "l_shipdate", "revenue", freq, compare, calendar)
    return out.select("period", *_dbl("value", "base"), "pct_change")


@register("period_growth", _growth_sql("month", 1))
def q_period_growth(spark, sf_dir):
    """Monthly revenue, %Δ against the previous month present."""
    return _growth(spark, sf_dir, "month", "prev")


@register("period_growth_yoy", _growth_sql("month", 12))
def q_period_growth_yoy(spark, sf_dir):
    """Monthly revenue, YoY %Δ counted 12 rows back."""
    return _growth(spark, sf_dir, "month", "yoy")


@register("period_growth_calendar", "WITH " + SALES_FACT_SQL + f""",
s AS (SELECT date_trunc('quarter', l_shipdate) AS period, SUM({REV}) AS value
      FROM sales_fact WHERE {VALID_T} GROUP BY 1)
SELECT a.period, CAST(a.value AS DOUBLE) AS value, CAST(b.value AS DOUBLE) AS base,
       CASE WHEN CAST(b.value AS DOUBLE) <> 0 THEN (CAST(a.value AS DOUBLE) / CAST(b.value AS DOUBLE) - 1.0) * 100.0 END AS pct_change
FROM s a LEFT JOIN s b ON b.period + INTERVAL 12 MONTH = a.period""")
def q_period_growth_calendar(spark, sf_dir):
    """Quarterly revenue, YoY %Δ against the same quarter one calendar year back."""
    return _growth(spark, sf_dir, "quarter", "yoy", calendar=True)


# ---------------------------------------------------------------- KPIs
@register("overview_kpis", "WITH " + SALES_FACT_SQL + f"""
SELECT CAST(SUM({REV}) AS DOUBLE) AS revenue, COUNT(*) AS n_rows,
       COUNT(DISTINCT CASE WHEN {REV} > 0 THEN p_brand END) AS n_products,
       CASE WHEN SUM(ABS(l_quantity)) > 0 THEN
         SUM(CASE WHEN lower(trim(l_linestatus)) = 'o' THEN ABS(l_quantity) ELSE 0 END)
         / (SUM(CASE WHEN lower(trim(l_linestatus)) = 'o' THEN ABS(l_quantity) ELSE 0 END)
            + SUM(CASE WHEN lower(trim(l_linestatus)) = 'f' THEN ABS(l_quantity) ELSE 0 END)) * 100.0 END AS pct_sales_a,
       CASE WHEN SUM(ABS(l_quantity)) > 0 THEN
         SUM(CASE WHEN lower(trim(l_linestatus)) = 'f' THEN ABS(l_quantity) ELSE 0 END)
         / (SUM(CASE WHEN lower(trim(l_linestatus)) = 'o' THEN ABS(l_quantity) ELSE 0 END)
            + SUM(CASE WHEN lower(trim(l_linestatus)) = 'f' THEN ABS(l_quantity) ELSE 0 END)) * 100.0 END AS pct_transfer_a
FROM sales_fact""")
def q_overview_kpis(spark, sf_dir):
    """Revenue, rows, products with revenue, Sales(A)/Transfer(A) weight shares."""
    f = map_values(fact(spark, sf_dir), "l_linestatus", "l_quantity", {"sales_a": ["O"], "transfer_a": ["f"]})
    out = overview_kpis(f, "revenue", "l_quantity", "p_brand", "sales_a", "transfer_a")
    return out.select(*_dbl("revenue"), "n_rows", "n_products", "pct_sales_a", "pct_transfer_a")


_MON_SQL = LEDGER_B_SQL + f""",
mon AS (SELECT date_trunc('month', l_shipdate) AS month, SUM(sales_b) AS sales, SUM(disc_b) AS discount
        FROM ledger_b WHERE {VALID_T} GROUP BY 1 HAVING SUM(sales_b) > 0),
mon2 AS (SELECT *, -CAST(discount AS DOUBLE) / CAST(sales AS DOUBLE) * 100.0 AS discount_pct FROM mon)"""


@register("discount_kpis", _MON_SQL + """,
yr AS (SELECT MAX(year(month)) AS y FROM mon2)
SELECT CAST(y AS INTEGER) AS year, round(AVG(discount_pct), 9) AS avg_monthly_pct,
       round(-CAST(SUM(discount) AS DOUBLE) / CAST(SUM(sales) AS DOUBLE) * 100.0, 9) AS year_pct
FROM mon2 JOIN yr ON year(month) = y GROUP BY y""")
def q_discount_kpis(spark, sf_dir):
    """Mean monthly Discount% and year Discount% (latest year)."""
    k = discount_kpis(ledger_b(spark, sf_dir), "l_shipdate", "sales_b", "disc_b")
    return k.select("year", *[F.round(c, 9).alias(c) for c in ("avg_monthly_pct", "year_pct")])


@register("monthly_discount", _MON_SQL + """
SELECT month, CAST(sales AS DOUBLE) AS sales, CAST(discount AS DOUBLE) AS discount, discount_pct
FROM mon2 WHERE year(month) = 1998""")
def q_monthly_discount(spark, sf_dir):
    """Monthly Sales(B), Discount(B), Discount% for 1998."""
    out = monthly_discount(ledger_b(spark, sf_dir), "l_shipdate", "sales_b", "disc_b", 1998)
    return out.select("month", *_dbl("sales", "discount"), "discount_pct")


def _disc_group_sql(col):
    return LEDGER_B_SQL + f"""
SELECT grp, discount_rate, CAST(total_discount AS DOUBLE) AS total_discount,
       CAST(total_revenue AS DOUBLE) AS total_revenue FROM (
  SELECT COALESCE(CAST({col} AS VARCHAR), '(NA)') AS grp, SUM(sales_b) AS total_revenue, SUM(disc_b) AS total_discount,
         -CAST(SUM(disc_b) AS DOUBLE) / CAST(SUM(sales_b) AS DOUBLE) * 100.0 AS discount_rate
  FROM ledger_b GROUP BY 1 HAVING SUM(sales_b) > 0)
ORDER BY discount_rate DESC, grp ASC LIMIT 15"""


def _disc_group(spark, sf_dir, col):
    out = discount_by_group(ledger_b(spark, sf_dir), col, "sales_b", "disc_b", 15)
    return out.select("grp", "discount_rate", *_dbl("total_discount", "total_revenue"))


@register("discount_by_region", _disc_group_sql("r_name"))
def q_discount_by_region(spark, sf_dir):
    """Discount rate per region."""
    return _disc_group(spark, sf_dir, "r_name")


@register("discount_by_product", _disc_group_sql("p_brand"))
def q_discount_by_product(spark, sf_dir):
    """Top 15 brands by discount rate."""
    return _disc_group(spark, sf_dir, "p_brand")


@register("discount_by_customer", _disc_group_sql("o_custkey"))
def q_discount_by_customer(spark, sf_dir):
    """Top 15 customers by discount rate."""
    return _disc_group(spark, sf_dir, "o_custkey")


@register("revenue_vs_weight", "WITH " + SALES_FACT_SQL + f"""
SELECT date_trunc('quarter', l_shipdate) AS period, CAST(SUM({REV}) AS DOUBLE) AS revenue,
       SUM(CASE WHEN l_quantity > 0 THEN l_quantity ELSE 0.0 END) AS weight
FROM sales_fact WHERE {VALID_T} GROUP BY 1""")
def q_revenue_vs_weight(spark, sf_dir):
    """Quarterly revenue and positive weight."""
    out = revenue_vs_weight(fact(spark, sf_dir), "l_shipdate", "revenue", "l_quantity", "quarter")
    return out.select("period", *_dbl("revenue"), F.col("weight"))


@register("avg_price", "WITH " + SALES_FACT_SQL + f"""
SELECT date_trunc('month', l_shipdate) AS month, CAST(SUM({REV}) AS DOUBLE) AS revenue,
       CAST(SUM(CASE WHEN l_quantity > 0 THEN {REV} ELSE 0 END) AS DOUBLE)
         / NULLIF(SUM(CASE WHEN l_quantity > 0 THEN l_quantity ELSE 0.0 END), 0.0) AS avg_price
FROM sales_fact WHERE {VALID_T} GROUP BY 1""")
def q_avg_price(spark, sf_dir):
    """Monthly revenue and weighted average price."""
    out = avg_price(fact(spark, sf_dir), "l_shipdate", "revenue", "l_quantity")
    return out.select("month", *_dbl("revenue"), "avg_price")


# ---------------------------------------------------------------- top-N
_TOP_SQL = "WITH " + SALES_FACT_SQL + f""",
s AS (SELECT COALESCE(CAST(p_brand AS VARCHAR), '(NA)') AS label, SUM({REV}) AS value FROM sales_fact GROUP BY 1),
t AS (SELECT SUM(value) AS total FROM s),
top AS (SELECT label, value FROM s ORDER BY value DESC, label ASC LIMIT 10)"""


@register("top_contribution", _TOP_SQL + """
SELECT label, CAST(value AS DOUBLE) AS value,
       CAST(value AS DOUBLE) / SUM(CAST(value AS DOUBLE)) OVER () * 100.0 AS share_top,
       CAST(value AS DOUBLE) / CAST(total AS DOUBLE) * 100.0 AS share_total,
       CAST(SUM(value) OVER (ORDER BY value DESC, label ASC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE)
         / CAST(total AS DOUBLE) * 100.0 AS cum_pct,
       CAST(ROW_NUMBER() OVER (ORDER BY value DESC, label ASC) AS BIGINT) AS rank
FROM top CROSS JOIN t""")
def q_top_contribution(spark, sf_dir):
    """Top 10 brands by revenue with shares and cumulative % of the total."""
    out = top_contribution(fact(spark, sf_dir), "p_brand", "revenue", 10)
    return out.select("label", *_dbl("value"), "share_top", "share_total", "cum_pct", "rank")


@register("top_share_with_other", _TOP_SQL + """
SELECT label, CAST(value AS DOUBLE) AS value FROM top
UNION ALL
SELECT 'Other', CAST(total - (SELECT SUM(value) FROM top) AS DOUBLE) FROM t
WHERE total - (SELECT SUM(value) FROM top) > 0""")
def q_top_share_with_other(spark, sf_dir):
    """Top 10 brands plus the remainder as 'Other'."""
    out = top_share_with_other(fact(spark, sf_dir), "p_brand", "revenue", 10)
    return out.select("label", *_dbl("value"))


@register("region_channel", "WITH " + SALES_FACT_SQL + f""",
ch AS (SELECT CAST(o_orderpriority AS VARCHAR) AS ch, SUM({REV}) AS v FROM sales_fact GROUP BY 1),
kept AS (SELECT ch FROM ch ORDER BY v DESC, ch ASC LIMIT 3),
b AS (SELECT CAST(r_name AS VARCHAR) AS region,
             CASE WHEN CAST(o_orderpriority AS VARCHAR) IN (SELECT ch FROM kept) THEN CAST(o_orderpriority AS VARCHAR) ELSE 'Other' END AS channel,
             {REV} AS v FROM sales_fact),
cells AS (SELECT region, channel, SUM(v) AS value FROM b GROUP BY 1, 2),
regions AS (SELECT DISTINCT region FROM b),
channels AS (SELECT DISTINCT channel FROM b),
grid AS (SELECT r.region, c.channel, COALESCE(cells.value, 0) AS value
         FROM regions r CROSS JOIN channels c LEFT JOIN cells ON cells.region = r.region AND cells.channel = c.channel)
SELECT region, channel, CAST(value AS DOUBLE) AS value,
       CASE WHEN CAST(SUM(value) OVER (PARTITION BY region) AS DOUBLE) <> 0
            THEN CAST(value AS DOUBLE) / CAST(SUM(value) OVER (PARTITION BY region) AS DOUBLE) * 100.0 END AS share_pct
FROM grid""")
def q_region_channel(spark, sf_dir):
    """Region x channel revenue, top 3 channels plus Other, row shares."""
    out = region_channel(fact(spark, sf_dir), "r_name", "o_orderpriority", "revenue", 3)
    return out.select("region", "channel", *_dbl("value"), "share_pct")


@register("region_channel_gaps", "WITH " + SALES_FACT_SQL + f""",
f AS (SELECT CASE WHEN r_name = 'ASIA' THEN '(NA)' ELSE r_name END AS region,
             CASE WHEN o_orderpriority LIKE '5%' THEN '(NA)' WHEN o_orderpriority LIKE '1%' THEN 'Other' ELSE o_orderpriority END AS ch,
             {REV} AS v FROM sales_fact),
kept AS (SELECT ch FROM f GROUP BY 1 ORDER BY SUM(v) DESC, ch ASC LIMIT 2),
cells AS (SELECT region, CASE WHEN ch IN (SELECT ch FROM kept) THEN ch ELSE 'Other' END AS channel, SUM(v) AS value FROM f GROUP BY 1, 2),
grid AS (SELECT r.region, c.channel, COALESCE(cells.value, 0) AS value FROM (SELECT DISTINCT region FROM cells) r
         CROSS JOIN (SELECT DISTINCT channel FROM cells) c LEFT JOIN cells ON cells.region = r.region AND cells.channel = c.channel)
SELECT region, channel, CAST(value AS DOUBLE) AS value,
       CAST(value AS DOUBLE) / CAST(SUM(value) OVER (PARTITION BY region) AS DOUBLE) * 100.0 AS share_pct FROM grid""")
def q_region_channel_gaps(spark, sf_dir):
    """Region x channel with a missing region, a missing channel and a real channel called 'Other'."""
    f = fact(spark, sf_dir).withColumn("region", F.when(F.col("r_name") != "ASIA", F.col("r_name"))).withColumn(
        "channel", F.when(F.col("o_orderpriority").startswith("1"), "Other")
        .when(~F.col("o_orderpriority").startswith("5"), F.col("o_orderpriority")))
    out = region_channel(f, "region", "channel", "revenue", 2)
    return out.select("region", "channel", *_dbl("value"), "share_pct")


@register("custom_pivot_share", "WITH " + SALES_FACT_SQL + f""",
s AS (SELECT date_trunc('quarter', l_shipdate) AS x, SUM(l_extendedprice) AS y FROM sales_fact
      WHERE {VALID_T} GROUP BY 1)
SELECT x, ROUND(y, 4) AS y, ROUND(CASE WHEN SUM(y) OVER () > 0 THEN y / SUM(y) OVER () * 100.0 END, 9) AS z FROM s""")
def q_custom_pivot_share(spark, sf_dir):
    """Quarterly revenue (sum) with Z = % share of Y."""
    out = custom_pivot(fact(spark, sf_dir), "l_shipdate", "l_extendedprice", "sum", z_mode="share", freq="quarter")
    return out.select("x", F.round("y", 4).alias("y"), F.round("z", 9).alias("z"))


@register("custom_pivot_median", "WITH " + SALES_FACT_SQL + """
SELECT CAST(c_mktsegment AS VARCHAR) AS x, quantile_cont(l_extendedprice, 0.5) AS y,
       ROUND(AVG(l_quantity), 9) AS z
FROM sales_fact WHERE c_mktsegment IS NOT NULL GROUP BY 1""")
def q_custom_pivot_median(spark, sf_dir):
    """Median price per market segment with Z = mean quantity."""
    out = custom_pivot(fact(spark, sf_dir), "c_mktsegment", "l_extendedprice", "median",
                       z="l_quantity", z_agg="mean", z_mode="measure")
    return out.select("x", "y", F.round("z", 9).alias("z"))


@register("custom_pivot_count", "WITH " + SALES_FACT_SQL + f"""
SELECT date_trunc('year', l_shipdate) AS x, CAST(COUNT(*) AS DOUBLE) AS y, CAST(NULL AS DOUBLE) AS z
FROM sales_fact WHERE {VALID_T} GROUP BY 1""")
def q_custom_pivot_count(spark, sf_dir):
    """Rows per year (count counts rows)."""
    return custom_pivot(fact(spark, sf_dir), "l_shipdate", "l_extendedprice", "count", freq="year")


# ---------------------------------------------------------------- filters
ROW_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
ROW_KEY_SQL = ", ".join(ROW_KEY)


@register("drilldown_filter", "WITH " + SALES_FACT_SQL + f"""
SELECT {ROW_KEY_SQL}, r_name, c_mktsegment, l_shipdate, l_extendedprice FROM sales_fact
WHERE CAST(r_name AS VARCHAR) IN ('ASIA', 'EUROPE')
  AND CAST(c_mktsegment AS VARCHAR) IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')
  AND {VALID_T}
  AND CAST(year(l_shipdate) AS VARCHAR) || 'Q' || CAST(quarter(l_shipdate) AS VARCHAR) IN ('1996Q4', '1997Q1', '1999Q3')""")
def q_drilldown_filter(spark, sf_dir):
    """Rows of two regions, three segments and three chosen quarters."""
    out = drilldown_filter(fact(spark, sf_dir), {"r_name": ["ASIA", "EUROPE"],
                                                 "c_mktsegment": ["BUILDING", "MACHINERY", "HOUSEHOLD"],
                                                 "o_orderpriority": []},
                           time="l_shipdate", freq="quarter", periods=["1996Q4", "1997Q1", "1999Q3"])
    return out.select(*ROW_KEY, "r_name", "c_mktsegment", "l_shipdate", "l_extendedprice")


@register("period_filter", "WITH " + SALES_FACT_SQL + f""",
lab AS (SELECT DISTINCT strftime(l_shipdate, '%Y-%m') AS p FROM sales_fact WHERE {VALID_T}),
last3 AS (SELECT p FROM lab ORDER BY p DESC LIMIT 3)
SELECT {ROW_KEY_SQL}, l_shipdate, l_extendedprice FROM sales_fact
WHERE {VALID_T} AND strftime(l_shipdate, '%Y-%m') IN (SELECT p FROM last3)""")
def q_period_filter(spark, sf_dir):
    """Rows of the last three months present (the default period choice)."""
    out = period_filter(fact(spark, sf_dir), "l_shipdate", "month")
    return out.select(*ROW_KEY, "l_shipdate", "l_extendedprice")


@register("filter_options", """
SELECT COALESCE(CAST(o_custkey AS VARCHAR), 'nan') AS value, COUNT(*) AS n FROM orders
GROUP BY 1 ORDER BY n DESC, value ASC LIMIT 200""")
def q_filter_options(spark, sf_dir):
    """The 200 most frequent customers in orders."""
    return filter_options(load(spark, sf_dir, "orders"), "o_custkey", 200)


@register("distinct_values", """
SELECT DISTINCT lower(regexp_replace(trim(CAST(c_mktsegment AS VARCHAR)), '\\s+', ' ', 'g')) AS value
FROM customer WHERE c_mktsegment IS NOT NULL""")
def q_distinct_values(spark, sf_dir):
    """Distinct normalised market segments."""
    return distinct_values(load(spark, sf_dir, "customer"), "c_mktsegment", normalize=True)


@register("year_scope", """
SELECT o_orderkey, o_orderdate, o_totalprice FROM orders
WHERE year(o_orderdate) = (SELECT MAX(year(o_orderdate)) FROM orders WHERE year(o_orderdate) BETWEEN 1900 AND 2100)""")
def q_year_scope(spark, sf_dir):
    """Orders of the latest year (the default scope)."""
    return year_scope(load(spark, sf_dir, "orders"), "o_orderdate").select("o_orderkey", "o_orderdate", "o_totalprice")


@register("bucket_other", "WITH " + SALES_FACT_SQL + f""",
top AS (SELECT CAST(p_brand AS VARCHAR) AS v FROM sales_fact WHERE p_brand IS NOT NULL
        GROUP BY 1 ORDER BY COUNT(*) DESC, v ASC LIMIT 5)
SELECT {ROW_KEY_SQL}, CASE WHEN CAST(p_brand AS VARCHAR) IN (SELECT v FROM top) THEN CAST(p_brand AS VARCHAR)
                          WHEN p_brand IS NOT NULL THEN 'Other' END AS p_brand
FROM sales_fact""")
def q_bucket_other(spark, sf_dir):
    """Brands outside the 5 most frequent become 'Other'."""
    return bucket_other(fact(spark, sf_dir), "p_brand", 5).select(*ROW_KEY, "p_brand")


@register("bucket_other_by_value", "WITH " + SALES_FACT_SQL + f""",
top AS (SELECT CAST(o_orderpriority AS VARCHAR) AS v FROM sales_fact WHERE o_orderpriority IS NOT NULL
        GROUP BY 1 ORDER BY SUM({REV}) DESC, v ASC LIMIT 3)
SELECT {ROW_KEY_SQL}, CASE WHEN CAST(o_orderpriority AS VARCHAR) IN (SELECT v FROM top) THEN CAST(o_orderpriority AS VARCHAR)
                          WHEN o_orderpriority IS NOT NULL THEN 'Other' END AS channel
FROM sales_fact""")
def q_bucket_other_by_value(spark, sf_dir):
    """Channels outside the top 3 by revenue become 'Other'."""
    out = bucket_other(fact(spark, sf_dir), "o_orderpriority", 3, by="revenue", out="channel")
    return out.select(*ROW_KEY, "channel")


@register("map_values", LEDGER_B_SQL + f"""
SELECT {ROW_KEY_SQL}, value_type, CAST(sales_b AS DOUBLE) AS sales_b, CAST(disc_b AS DOUBLE) AS disc_b
FROM ledger_b""")
def q_map_values(spark, sf_dir):
    """Ledger rows split into Sales(B) and Discount(B) by normalised value type."""
    out = ledger_b(spark, sf_dir)
    return out.select(*ROW_KEY, "value_type", *_dbl("sales_b", "disc_b"))


# ---------------------------------------------------------------- cleaning
@register("to_numeric", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       CASE WHEN l_returnflag = 'R' THEN 'n/a' ELSE ' ' || format('{:,.2f}', l_extendedprice) || ' ' END AS raw,
       TRY_CAST(replace(trim(CASE WHEN l_returnflag = 'R' THEN 'n/a' ELSE ' ' || format('{:,.2f}', l_extendedprice) || ' ' END), ',', '') AS DOUBLE) AS v
FROM lineitem""")
def q_to_numeric(spark, sf_dir):
    """Text amounts with thousands separators (and junk for returned lines) parsed back."""
    li = load(spark, sf_dir, "lineitem")
    raw = F.when(F.col("l_returnflag") == "R", F.lit("n/a")).otherwise(
        F.concat(F.lit(" "), F.format_number("l_extendedprice", 2), F.lit(" ")))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", raw.alias("raw"),
                     to_numeric(raw).alias("v"))


@register("clean_time", """
WITH r AS (SELECT o_orderkey,
  CASE o_orderpriority WHEN '1-URGENT' THEN '1899' || substr(strftime(o_orderdate, '%Y-%m-%d'), 5)
                       WHEN '2-HIGH' THEN 'zz'
                       WHEN '3-MEDIUM' THEN strftime(o_orderdate, '%Y') || '-02-30'
                       ELSE strftime(o_orderdate, '%Y-%m-%d') END AS raw FROM orders)
SELECT o_orderkey, raw,
       CASE WHEN year(TRY_CAST(raw AS TIMESTAMP)) BETWEEN 1900 AND 2100 THEN TRY_CAST(raw AS TIMESTAMP) END AS t
FROM r""")
def q_clean_time(spark, sf_dir):
    """Order dates as text with out-of-range years, junk and impossible days."""
    o = load(spark, sf_dir, "orders")
    d = F.date_format("o_orderdate", "yyyy-MM-dd")
    raw = (F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("1899"), F.substring(d, 5, 6)))
            .when(F.col("o_orderpriority") == "2-HIGH", F.lit("zz"))
            .when(F.col("o_orderpriority") == "3-MEDIUM", F.concat(F.date_format("o_orderdate", "yyyy"), F.lit("-02-30")))
            .otherwise(d))
    return o.select("o_orderkey", raw.alias("raw"), clean_time(raw).cast("timestamp_ntz").alias("t"))


@register("normalize_text", """
SELECT p_partkey, lower(regexp_replace(trim('  ' || upper(p_brand) || ' \t ' || p_type || '  '), '\\s+', ' ', 'g')) AS s
FROM part""")
def q_normalize_text(spark, sf_dir):
    """Brand and type joined with mixed blanks and case, normalised."""
    p = load(spark, sf_dir, "part")
    raw = F.concat(F.lit("  "), F.upper("p_brand"), F.lit(" \t "), F.col("p_type"), F.lit("  "))
    return p.select("p_partkey", normalize_text(raw).alias("s"))


@register("clean_values", """
SELECT c_custkey, ROUND(log10(c_acctbal), 9) AS v FROM customer
WHERE c_acctbal IS NOT NULL AND c_acctbal >= 0 AND c_acctbal <> 0 AND c_acctbal > 0""")
def q_clean_values(spark, sf_dir):
    """Account balances without negatives and zeros, on a log10 scale."""
    c = clean_values(load(spark, sf_dir, "customer"), "c_acctbal", drop_neg=True, drop_zero=True, log10=True)
    return c.select("c_custkey", F.round("v", 9).alias("v"))
