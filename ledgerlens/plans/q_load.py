"""Load-operator queries: scans, typing, text forms and snapshots.

Queries that write (a CSV copy, a snapshot) put their files under the session's
checkpoint folder, the one place that all executors of a cluster share.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerlens.operators.filters import revenue_for_charts
from ledgerlens.plans.q_overview import LEDGER_B_SQL, ledger_b
from ledgerlens.plans.registry import register
from ledgerlens.plans.runtime import ensure_checkpoint_dir
from ledgerlens.sources.tables import (apply_dtype_map, keyed_snapshot, load, narrow_types, preview, read_csv, sanitize,
                                       select_columns)


def _folder(spark, name):
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@register("read_csv", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def q_read_csv(spark, sf_dir):
    """Customers written as headered CSV and read back with a schema, three columns of five."""
    path = _folder(spark, "csv")
    customer = load(spark, sf_dir, "customer")
    customer.write.option("header", True).csv(path)
    return read_csv(spark, path, ["c_custkey", "c_name", "c_acctbal"], schema=customer.schema)


@register("read_csv_inferred", "SELECT page_id, url, html FROM pages")
def q_read_csv_inferred(spark, sf_dir):
    """Web pages (long text with quotes and line breaks) through CSV with an inferred schema."""
    path = _folder(spark, "csv")
    load(spark, sf_dir, "pages").write.option("header", True).option("escape", '"').csv(path)
    return read_csv(spark, path, ["page_id", "url", "html"], multiline=True).withColumn("page_id", F.col("page_id").cast("long"))


@register("preview", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 100")
def q_preview(spark, sf_dir):
    """First 100 orders by key."""
    return preview(load(spark, sf_dir, "orders"), 100, ["o_orderkey"])


@register("select_columns", "SELECT c_custkey, c_nationkey FROM customer")
def q_select_columns(spark, sf_dir):
    """Customer columns whose names contain KEY, in any case."""
    return select_columns(load(spark, sf_dir, "customer"), name_contains="KEY")


_RAW_SQL = """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'x' || o_orderkey ELSE CAST(o_orderkey AS VARCHAR) END AS num,
  CASE WHEN o_orderkey % 5 = 0 THEN 'soon' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders"""


@register("apply_dtype_map", f"SELECT o_orderkey, TRY_CAST(num AS BIGINT) AS num, TRY_CAST(day AS DATE) AS day FROM ({_RAW_SQL})")
def q_apply_dtype_map(spark, sf_dir):
    """Text columns of orders cast by a map; what does not convert is null."""
    o = load(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    raw = o.select(key, F.when(key % 7 == 0, F.concat(F.lit("x"), key.cast("string"))).otherwise(key.cast("string")).alias("num"),
                   F.when(key % 5 == 0, F.lit("soon")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"))
    return apply_dtype_map(raw, {"num": "bigint", "day": "date"})


@register("sanitize", """SELECT doc_id, CAST(to_json([quality, toxic]) AS VARCHAR) AS marks,
  CAST(to_json({'quality': quality, 'toxic': toxic}) AS VARCHAR) AS named, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS word FROM labels""")
def q_sanitize(spark, sf_dir):
    """An array, a struct and a binary column of labels as text."""
    word = F.when(F.col("quality") == 1, "good").otherwise("bad")
    return sanitize(load(spark, sf_dir, "labels").select(
        "doc_id", F.array("quality", "toxic").alias("marks"), F.struct("quality", "toxic").alias("named"),
        F.encode(word, "UTF-8").alias("word")))


@register("sanitize_pages", "SELECT page_id, url, html FROM pages")
def q_sanitize_pages(spark, sf_dir):
    """Pages with their text as UTF-8 bytes, decoded."""
    return sanitize(load(spark, sf_dir, "pages").select("page_id", "url", F.encode("html", "UTF-8").alias("html")))


@register("narrow_types", "SELECT CAST(n_nationkey AS TINYINT) AS n_nationkey, n_name, CAST(n_regionkey AS TINYINT) AS n_regionkey, "
                          "(SELECT COUNT(*) FROM customer) AS customers FROM nation")
def q_narrow_types(spark, sf_dir):
    """Nation keys narrowed to a byte each, beside the number of customers."""
    small = narrow_types(load(spark, sf_dir, "nation"))
    n = load(spark, sf_dir, "customer").agg(F.count(F.lit(1)).alias("customers"))
    return small.crossJoin(F.broadcast(n))          # one row


@register("snapshot_parquet", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, strftime(o_orderdate, '%Y-%m') AS snapshot_month "
                              "FROM orders WHERE strftime(o_orderdate, '%Y-%m') IN ('1996-02', '1998-11')")
def q_snapshot_parquet(spark, sf_dir):
    """Orders' snapshot by content, found again by the second call; two months of it."""
    folder = _folder(spark, "snapshots")
    columns = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"]
    keyed_snapshot(load(spark, sf_dir, "orders"), folder, columns, month_of="o_orderdate")
    again = keyed_snapshot(load(spark, sf_dir, "orders"), folder, columns, month_of="o_orderdate")
    return again.where(F.col("snapshot_month").isin("1996-02", "1998-11"))


@register("snapshot_embeddings", "SELECT vec_id, len(embedding) AS dims, label FROM embeddings")
def q_snapshot_embeddings(spark, sf_dir):
    """Snapshot of a table with an array column."""
    found = keyed_snapshot(load(spark, sf_dir, "embeddings"), _folder(spark, "snapshots"))
    return found.select("vec_id", F.size("embedding").alias("dims"), "label")


@register("revenue_for_charts", LEDGER_B_SQL + """
SELECT r_name, round(SUM(CAST(sales_b AS DOUBLE)), 2) AS mapped, round(SUM(l_extendedprice), 2) AS plain FROM ledger_b GROUP BY r_name""")
def q_revenue_for_charts(spark, sf_dir):
    """Chart revenue by region: the mapped sales, and the raw revenue without a mapping."""
    led = ledger_b(spark, sf_dir)
    mapped, plain = revenue_for_charts(led, "l_extendedprice", "sales_b"), revenue_for_charts(led, "l_extendedprice")
    return led.groupBy("r_name").agg(F.round(F.sum(mapped.cast("double")), 2).alias("mapped"), F.round(F.sum(plain), 2).alias("plain"))
