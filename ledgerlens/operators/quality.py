"""Data-quality profile and column typing (§2.4 data_quality, §2.2
infer_column_types).

Counts of all columns come from **one** aggregation, then unpivoted to one row
per column. Exact distinct counts come from a second scan that sends
(column, 128-bit digest of the value), de-duplicated in the tasks and again in
the shuffle: 20 bytes a value, where a distinct count per column in one
aggregate would expand every row to as many rows of all columns.
``approx_distinct=True`` swaps in HyperLogLog sketches for very wide tables.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DATETIME_NAME = re.compile(r"(date|time)", re.I)


def column_type(field: T.StructField) -> str:
    """Numeric / Datetime / Boolean / Text from the declared type, then the
    name (a non-numeric column named like *date* or *time* is Datetime)."""
    dt = field.dataType
    if isinstance(dt, T.NumericType):
        return "Numeric"
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "Datetime"
    if DATETIME_NAME.search(field.name):
        return "Datetime"
    if isinstance(dt, T.BooleanType):
        return "Boolean"
    return "Text"


def _present(field: T.StructField):
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        return c.isNotNull() & ~F.isnan(c)
    return c.isNotNull()


DIGEST_BATCH = 50       # columns whose digests one scan sends


def _digest(field: T.StructField):
    """Two 64-bit hashes of a present value, null for others; equal values have equal ones."""
    c = F.col(f"`{field.name}`")
    plain = F.to_json(c) if "map" in field.dataType.simpleString() else c
    return F.when(_present(field), F.struct(F.xxhash64(plain).alias("a"), F.xxhash64(F.lit("second"), plain).alias("b")))


def distinct_counts(df: DataFrame, fields: Sequence[T.StructField]) -> DataFrame:
    """(column, n_unique) of the non-null values of each field."""
    out = None
    for at in range(0, len(fields), DIGEST_BATCH):
        batch = fields[at:at + DIGEST_BATCH]
        cells = F.array(*[F.struct(F.lit(at + i).alias("i"), _digest(f).alias("d")) for i, f in enumerate(batch)])
        seen = df.select(F.explode(cells).alias("x")).where("x.d is not null").select("x.i", "x.d.a", "x.d.b").distinct()
        part = seen.groupBy("i").agg(F.count(F.lit(1)).alias("n_unique"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        return df.sparkSession.createDataFrame([], "column string, n_unique long")
    names = df.sparkSession.createDataFrame([(i, f.name) for i, f in enumerate(fields)], "i int, column string")
    return names.join(F.broadcast(out), "i", "left").select("column", F.coalesce("n_unique", F.lit(0)).alias("n_unique"))


def data_quality(df: DataFrame, columns: Sequence[str] | None = None, approx_distinct: bool = False) -> DataFrame:
    """Per column: type, n_rows, valid, valid_pct, nan, nan_pct, blank,
    blank_pct (Text only), zero, zero_pct (Numeric only), n_unique (non-null
    distinct). Text valid = non-null − blank; shares rounded to 4 places."""
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, f in enumerate(fields):
        c = F.col(f"`{f.name}`")
        present = _present(f)
        kind = column_type(f)
        aggs.append(F.sum(present.cast("long")).alias(f"nn{i}"))
        if kind == "Text":
            aggs.append(F.sum((present & (F.trim(c.cast("string")) == "")).cast("long")).alias(f"bl{i}"))
        else:
            aggs.append(F.lit(None).cast("long").alias(f"bl{i}"))
        if kind == "Numeric":
            aggs.append(F.sum((present & (c == 0)).cast("long")).alias(f"ze{i}"))
        else:
            aggs.append(F.lit(None).cast("long").alias(f"ze{i}"))
        if approx_distinct:
            aggs.append(F.approx_count_distinct(F.when(present, c)).alias(f"du{i}"))
    wide = df.agg(*aggs)
    rows = []
    for i, f in enumerate(fields):
        rows.append(F.struct(F.lit(f.name).alias("column"), F.lit(column_type(f)).alias("type"),
                             F.col(f"nn{i}").alias("nn"), F.col(f"bl{i}").alias("bl"),
                             F.col(f"ze{i}").alias("ze"), *([F.col(f"du{i}").alias("du")] if approx_distinct else [])))
    long = wide.select("_n", F.inline(F.array(*rows)))
    if not approx_distinct:
        long = long.join(distinct_counts(df, fields).withColumnRenamed("n_unique", "du"), "column")
    n = F.col("_n")

    def pct(x):
        return F.when(n > 0, F.round(x / n, 4))

    nn = F.coalesce(F.col("nn"), F.lit(0).cast("long"))
    valid = F.when(F.col("type") == "Text", nn - F.coalesce(F.col("bl"), F.lit(0))).otherwise(nn)
    nan = n - nn
    return long.select(
        "column", "type", n.alias("n_rows"), valid.alias("valid"), pct(valid).alias("valid_pct"),
        nan.alias("nan"), pct(nan).alias("nan_pct"), F.col("bl").alias("blank"), pct(F.col("bl")).alias("blank_pct"),
        F.col("ze").alias("zero"), pct(F.col("ze")).alias("zero_pct"), F.col("du").alias("n_unique"))


def infer_column_types(df: DataFrame, min_rate: float = 0.5) -> DataFrame:
    """(column, type, parse_rate). Declared type and name decide first; a
    remaining Text column is Datetime when at least ``min_rate`` of its rows
    parse as a timestamp (missing values count against). All text columns are
    tried in one aggregation over all rows."""
    fields = df.schema.fields
    text = [f for f in fields if column_type(f) == "Text" and isinstance(f.dataType, T.StringType)]
    rates = {}
    if text:
        r = df.agg(*[F.avg(F.try_to_timestamp(F.col(f"`{f.name}`")).isNotNull().cast("double")).alias(f"r{i}")
                       for i, f in enumerate(text)]).first()
        rates = {f.name: r[f"r{i}"] for i, f in enumerate(text)}
    spark = df.sparkSession
    rows = []
    for f in fields:
        kind = column_type(f)
        rate = rates.get(f.name)
        if rate is not None and rate >= min_rate:
            kind = "Datetime"
        rows.append((f.name, kind, None if rate is None else float(rate)))
    return spark.createDataFrame(rows, "column string, type string, parse_rate double")
