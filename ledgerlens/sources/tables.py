"""Scans and sinks: parquet tables, headered CSV, parquet snapshots, and the
load-time column transforms (whitelist, dtype map, sanitize, narrowing)."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; parquet, so filters and projections reach the scan."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None,
             schema: T.StructType | str | None = None, multiline: bool = False) -> DataFrame:
    """Headered CSV. With a schema nothing is inferred (one pass); without one
    the schema is inferred, which costs an extra read. ``multiline``: values
    may hold line breaks and doubled quotes (a file is then not split)."""
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    if multiline:
        reader = reader.option("multiLine", True).option("escape", '"')
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    df = reader.csv(path)
    return select_columns(df, columns) if columns else df


def preview(df: DataFrame, n: int = 100, order: Sequence[str] | None = None) -> DataFrame:
    """First n rows; give ``order`` for a stable answer."""
    return (df.orderBy(*order) if order else df).limit(n)


def select_columns(df: DataFrame, columns: Sequence[str] | None = None,
                   name_contains: str | None = None) -> DataFrame:
    """Whitelist of columns and/or a case-insensitive substring on names."""
    cols = list(columns) if columns else list(df.columns)
    if name_contains:
        cols = [c for c in cols if name_contains.lower() in c.lower()]
    return df.select(*[F.col(f"`{c}`") for c in cols])


def apply_dtype_map(df: DataFrame, dtypes: dict[str, str]) -> DataFrame:
    """Cast by a {column: type} map; a value that does not convert becomes null
    (``try_cast``) instead of failing the job."""
    out = []
    for c in df.columns:
        if c in dtypes:
            out.append(F.expr(f"try_cast(`{c}` as {dtypes[c]})").alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    return df.select(*out)


def sanitize(df: DataFrame) -> DataFrame:
    """Binary → UTF-8 text; struct/array/map → JSON text. Other columns pass."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.BinaryType):
            out.append(F.decode(c, "UTF-8").alias(f.name))
        elif isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
            out.append(F.to_json(c).alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


_INT_STEPS = (("tinyint", -(2 ** 7), 2 ** 7 - 1), ("smallint", -(2 ** 15), 2 ** 15 - 1),
              ("int", -(2 ** 31), 2 ** 31 - 1))


def narrow_types(df: DataFrame, floats: bool = False) -> DataFrame:
    """Cast integer columns to the smallest integer type that holds their range.

    One aggregation pass finds min/max of every integral column; the casts
    then run as a projection. Float narrowing is opt-in (it loses cents)."""
    ints = [f.name for f in df.schema.fields
            if isinstance(f.dataType, (T.LongType, T.IntegerType, T.ShortType))]
    dbls = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)] if floats else []
    if not ints and not dbls:
        return df
    aggs = []
    for c in ints:
        aggs += [F.min(c).alias(f"{c}__min"), F.max(c).alias(f"{c}__max")]
    bounds = df.agg(*aggs).first() if aggs else None
    casts = {}
    for c in ints:
        lo, hi = bounds[f"{c}__min"], bounds[f"{c}__max"]
        if lo is None:
            continue
        for t, tlo, thi in _INT_STEPS:
            if tlo <= lo and hi <= thi:
                casts[c] = t
                break
    for c in dbls:
        casts[c] = "float"
    return df.select(*[F.col(c).cast(casts[c]).alias(c) if c in casts else F.col(c) for c in df.columns])


def snapshot_parquet(df: DataFrame, path: str) -> DataFrame:
    """Write a cleaned table once and read it back (the reload is a plain,
    pushdown-capable parquet scan)."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def content_digest(df: DataFrame) -> str:
    """Key of a table's content, whatever the order of its rows: schema, number
    of rows, and two sums and an xor of row hashes. A changed, added, dropped
    or repeated row gives another key."""
    cols = [F.to_json(F.col(f"`{f.name}`")) if "map" in f.dataType.simpleString() else F.col(f"`{f.name}`")
            for f in df.schema.fields]
    # a null is hashed as itself: xxhash64 alone passes over nulls, so their places go in, too
    nulls = F.concat(*[c.isNull().cast("int").cast("string") for c in cols]) if cols else F.lit("")
    a, b = F.xxhash64(nulls, *cols), F.xxhash64(F.lit("second"), nulls, *cols)
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(a.cast("decimal(38,0)")).alias("a"),
               F.sum(b.cast("decimal(38,0)")).alias("b"), F.bit_xor(a).alias("x")).first()
    text = "|".join(map(str, (df.schema.json(), r["n"], r["a"], r["b"], r["x"])))
    return hashlib.sha256(text.encode()).hexdigest()


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def source_key(df: DataFrame, columns: Sequence[str]) -> str | None:
    """Key of what a table is read from: its files with their lengths and
    times, the schema, the columns and the plan. None for a table without
    files. No file is opened."""
    spark, marks = df.sparkSession, []
    for name in sorted(df.inputFiles()):
        fs, where = _file_system(spark, name)
        status = fs.getFileStatus(where)
        marks.append((name, status.getLen(), status.getModificationTime()))
    text = repr((marks, df.schema.json(), list(columns), df.semanticHash()))
    return hashlib.sha256(text.encode()).hexdigest() if marks else None


def _read_mark(spark: SparkSession, path: str) -> str | None:
    fs, where = _file_system(spark, path)
    return spark.read.text(path).first()[0] if fs.exists(where) else None


def _write_mark(spark: SparkSession, path: str, text: str) -> None:
    """One small file, put in place whole: written aside, then renamed."""
    aside = f"{path}-{uuid.uuid4().hex}"
    fs, where = _file_system(spark, aside)
    out = fs.create(where, True)
    out.write(bytearray((text + "\n").encode()))
    out.close()
    if not fs.rename(where, _file_system(spark, path)[1]):
        fs.delete(where, True)          # another writer was first; its mark names the same content


def keyed_snapshot(df: DataFrame, folder: str, columns: Sequence[str] | None = None, month_of: str | None = None) -> DataFrame:
    """Snapshot of a table (or some columns) in ``folder``, keyed by content.

    A call on files that were taken before finds their snapshot by their names,
    lengths and times, and reads no source file. Otherwise the content digest
    decides: equal content is not written twice, a changed row makes a new
    snapshot. Data go to a folder of their own and count only once the mark
    that names it is there, so a write that was cut off is never read.
    ``month_of`` names a time column: the snapshot is partitioned by
    ``snapshot_month`` (yyyy-MM, null where the time is), by which a filter
    skips the other months' files."""
    spark = df.sparkSession
    columns = list(columns) if columns else df.columns
    chosen = select_columns(df, columns)
    if month_of is not None:
        chosen = chosen.withColumn("snapshot_month", F.date_format(month_of, "yyyy-MM"))
    reader = spark.read.schema(chosen.schema)
    probe = source_key(chosen, columns)
    data = probe and _read_mark(spark, f"{folder}/sources/{probe}")
    if not data:
        key = content_digest(chosen)
        data = _read_mark(spark, f"{folder}/contents/{key}")
        if not data:
            data = f"{folder}/data/{key}-{uuid.uuid4().hex}"
            writer = chosen.write.partitionBy("snapshot_month") if month_of is not None else chosen.write
            writer.parquet(data)
            _write_mark(spark, f"{folder}/contents/{key}", data)
        if probe:
            _write_mark(spark, f"{folder}/sources/{probe}", data)
    return reader.parquet(data)
