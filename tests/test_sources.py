"""Loading, typing and snapshot operators as round trips."""

import datetime

from pyspark.sql import functions as F

from ledgerlens.sources import tables


def test_csv_round_trip(spark, tmp_path):
    path = str(tmp_path / "in.csv")
    spark.createDataFrame([("a", "1", "2024-01-02"), ("b", "x", None)], "k string, n string, d string").coalesce(1) \
        .write.option("header", True).csv(path)
    df = tables.read_csv(spark, path)
    assert df.columns == ["k", "n", "d"] and df.count() == 2
    assert tables.preview(df, 1).count() == 1
    assert tables.select_columns(df, ["n", "k"]).columns == ["n", "k"]
    typed = tables.apply_dtype_map(df, {"n": "bigint", "d": "date"})
    assert sorted((r.n, r.d) for r in typed.collect() if r.n is not None) == [(1, datetime.date(2024, 1, 2))]


def test_sanitize_and_snapshot(spark, tmp_path):
    df = spark.range(3).select(F.col("id"), F.array("id", "id").alias("a"), F.lit(bytearray(b"ab")).alias("b"))
    clean = tables.sanitize(df)
    assert dict(clean.dtypes)["a"] == "string" and dict(clean.dtypes)["b"] == "string"
    small = tables.narrow_types(clean)
    assert dict(small.dtypes)["id"] in ("int", "smallint", "tinyint")
    path = str(tmp_path / "snap")
    tables.snapshot_parquet(small, path)
    back = spark.read.parquet(path)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, small.collect()), key=str)


def test_keyed_snapshot(spark, tmp_path):
    """The second call reads no source file, a changed row is a new snapshot, a cut-off write is ignored."""
    import os
    import shutil

    source, folder = str(tmp_path / "source"), str(tmp_path / "snaps")
    make = lambda last: spark.range(20).select(
        "id", F.when(F.col("id") == 19, F.lit(last)).otherwise(F.col("id") * 2).alias("v"),
        F.expr("timestamp'2024-01-15' + make_dt_interval(cast(id as int) * 5)").alias("t"), F.array("id").alias("a"))
    make(1).repartition(3).write.parquet(source)
    first = tables.keyed_snapshot(spark.read.parquet(source), folder, ["id", "v", "t"], month_of="t")
    assert first.count() == 20 and first.columns == ["id", "v", "t", "snapshot_month"]
    plan = first.where("snapshot_month = '2024-02'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(snapshot_month" in plan
    # the same files again: only their names, lengths and times are looked at
    df = spark.read.parquet(source)
    texts = {}
    for name in os.listdir(source):
        path = os.path.join(source, name)
        texts[name] = open(path, "rb").read()
        stat = os.stat(path)
        open(path, "wb").write(b"x" * len(texts[name]))
        os.utime(path, ns=(stat.st_atime_ns, stat.st_mtime_ns))
    again = tables.keyed_snapshot(df, folder, ["id", "v", "t"], month_of="t")
    assert sorted(again.inputFiles()) == sorted(first.inputFiles()) and again.count() == 20
    for name, text in texts.items():
        open(os.path.join(source, name), "wb").write(text)
    # equal content from other files: not written twice; the order of rows does not matter
    other = str(tmp_path / "other")
    make(1).orderBy(F.desc("id")).coalesce(1).write.parquet(other)
    same = tables.keyed_snapshot(spark.read.parquet(other), folder, ["id", "v", "t"], month_of="t")
    assert sorted(same.inputFiles()) == sorted(first.inputFiles())
    changed = str(tmp_path / "changed")
    make(2).write.parquet(changed)
    new = tables.keyed_snapshot(spark.read.parquet(changed), folder, ["id", "v", "t"], month_of="t")
    assert set(new.inputFiles()).isdisjoint(first.inputFiles()) and new.where("v = 2 and id = 19").count() == 1
    # other columns, and a table without files
    assert tables.keyed_snapshot(spark.read.parquet(changed), folder, ["id", "a"]).count() == 20
    assert tables.keyed_snapshot(spark.range(4), folder).count() == 4 and tables.keyed_snapshot(spark.range(4), folder).count() == 4
    # data without a mark do not count
    data = str(tmp_path / "half")
    make(3).write.parquet(data)
    key = tables.content_digest(spark.read.parquet(data))
    shutil.copytree(data, f"{folder}/data/{key}-half")
    whole = tables.keyed_snapshot(spark.read.parquet(data), folder)
    assert not any("-half" in f for f in whole.inputFiles()) and whole.count() == 20


def test_content_digest(spark):
    rows = [(1, None, "a"), (2, 3, None), (2, 3, None)]
    of = lambda r: tables.content_digest(spark.createDataFrame(r, "x int, y int, z string"))
    assert of(rows) == of(rows[::-1])
    others = [rows[:2], rows + rows[:1], [(1, 1, "a"), *rows[1:]], [(None, 1, "a"), *rows[1:]]]
    assert len({of(r) for r in [rows, *others]}) == 5
