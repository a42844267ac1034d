"""Session settings, reliable checkpoints and broadcast bounds."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings every ledgerlens session needs: UTC so period truncation matches
# other engines, AQE for runtime coalescing and skew-join splitting.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, partitions: int = 8, app: str = "ledgerlens",
                extra: dict | None = None) -> SparkSession:
    """Local session for tests and benchmarks (a cluster brings its own)."""
    b = SparkSession.builder.master(master or "local[8]").appName(app)
    for k, v in SESSION_CONF.items():
        b = b.config(k, v)
    b = b.config("spark.sql.shuffle.partitions", str(partitions))
    b = b.config("spark.driver.memory", "8g")
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Checkpoint folder named by the session (``spark.checkpoint.dir``).

    A cluster names a shared folder there. Only a local-mode session with no
    setting gets a private temporary folder; a cluster session without one is
    an error, since a machine-local folder would not survive executor loss.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        sc.setCheckpointDir(named)
        return sc.getCheckpointDir()
    if sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerlens-ckpt-"))
        return sc.getCheckpointDir()
    raise RuntimeError("set spark.checkpoint.dir to a shared folder before running ledgerlens")


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package (once per application), so that Python
    functions find their modules wherever the driver was started."""
    import zipfile

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="ledgerlens-"), "ledgerlens.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("ledgerlens", os.path.relpath(path, root)))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the session's checkpoint folder and cut lineage.

    Used where later steps depend on a non-deterministic value (a partition
    id) that must not change if a task is re-run after executor loss.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def bounded_broadcast(df: DataFrame, bound: int, what: str) -> DataFrame:
    """Broadcast hint for a side whose row count is bounded by construction.

    ``bound`` is the structural limit (digit domain, partition count, top-N,
    one summary row); it is recorded here so every broadcast states its bound.
    """
    if bound > 1_000_000:
        raise ValueError(f"{what}: bound {bound} too large to broadcast")
    return F.broadcast(df)


SMALL_ROWS = 10_000


def small_side(table: DataFrame, rows: int | None = None) -> DataFrame:
    """A table of a few numbers a row, with a broadcast hint when it has at
    most SMALL_ROWS rows (``rows`` where that is known, else they are counted);
    else as it is, for a shuffle join."""
    if rows is None:
        rows = table.limit(SMALL_ROWS + 1).count()
    return F.broadcast(table) if rows <= SMALL_ROWS else table
