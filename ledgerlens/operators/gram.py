"""Pairwise sums of many columns in one pass (a Gram matrix).

Tasks read Arrow batches of the columns, add up products of whole matrices and
send one block of k x k sums; blocks are added in two levels, so the driver
gets about the root of the number of partitions of them, whatever the table's
size. Values are shifted by the columns' means before they are multiplied.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIRECT = 32             # partial sums that go straight to the driver; more are added up in tasks first


def _columns(batch: pa.RecordBatch, k: int) -> np.ndarray:
    return np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(k)])


def tree_sum(partials: DataFrame, shape: tuple[int, ...], parts: int) -> np.ndarray:
    """Sum of the arrays in the column ``sums`` of one-row partitions."""
    size = int(np.prod(shape))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size)
        for batch in batches:
            for b in batch.column("sums"):
                out += np.frombuffer(b.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["sums"])

    if parts > DIRECT:
        partials = partials.repartition(math.isqrt(parts - 1) + 1).mapInArrow(add, "sums binary")
    return sum((np.frombuffer(r.sums) for r in partials.collect()), np.zeros(size)).reshape(shape)


def pair_sums(df: DataFrame, cols: Sequence[str], weight: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(n, r): for each pair of numeric columns the number of rows where both
    are present, and their Pearson correlation over these (NaN where one does
    not vary). ``weight``: a column of row multiplicities."""
    k = len(cols)
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    rows = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)], w.alias("w"))
    means = rows.agg(*[F.avg(f"c{i}").alias(f"m{i}") for i in range(k)]).first()
    shift = np.array([m or 0.0 for m in means])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((4, k, k))
        for batch in batches:
            x = _columns(batch, k) - shift
            there = ~np.isnan(x)
            x = np.where(there, x, 0.0)
            m = there.astype(np.float64)
            times = batch.column(k).to_numpy(zero_copy_only=False)[:, None]
            out += np.stack([m.T @ (m * times), x.T @ (m * times), (x * x).T @ (m * times), x.T @ (x * times)])
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["sums"])

    n, sx, sxx, sxy = tree_sum(rows.mapInArrow(partial, "sums binary"), (4, k, k), rows.rdd.getNumPartitions())
    with np.errstate(invalid="ignore", divide="ignore"):
        var = sxx - sx * sx / n
        var = np.where(var > 1e-14 * sxx, var, 0.0)         # rounding of a constant column
        r = (sxy - sx * sx.T / n) / np.sqrt(var * var.T)
        return n, np.where((var > 0) & (var.T > 0), np.clip(r, -1, 1), np.nan)
