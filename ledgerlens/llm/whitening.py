"""Embedding whitening by Chebyshev-filtered subspace iteration.

The covariance matrix is never formed. A block Q of a few columns is
multiplied by it in distributed passes over the fit list,
V Q = sum (x - S/n) ((x - S/n)' Q) / n, and between passes the three-term
Chebyshev recurrence on [0, a] damps every eigenvector whose eigenvalue lies
under a (the smallest Ritz value of the block), while those above grow
fastest. After each filter: QR, one pass, Rayleigh-Ritz, residuals; the
iteration ends when the wanted pairs are certified by their residuals.

The driver holds blocks of (dimensions x columns) numbers, the sums of one
pass; vectors stay in the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.plans.runtime import reliable_checkpoint, shuffle_partitions

COMPONENTS = 4
GUARD = 12              # further columns of the block: their smallest Ritz value is the filter's edge
DEGREE = 24             # most passes between two Rayleigh-Ritz steps
GROWTH = 1e10           # most amplification between the block's ends in one filter: keeps QR well conditioned
CERTIFIED = 1e-12       # an eigenvector's error: its residual over its distance to the spectrum outside the block
STALLED = 1e-11         # a residual (over the largest eigenvalue) that no longer falls is accepted from here on: rounding
NOTHING = 1e-13         # an eigenvalue under this share of the trace is none: rounding of a constant direction
CYCLES = 200
BLOB = 4 << 20          # bytes of one packed block of vectors
PARTITION = 64 << 20    # bytes of the fit list that a task reads in a pass
DIRECT = 64             # partial sums that go straight to the driver; more are added up in tasks first


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, x): x = floor(256 c) of every entry, for rows whose vector is
    there and has finite entries only (that fit a long after scaling)."""
    c = F.transform(embeddings["embedding"], lambda e: F.lit(256.0) * e.cast("double"))
    bad = F.exists("_c", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) >= F.lit(2.0 ** 63)))
    rows = embeddings.select(embeddings["vec_id"].cast("long").alias("vec_id"), c.alias("_c"))
    rows = rows.where(F.col("_c").isNotNull() & ~bad)
    return rows.select("vec_id", F.transform("_c", lambda e: F.floor(e).cast("long")).alias("x"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, d)


def _pack(d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = max(1, BLOB // (8 * d))
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                x = _matrix(batch.column("x").slice(at, most), d)
                narrow = len(x) and np.abs(x.astype(np.float64)).max() < 2 ** 31 - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([bool(narrow)]), pa.array([x.astype("<i4" if narrow else "<i8").tobytes()], pa.binary())],
                    names=["narrow", "block"])
    return run


def _blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for narrow, block in zip(batch.column("narrow").to_pylist(), batch.column("block")):
            yield np.frombuffer(block.as_buffer(), "<i4" if narrow else "<i8").reshape(-1, d)


def _exact_sums(d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows and sums of a partition, as high and low halves: neither can overflow."""
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for x in _blocks(batches, d):
            x = x.astype(np.int64)
            n += len(x)
            high += (x >> 32).sum(axis=0)
            low += (x & 0xFFFFFFFF).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d + 1, dtype=np.int32)), pa.array(np.r_[n, high]),
                                          pa.array(np.r_[0, low])], names=["dim", "high", "low"])
    return run


@dataclass
class FitList:
    """The distinct vectors in packed blocks, their number and exact sums."""
    blocks: DataFrame
    d: int
    n: int
    sums: list[int]
    parts: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def total(self, of, shape: tuple[int, ...]) -> np.ndarray:
        """Sum over the fit list of ``of(centred block)``, arrays of ``shape``."""
        d, mean, size = self.d, self.mean, int(np.prod(shape))

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(shape)
            for x in _blocks(batches, d):
                out += of(x - mean)
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["sums"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(size)
            for batch in batches:
                for b in batch.column("sums"):
                    out += np.frombuffer(b.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["sums"])

        sums = self.blocks.mapInArrow(partial, "sums binary")
        if self.parts > DIRECT:     # at most the root of the partitions reach the driver
            sums = sums.repartition(int(np.ceil(np.sqrt(self.parts)))).mapInArrow(add, "sums binary")
        return sum((np.frombuffer(r.sums) for r in sums.collect()), np.zeros(size)).reshape(shape)

    def covariance_times(self, q: np.ndarray) -> np.ndarray:
        return self.total(lambda z: z.T @ (z @ q), q.shape) / self.n


def fit_list(vectors: DataFrame) -> FitList | None:
    """Distinct vectors of the most frequent length; None when there are none."""
    lengths = vectors.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    top = lengths.where("d > 0").orderBy(F.desc("n"), F.desc("d")).first()
    if top is None:
        return None
    d, spark = top.d, vectors.sparkSession
    want = max(spark.sparkContext.defaultParallelism, -(-top.n * d * 8 // PARTITION))
    packed = vectors.where(F.size("x") == d).select("x").distinct().mapInArrow(_pack(d), "narrow boolean, block binary")
    blocks = reliable_checkpoint(packed.coalesce(min(want, max(shuffle_partitions(spark), 1))))
    sums = blocks.mapInArrow(_exact_sums(d), "dim int, high long, low long").groupBy("dim").agg(
        F.sum(F.col("high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low"))
    rows = {r.dim: (int(r.high), int(r.low)) for r in sums.collect()}
    return FitList(blocks, d, rows[0][0], [(rows[k + 1][0] << 32) + rows[k + 1][1] for k in range(d)],
                   blocks.rdd.getNumPartitions())


def _filtered(times, q: np.ndarray, vq: np.ndarray, edge: float, top: float, degree: int) -> np.ndarray:
    """Chebyshev polynomial of the covariance on [0, edge], applied to q (whose
    product vq is known) and scaled so that it stays near one at ``top``."""
    half = edge / 2
    scale = first = half / (top - half)
    old, new = q, (vq - half * q) * (first / half)
    for _ in range(degree - 1):
        nxt = 1 / (2 / first - scale)
        old, new = new, (times(new) - half * new) * (2 * nxt / half) - scale * nxt * old
        scale = nxt
    return new


def _degree(theta: np.ndarray, edge: float, k: int, missing: float) -> int:
    """Passes until the k-th wanted pair gains the missing digits; fewer where
    the first would grow too far above the block's last."""
    grow = lambda value: np.arccosh(max(2 * value / edge - 1, 1 + 1e-9))
    return int(np.clip(min(np.log(2 * GROWTH) / grow(theta[0]), np.log(2 * missing) / grow(theta[k - 1])), 2, DEGREE))


def leading_pairs(fit: FitList, k: int = COMPONENTS, guard: int = GUARD, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Leading eigenvalues (falling) and unit eigenvectors (columns) of the fit
    list's covariance, at most k, none for directions without variance."""
    d = fit.d
    k, p = min(k, d), min(k + guard, d)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, p)))[0]
    last = np.inf
    for _ in range(CYCLES):
        vq = fit.covariance_times(q)
        h = q.T @ vq
        theta, w = np.linalg.eigh((h + h.T) / 2)
        theta, w = theta[::-1], w[:, ::-1]
        q, vq = q @ w, vq @ w
        top = max(theta[0], 0.0)
        if top <= 0:
            return np.zeros(0), np.zeros((d, 0))
        real = max(1, int((theta[:k] > NOTHING * top).sum()))
        residual = np.linalg.norm(vq - q * theta, axis=0)[:real]
        worst = residual.max() / top
        error = (residual / np.maximum(theta[:real] - theta[-1], 1e-8 * top)).max()
        if p == d or error <= CERTIFIED or (worst <= STALLED and worst > last / 2):
            break
        last = worst
        edge = max(theta[-1], 1e-6 * theta[real - 1])
        missing = max(error / CERTIFIED, 2.0)
        q = np.linalg.qr(_filtered(fit.covariance_times, q, vq, edge, top, _degree(theta, edge, real, missing)))[0]
    else:
        raise RuntimeError(f"no convergence: residual {worst:.3g} of the largest eigenvalue")
    q, theta = q[:, :k], theta[:k]
    q = q * np.where(q[np.abs(q).argmax(axis=0), np.arange(q.shape[1])] < 0, -1.0, 1.0)
    return theta, q


_OUT = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()),
                  ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])
_OUT_DDL = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
            "identity_error double")


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum of (n x - S)^2 of each row, exact; None where a long cannot hold it."""
    reach = n * float(np.abs(x.astype(np.float64)).max(initial=0)) + float(max(map(abs, sums)))
    if reach * reach * x.shape[1] < 2.0 ** 62:
        return ((n * x.astype(np.int64) - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    wide = ((n * x.astype(object) - np.array(sums, object)) ** 2).sum(axis=1)
    return [v if v < 2 ** 63 else None for v in wide.tolist()]


def whiten(embeddings: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component: (vec_id, component, n,
    deviation, whitened, explained, identity_error).

    Needs ``vec_id`` and ``embedding``; other columns are not read. Rows whose
    vector is null, or holds a null or non-finite entry (or one beyond 2^55,
    which has no long form after scaling), are dropped. Vectors of another
    length than the most frequent one (the longer on ties), and empty ones,
    have no common covariance and are dropped, too. x = floor(256 c); the fit
    list is each distinct x once, n of them with sums S; repeated rows are all
    returned. Components: unit eigenvectors of the fit list's covariance
    (divisor n), numbered by falling eigenvalue, the largest entry positive;
    directions without variance have no component, so a table with a single
    distinct vector, like an empty one, gives no row. ``deviation`` is the
    exact sum of (n x - S)^2, null where it exceeds a long. ``whitened`` is the
    projection of x - S/n over the root of the eigenvalue, ``explained`` the
    eigenvalue's share of the trace, ``identity_error`` the largest entry of
    the whitened fit list's covariance minus the identity.
    """
    vectors = integer_vectors(embeddings)
    fit = fit_list(vectors)
    if fit is not None:
        values, axes = leading_pairs(fit, k)
        trace = float(fit.total(lambda z: (z * z).sum(axis=0), (fit.d,)).sum()) / fit.n
        keep = values > NOTHING * trace
        values, axes = values[keep], axes[:, keep]
    if fit is None or not len(values):
        return embeddings.sparkSession.createDataFrame([], _OUT_DDL)
    basis = axes / np.sqrt(values)
    m = len(values)

    def moments(z: np.ndarray) -> np.ndarray:
        y = z @ basis
        return np.vstack([y.T @ y, y.sum(axis=0)])

    found = fit.total(moments, (m + 1, m)) / fit.n
    error = float(np.abs(found[:m] - np.outer(found[m], found[m]) - np.eye(m)).max())
    d, n, sums, mean, explained = fit.d, fit.n, fit.sums, fit.mean, values / trace

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = max(1, BLOB // (8 * d))
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                x = _matrix(part.column("x"), d)
                again = lambda values, kind: pa.array(values, kind).take(
                    pa.array(np.repeat(np.arange(len(x)), m)))
                yield pa.RecordBatch.from_arrays(
                    [again(part.column("vec_id").to_pylist(), pa.int64()),
                     pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(x))),
                     pa.array(np.full(len(x) * m, n, np.int64)), again(deviations(x, n, sums), pa.int64()),
                     pa.array(((x - mean) @ basis).ravel()), pa.array(np.tile(explained, len(x))),
                     pa.array(np.full(len(x) * m, error))], schema=_OUT)
    return vectors.where(F.size("x") == d).mapInArrow(project, _OUT_DDL)
