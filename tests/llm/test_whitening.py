"""Embedding whitening against a dense eigendecomposition."""

import math

import numpy as np
import pytest

from ledgerlens.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows):
    """(fit list, rows kept) of the contract, by numpy."""
    kept = [(i, [math.floor(256.0 * float(np.float32(c))) for c in v]) for i, v, *_ in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in kept}), float)
    return fit, kept


def table(spark, rows, folder, extra=False):
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        df = df.selectExpr("*", "1 as x", "2 as d", "3 as n", "4 as _c", "5 as component")
    path = str(folder / f"emb-{extra}-{len(rows)}")
    df.repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 24)) * np.linspace(1.6, 0.7, 24) @ np.linalg.qr(rng.standard_normal((24, 24)))[0]
    rows = [(k, v.tolist(), 1) for k, v in enumerate(x)]
    rows += [(900 + k, x[0].tolist(), 1) for k in range(150)] + [(None, x[1].tolist(), None)]
    bad = [None, [None] * 24, [float("nan")] * 24, [float("inf")] + [0.0] * 23, x[2].tolist()[:-1] + [None]]
    return rows + [(2000 + k, v, 0) for k, v in enumerate(bad)]


@pytest.mark.parametrize("extra", [False, True])
def test_against_dense(spark, vectors, tmp_path, extra):
    fit, kept = plain(vectors)
    n, total = len(fit), fit.sum(axis=0)
    values, axes = np.linalg.eigh(np.cov(fit.T, bias=True))
    values, axes = values[::-1], axes[:, ::-1]
    got = whitening.whiten(table(spark, vectors, tmp_path, extra)).collect()
    assert len(got) == 4 * len(kept) and {r.n for r in got} == {n}
    by = {}
    for r in got:
        by.setdefault(r.component, []).append(r)
    want_dev = sorted(int(((n * np.array(x, int) - total.astype(int)) ** 2).sum()) for _, x in kept)
    for c in range(1, 5):
        assert sorted(r.deviation for r in by[c]) == want_dev
        mine = sorted(((r.vec_id is None, r.vec_id or 0), r.whitened) for r in by[c])
        want = sorted(((i is None, i or 0), float((np.array(x) - total / n) @ axes[:, c - 1] / math.sqrt(values[c - 1])))
                      for i, x in kept)
        a, b = np.array([v for _, v in mine]), np.array([v for _, v in want])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-10
        assert abs(by[c][0].explained / (values[c - 1] / values.sum()) - 1) < 1e-10
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_many_partitions_add_up_in_tasks(spark, vectors, tmp_path, monkeypatch):
    monkeypatch.setattr(whitening, "DIRECT", 1)
    monkeypatch.setattr(whitening, "BLOB", 512)
    got = whitening.whiten(table(spark, vectors, tmp_path)).agg({"whitened": "max", "identity_error": "max"}).first()
    assert got["max(identity_error)"] < 1e-9


def test_close_eigenvalues_and_a_dominant_one():
    """The iteration alone, against numpy: a slowly falling spectrum, and one value far above the rest."""
    class Dense(whitening.FitList):
        def covariance_times(self, q):
            return v @ q
    for spectrum in (np.linspace(1.0, 0.9, 80), np.r_[1e3, np.linspace(1.0, 0.9, 79)], np.r_[3.0, 2.0, np.zeros(78)]):
        o = np.linalg.qr(np.random.default_rng(1).standard_normal((80, 80)))[0]
        v = o * spectrum @ o.T
        values, axes = whitening.leading_pairs(Dense(None, 80, 1, [0] * 80, 1))
        m = int((spectrum[:4] > 0).sum())
        assert np.allclose(values[:m], spectrum[:m], rtol=1e-11)
        assert np.abs(np.abs((axes[:, :m] * o[:, :m]).sum(axis=0)) - 1).max() < 1e-10


def test_degenerate_tables(spark, tmp_path):
    one = [(k, [0.5, 1.0, 2.0], 0) for k in range(5)]
    assert whitening.whiten(table(spark, one, tmp_path)).count() == 0
    assert whitening.whiten(table(spark, one, tmp_path, True).where("false")).count() == 0
    none = [(1, None, 0), (2, [], 0), (3, [None], 0)]
    assert whitening.whiten(table(spark, none, tmp_path)).count() == 0
    # two dimensions of which one is constant, and a vector of another length: one component
    few = [(k, [float(k), 3.0], 0) for k in range(6)] + [(9, [1.0], 0)]
    got = whitening.whiten(table(spark, few, tmp_path)).collect()
    assert [r.component for r in got] == [1] * 6 and abs(got[0].explained - 1) < 1e-12


def test_deviation_beyond_a_long():
    x = np.array([[1 << 40, 0], [1, 2]])
    sums = [(1 << 40) + 1, 2]
    assert whitening.deviations(x, 2, sums) == [None, None]
    assert whitening.deviations(np.array([[3, 0], [1, 2]]), 2, [4, 2]) == [8, 8]
    assert whitening.deviations(np.array([[1 << 30, 0], [0, 0]]), 2, [1 << 30, 0]) == [1 << 60, 1 << 60]
