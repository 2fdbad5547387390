"""Whitening against numpy's own eigenvectors."""

import math

import numpy as np
import pytest

from tallyroll.llm import whitening

ROWS = "vec_id long, embedding array<float>, x string, component string"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, "x", "c") for i, v in enumerate(vectors)], ROWS)


def check(got, vectors, components=16):
    usable = [(i, np.floor(64 * np.asarray(v, dtype=np.float32).astype(float)).astype(int) + 1_000_000) for i, v in enumerate(vectors) if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.unique(np.array([v for _, v in usable]), axis=0)
    n, sums = len(x), x.sum(axis=0)
    values, axes = np.linalg.eigh(np.cov((x - sums / n).T, bias=True).reshape(x.shape[1], -1))
    values, axes = values[::-1], axes[:, ::-1]
    k = min(components, int((values > 1e-12 * values.sum()).sum()))
    rows = {}
    for r in got.collect():
        rows.setdefault(r["vec_id"], []).append(r)
    assert sorted(rows) == [i for i, _ in usable]
    w = np.array([[r["whitened"] for r in sorted(rows[i], key=lambda r: r["component"])] for i, _ in usable])
    want = (np.array([v for _, v in usable]) - sums / n) @ axes[:, :k] / np.sqrt(values[:k])
    assert w.shape == want.shape
    signs = np.sign((w * want).sum(axis=0))
    assert np.abs(w - want * signs).max() < 1e-5
    for i, v in usable:
        for r in rows[i]:
            assert r["n"] == n and r["deviation"] == int(((n * v - sums) ** 2).sum())
            assert r["explained"] == pytest.approx(values[r["component"] - 1] / values.sum(), rel=1e-9) and r["identity_error"] < 1e-9


def test_odd_vectors(spark):
    rng = np.random.default_rng(3)
    vectors = [list(map(float, v)) for v in rng.standard_normal((60, 5)) * [9, 4, 2, 1, 0.5]]
    vectors += [None, [None] * 5, [1.0, math.nan, 1.0, 1.0, 1.0], [math.inf, 0.0, 0.0, 0.0, 0.0], vectors[0], vectors[0], [0.0] * 5]
    check(whitening.whiten(frame(spark, vectors)), vectors)
    check(whitening.whiten(frame(spark, vectors), components=2), vectors, 2)


def test_flat_spectrum_and_one_strong_direction(spark):
    rng = np.random.default_rng(4)
    scale = np.r_[40.0, np.linspace(1.1, 1.0, 79)]
    vectors = [list(map(float, v)) for v in rng.standard_normal((400, 80)) * scale]
    check(whitening.whiten(frame(spark, vectors), components=4), vectors, 4)


def test_nothing_varies(spark):
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, [[1.0, 2.0]] * 5)).count() == 0
    flat = [[float(i), 1.0] for i in range(9)]  # the second dimension has no variance
    check(whitening.whiten(frame(spark, flat)), flat)


def test_equal_eigenvalues_end(spark):
    """Without a gap behind the wanted components the block grows until it is exact."""
    got = whitening.leading(lambda q: q * 3.0, 12, 4, 2, 1e-12, 36.0, 1)
    assert np.allclose(got[0], 3.0)
    spread = np.r_[5.0, np.ones(30)]
    values, vectors = whitening.leading(lambda q: q * spread[:, None], 31, 2, 2, 1e-12, 35.0, 1)
    assert np.allclose(values, [5, 1]) and np.allclose(vectors.T @ vectors, np.eye(2))
