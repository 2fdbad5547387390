"""Whitening of vectors by the leading components of their covariance.

The covariance is never formed.  It is applied to a block of directions in passes over the written
fit list: each task centres its rows, multiplies them with the block and with the result, and gives one
d x k sum; Spark adds these, and d x k numbers reach the driver.  Between passes

1. Rayleigh-Ritz turns the block into estimates of components and eigenvalues, with their residuals;
   the leading ones that are certified (residual below ``tolerance`` of the largest eigenvalue) are
   locked, and the others are kept orthogonal to them;
2. a Chebyshev recurrence of the covariance, one pass a degree, damps what lies in the unwanted part
   of the spectrum, between a lower bound and the block's own smallest estimate; two further
   directions go along to estimate that lower bound;
3. QR makes the block orthonormal again.

It ends when all wanted components are certified.  A block that gains nothing is doubled; one that
spans all dimensions is exact.  The degree is held so low that the largest unlocked eigenvalue
doesn't drown the others in one sweep.

Vectors that are null, or hold null or non-finite entries, are dropped; so are those whose length is
not the most frequent one (of equally frequent ones the greatest).  Repeated rows are returned each, but
fitted once.  Components without variance (below 1e-12 of the trace) don't exist, so equal vectors,
a single one, or an empty table give an empty result.  A null vec_id stays null.  ``deviation`` is
null where it is beyond a long.  Columns beside vec_id and the vector are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Directions beside the wanted ones; more of them widen the gap that a sweep works with.
GUARD = 16
PROBES = 2
TOLERANCE = 1e-12
MAX_DEGREE = 12
#: A sweep raises no direction by more than this against another one.
MAX_RATIO = 1e8
MAX_SWEEPS = 200


def whole_vectors(df: DataFrame, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """vec_id and x, the entries as whole numbers, of the rows with a usable vector."""
    entry = lambda c: c.cast("double")
    usable = F.forall("_v", lambda c: c.isNotNull() & ~F.isnan(entry(c)) & (F.abs(entry(c)) < float("inf")))
    rows = df.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{vector}`").alias("_v")).where(F.col("_v").isNotNull() & usable)
    x = F.transform("_v", lambda c: F.floor(entry(c) * SCALE).cast("long") + SHIFT)
    rows = written(rows.select("vec_id", x.alias("x")), "whole-vectors")
    length = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("x") == (length["d"] if length else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column as rows of int64."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    return flat.reshape(len(column), -1)


def summed(fit: DataFrame, of: Callable[[np.ndarray], np.ndarray], size: int, kind: str = "double") -> np.ndarray:
    """The sum over all rows of ``of(rows)``, ``size`` numbers: added up in each task, then by Spark."""

    def part(batches):
        total = None
        for b in batches:
            if b.num_rows:
                got = of(_matrix(b.column(0)))
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(np.ravel(total))], names=["i", "v"])

    rows = fit.select("x").mapInArrow(part, f"i long, v {kind}").groupBy("i").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros(size, dtype=np.int64 if kind == "long" else float)
    out[rows["i"].to_numpy()] = rows["v"].to_numpy()
    return out


class Whitening:
    """What is fitted: n, sums (exact), components (d x k), eigenvalues, trace, identity_error."""

    def __init__(self, n: int, sums: np.ndarray, components: np.ndarray, eigenvalues: np.ndarray, trace: float, identity_error: float, passes: int):
        self.n, self.sums, self.components, self.eigenvalues = n, sums, components, eigenvalues
        self.trace, self.identity_error, self.passes = trace, identity_error, passes


def _centred(n: int, sums: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    return lambda x: (n * x - sums) / n


def fit(rows: DataFrame, components: int = COMPONENTS, guard: int = GUARD, tolerance: float = TOLERANCE, seed: int = 7) -> Whitening | None:
    """Fits to each distinct x once; None where nothing varies."""
    distinct = written(rows.groupBy("x").agg(F.count(F.lit(1)).alias("copies")).select("x"), "fit-list")
    first = distinct.select(F.size("x").alias("d")).first()
    d = first["d"] if first else 0
    n = distinct.count()
    if n < 2 or d == 0:
        return None
    sums = summed(distinct, lambda x: x.sum(axis=0), d, "long")
    centred = _centred(n, sums)
    trace = float(summed(distinct, lambda x: np.array([np.square(centred(x)).sum()]), 1)[0]) / n
    if not trace > 0:
        return None
    passes = 0

    def covariance(q: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1

        def of(x):
            c = centred(x)
            return c.T @ (c @ q)

        return summed(distinct, of, q.size).reshape(q.shape) / n

    values, vectors = leading(covariance, d, min(components, d), guard, tolerance, trace, seed)
    there = values > 1e-12 * trace
    values, vectors = values[there], vectors[:, there]
    root = np.sqrt(values)

    def moments(x):
        w = centred(x) @ vectors / root
        return np.concatenate([np.ravel(w.T @ w), w.sum(axis=0)])

    k = len(values)
    got = summed(distinct, moments, k * k + k) / n
    mean = got[k * k :]
    error = float(np.abs(got[: k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())
    discard(distinct)
    return Whitening(n, sums, vectors, values, trace, error, passes)


def leading(covariance: Callable, d: int, wanted: int, guard: int, tolerance: float, trace: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and their vectors, by Chebyshev-filtered subspace iteration."""
    rng = np.random.default_rng(seed)
    locked, locked_values = np.zeros((d, 0)), np.zeros(0)
    width = min(d, wanted + guard)
    block = np.linalg.qr(rng.standard_normal((d, width)))[0]
    probes = np.linalg.qr(rng.standard_normal((d, min(PROBES, d))))[0]
    low, before = 0.0, np.inf
    for _ in range(MAX_SWEEPS):
        # Rayleigh-Ritz, with the probes of the low end in the same pass.
        both = covariance(np.hstack([block, probes]))
        image, probed = both[:, : block.shape[1]], both[:, block.shape[1] :]
        h = block.T @ image
        values, turn = np.linalg.eigh((h + h.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        block, image = block @ turn, image @ turn
        residuals = np.linalg.norm(image - block * values, axis=0)
        largest = max([*locked_values, values[0], 0.0])
        left = wanted - len(locked_values)
        whole = block.shape[1] + len(locked_values) >= d
        limit = tolerance * max(largest, 1e-300)
        worst = residuals[:left].max()
        stalled = worst > 0.5 * before
        if whole or (stalled and worst <= 1e3 * limit):
            limit = np.inf  # the whole space, or the floor of double precision
        sure = 0
        while sure < left and residuals[sure] <= limit:
            sure += 1
        locked = np.hstack([locked, block[:, :sure]])
        locked_values = np.concatenate([locked_values, values[:sure]])
        if len(locked_values) >= wanted:
            order = np.argsort(-locked_values, kind="stable")
            return locked_values[order], np.linalg.qr(locked[:, order])[0] * 1.0
        block, values, left = block[:, sure:], values[sure:], left - sure
        if stalled and not sure:
            more = rng.standard_normal((d, min(block.shape[1], d - block.shape[1] - locked.shape[1])))
            block = _orthonormal(np.hstack([block, more]), locked)
            before = np.inf
            continue
        before = np.inf if sure else worst
        # The low end: Rayleigh quotients of the probes, less their residuals.
        quotients = (probes * probed).sum(axis=0)
        slack = np.linalg.norm(probed - probes * quotients, axis=0)
        low = max(0.0, float((quotients - slack).min()))
        high = max(float(values[-1]), low + 1e-12 * largest)
        if not high > low:
            low = 0.0
        block, probes = _filtered(covariance, block, probes, locked, low, high, float(values[0]), float(values[left - 1]), largest)
    raise ArithmeticError(f"components not certified in {MAX_SWEEPS} sweeps")


def _orthonormal(block: np.ndarray, locked: np.ndarray) -> np.ndarray:
    for _ in range(2):
        block = block - locked @ (locked.T @ block)
        block = np.linalg.qr(block)[0]
    return block


def _filtered(covariance, block, probes, locked, low, high, top, last, largest):
    """One sweep: the Chebyshev polynomial that is small on [low, high], by its three-term recurrence.

    ``top`` and ``last`` are the largest and the last wanted estimate: the first bounds the degree.
    """
    half, middle = (high - low) / 2, (high + low) / 2
    growth = np.arccosh(max(1.0, (top - middle) / half))
    spread = growth - np.arccosh(max(1.0, (last - middle) / half))
    degree = MAX_DEGREE if spread <= 0 else int(min(MAX_DEGREE, max(1.0, np.log(MAX_RATIO) / spread)))
    scale = half / max(top - middle, half)  # keeps the numbers near one
    before, now, step = None, block, scale
    for k in range(degree):
        both = covariance(np.hstack([now, probes]))
        image, probed = both[:, : now.shape[1]], both[:, now.shape[1] :]
        if before is None:
            after = (image - middle * now) * (step / half)
        else:
            next_step = 1 / (2 / scale - step)
            after = 2 * (next_step / half) * (image - middle * now) - step * next_step * before
            step = next_step
        before, now = now, after - locked @ (locked.T @ after)
        before = before - locked @ (locked.T @ before)
        probes = np.linalg.qr(largest * probes - probed)[0]  # the smallest eigenvalues grow
    return _orthonormal(now, locked), probes


def whiten(df: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", components: int = COMPONENTS, tolerance: float = TOLERANCE) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row per vector and component."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = whole_vectors(df, vector, vec_id)
    fitted = fit(rows, components, tolerance=tolerance)
    if fitted is None:
        return df.sparkSession.createDataFrame([], schema)
    n, sums, k = fitted.n, fitted.sums, len(fitted.eigenvalues)
    axes, explained, error = fitted.components / np.sqrt(fitted.eigenvalues), fitted.eigenvalues / fitted.trace, fitted.identity_error

    def told(batches):
        for b in batches:
            m = b.num_rows
            if not m:
                continue
            off = n * _matrix(b.column(1)) - sums
            beyond = np.square(off.astype(float)).sum(axis=1) > 9.2e18
            deviation = pa.array(np.repeat(np.square(off).sum(axis=1), k), mask=np.repeat(beyond, k))
            at = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, dtype=np.int64)),
                    deviation, pa.array(np.ravel(off / n @ axes)), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.select(F.col("vec_id").cast("long"), "x").mapInArrow(told, schema)
