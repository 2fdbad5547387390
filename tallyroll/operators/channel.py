"""How much of the gap between two sales channels is the channel's: least squares in stages, with a bootstrap.

One pass over the rows gives the cross products of the whole design for each segment and for each
bootstrap draw; every stage is the solution of a part of these.  A draw weighs each row by a Poisson
number that follows from the row's own digest, so it needs no copies of rows and comes out the same on
any partitioning.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ranks

STAGES = ("raw", "hedonic", "distress")
#: Dummies are made of at most this many levels of a category; more are refused, as the design would not be bounded.
MAX_LEVELS = 200
#: Cumulative shares of a Poisson(1) number being 0, 1, ... up to 11.
POISSON = np.cumsum(np.exp(-1.0) / np.cumprod(np.r_[1.0, np.arange(1, 12)]))


def poisson_weights(digests: np.ndarray, draws: int) -> np.ndarray:
    """len(digests) x draws numbers of mean one, from the rows' 64-bit digests and the draw's number."""
    with np.errstate(over="ignore"):
        x = digests.astype(np.uint64)[:, None] + np.arange(1, draws + 1, dtype=np.uint64)[None] * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x = x ^ (x >> np.uint64(31))
    return np.searchsorted(POISSON, (x >> np.uint64(11)) / float(1 << 53), side="right").astype(float)


def _levels(df: DataFrame, c: str) -> list:
    found = [r[0] for r in df.select(F.col(c).cast("string")).distinct().limit(MAX_LEVELS + 1).collect()]
    if len(found) > MAX_LEVELS:
        raise ValueError(f"{c} has more than {MAX_LEVELS} levels")
    return sorted(found, key=lambda v: (v is not None, v or ""))


def _dummies(df: DataFrame, c: str) -> list[Column]:
    """A column for each level but the first; null is a level."""
    return [F.col(c).cast("string").eqNullSafe(F.lit(v)).cast("double") for v in _levels(df, c)[1:]]


def cross_products(rows: DataFrame, size: int, draws: int) -> dict[tuple[str, int], np.ndarray]:
    """(segment, draw) -> sum of the outer products of ``x``; draw 0 has weight one, the others are for ``overall`` only.

    ``rows``: segment, digest and x, an array of ``size``.
    """

    def part(batches):
        sums: dict[tuple[str, int], np.ndarray] = {}
        for b in batches:
            names = np.array(b.column(0).to_pylist(), dtype=object)
            x = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            for name in dict.fromkeys(names):
                mine = names == name
                own = x[mine]
                got = {0: own.T @ own}
                if name == "overall" and draws:
                    w = poisson_weights(b.column(1).to_numpy(zero_copy_only=False)[mine].view(np.uint64), draws)
                    got |= {k + 1: (own * w[:, k, None]).T @ own for k in range(draws)}
                for k, v in got.items():
                    sums[name, k] = sums.get((name, k), 0.0) + v
        for (name, k), v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * v.size), pa.array(np.full(v.size, k, dtype=np.int32)), pa.array(np.arange(v.size, dtype=np.int32)), pa.array(np.ravel(v))], names=["segment", "draw", "at", "v"])

    out: dict[tuple[str, int], np.ndarray] = {}
    told = rows.select("segment", "digest", "x").mapInArrow(part, "segment string, draw int, at int, v double").groupBy("segment", "draw", "at").agg(F.sum("v").alias("v")).toPandas()
    for key, g in told.groupby(["segment", "draw"]):
        m = np.zeros(size * size)
        m[g["at"].to_numpy()] = g["v"].to_numpy()
        out[key[0], int(key[1])] = m.reshape(size, size)
    return out


def coefficients(products: np.ndarray, columns: list[int]) -> np.ndarray:
    """Least squares of the last column on ``columns``, the smallest solution where they depend on each other."""
    a, b = products[np.ix_(columns, columns)], products[columns, -1]
    scale = np.sqrt(np.where(np.diag(a) > 0, np.diag(a), 1.0))
    return np.linalg.pinv(a / np.outer(scale, scale), rcond=1e-11, hermitian=True) @ (b / scale) / scale


def decompose(
    sales: DataFrame, logged: list[str], numeric: list[str], categorical: list[str], distress: list[str], draws: int = 200, least_fifths: int = 5
) -> tuple[DataFrame, dict[str, float | None]]:
    """(segment, stage, cash_discount_pct, ci_low, ci_high, n; the discounts of clean and of distressed houses).

    ``sales``: sale_id, sale_price, time_adj_log, district, cash and the named columns.  The log price of today is explained
    by district and cash (raw), then also by ``logged`` (as log1p), ``numeric`` and ``categorical`` (hedonic), then
    by ``distress``.  Overall and by price fifths; the interval is that of the bootstrap and overall only.
    Numbers that are missing are the segment's median, distress that is missing is none.  Sales without a
    district, or of no positive price, take no part.
    """
    rows = sales.where("district IS NOT NULL AND sale_price > 0")
    spark = sales.sparkSession
    schema = "segment string, stage string, cash_discount_pct double, ci_low double, ci_high double, n long"
    cuts = [ranks.quantile(rows, "sale_price", k / least_fifths) for k in range(1, least_fifths)]
    if cuts[0] is None:
        return spark.createDataFrame([], schema), {}
    fifth = sum((F.when(F.col("sale_price") >= c, 1).otherwise(0) for c in cuts), F.lit(1))
    rows = rows.withColumn("segment", F.explode(F.array(F.lit("overall"), F.concat(F.lit("q"), fifth.cast("string")))))
    values = {**{c: F.log1p(F.col(c).cast("double")) for c in logged}, **{c: F.col(c).cast("double") for c in numeric}}
    filled = []
    for c, v in values.items():
        rows = rows.withColumn(f"_{c}", F.when(~F.isnan(v), v))
        middle = ranks.group_quantiles(rows, ["segment"], f"_{c}", {f"_m_{c}": 0.5}).drop("_n")
        rows = ranks.same_keys(rows, middle, ["segment"], "left")
        filled.append(F.coalesce(f"_{c}", f"_m_{c}", F.lit(0.0)))
    bad = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in distress]
    cash = F.coalesce(F.col("cash").cast("double"), F.lit(0.0))
    any_bad = (sum(bad, F.lit(0.0)) > 0).cast("double")
    base = [F.lit(1.0), *_dummies(sales, "district")]
    hedonic = [*filled, *[d for c in categorical for d in _dummies(sales, c)]]
    y = F.ln("sale_price") + F.coalesce("time_adj_log", F.lit(0.0))
    design = [*base, *hedonic, *bad, cash, cash * any_bad, y]
    products = cross_products(rows.select("segment", F.xxhash64("sale_id").alias("digest"), F.array(*design).alias("x")), len(design), draws)
    a, b, c = len(base), len(base) + len(hedonic), len(base) + len(hedonic) + len(bad)
    columns = {"raw": [*range(a), c], "hedonic": [*range(b), c], "distress": [*range(c), c]}
    percent = lambda beta: float(np.exp(beta) - 1)
    told = []
    for name in ["overall", *[f"q{k}" for k in range(1, least_fifths + 1)]]:
        if (name, 0) not in products:
            continue
        for stage in STAGES:
            low = high = None
            if name == "overall" and draws:
                boots = [coefficients(products[name, k], columns[stage])[-1] for k in range(1, draws + 1) if (name, k) in products]
                low, high = (percent(q) for q in np.quantile(boots, [0.025, 0.975]))
            told.append((name, stage, percent(coefficients(products[name, 0], columns[stage])[-1]), low, high, int(round(products[name, 0][0, 0]))))
    clean, more = coefficients(products["overall", 0], [*range(c), c, c + 1])[-2:]
    both = {"clean": percent(clean), "distressed": percent(clean + more), "difference": percent(clean + more) - percent(clean)}
    return spark.createDataFrame(told, schema), both
