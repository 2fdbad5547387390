"""Least squares over folds, arms and nested sets of features, all of a study from one pass over its rows.

The pass sums the cross products of the features and the label for each part of the rows (a period, a
group, an arm).  What a fold is fitted to is a sum of parts, so its coefficients need no further
pass and no row is copied once a fold; the tested rows get theirs by a join on the fold.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .channel import coefficients, cross_products


def products(df: DataFrame, part: Column, features: list[str], y: str) -> dict[str, np.ndarray]:
    """Part -> cross products of (1, features, y) of its rows, those with a null in any left out.

    As many parts as periods, groups or arms of a study reach the driver, each of features squared numbers.
    """
    x = [F.lit(1.0), *[F.col(c).cast("double") for c in features], F.col(y).cast("double")]
    rows = df.select(part.cast("string").alias("segment"), F.lit(0).cast("long").alias("digest"), F.array(*x).alias("x"))
    whole = rows.where(F.col("segment").isNotNull() & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v)))
    return {segment: m for (segment, _), m in cross_products(whole, len(x), 0).items()}


def fitted(products_: np.ndarray, used: list[int] | None = None) -> list[float] | None:
    """Intercept and slopes, those of features that are not ``used`` (all by default) zero; None without rows."""
    n = products_.shape[0] - 1
    if products_[0, 0] < 1:
        return None
    columns = [0, *[1 + i for i in (range(n - 1) if used is None else used)]]
    beta = np.zeros(n)
    beta[columns] = coefficients(products_, columns)
    return [float(b) for b in beta]


def predicted(test: DataFrame, fits: dict[str, list[float] | None], features: list[str], fold: str) -> DataFrame:
    """The rows of ``test`` whose ``fold`` (a string) has a fit, with ``predicted``; null where a feature is."""
    rows = [(k, b) for k, b in fits.items() if b is not None]
    betas = test.sparkSession.createDataFrame(rows, f"{fold} string, _beta array<double>")
    x = [F.lit(1.0), *[F.col(c).cast("double") for c in features]]
    dot = sum((F.get("_beta", F.lit(i)) * v for i, v in enumerate(x)), F.lit(0.0))
    # One row a fold: rows stay where they are instead of meeting by fold in one task each.
    return test.join(F.broadcast(betas), fold).withColumn("predicted", dot).drop("_beta")


def rolling_folds(df: DataFrame, period: str, first: int, folds: int, features: list[str], y: str = "log_price") -> DataFrame:
    """Test rows of each fold, predicted from all rows of earlier periods: fold f tests period ``first + f``."""
    parts = products(df.where(F.col(period) < first + folds - 1), F.col(period), features, y)
    size = len(features) + 2
    fits = {str(f): fitted(sum((m for p, m in parts.items() if int(p) < first + f), np.zeros((size, size)))) for f in range(folds)}
    test = df.where(F.col(period).between(first, first + folds - 1)).withColumn("fold", (F.col(period) - first).cast("int").cast("string"))
    return predicted(test, fits, features, "fold").withColumn("fold", F.col("fold").cast("int"))


def left_out_folds(df: DataFrame, group: str, least: int, features: list[str], y: str = "log_price") -> DataFrame:
    """Test rows of each group with at least ``least`` rows, predicted from all other groups; ``fold`` is the group."""
    parts = products(df, F.col(group), features, y)
    size = len(features) + 2
    total = sum(parts.values(), np.zeros((size, size)))
    enough = {r["g"] for r in df.groupBy(F.col(group).cast("string").alias("g")).agg(F.count(F.lit(1)).alias("n")).where(f"n >= {int(least)} AND g IS NOT NULL").collect()}
    fits = {g: fitted(total - parts.get(g, 0.0)) for g in enough}
    return predicted(df.withColumn("fold", F.col(group).cast("string")), fits, features, "fold")


def arms_by_training(df: DataFrame, arms: dict[str, str], test: str, features: list[str], y: str = "log_price") -> DataFrame:
    """The test rows under a fit to each arm's own rows (column ``arm``); ``arms``: name -> which rows it learns from."""
    names = F.explode(F.array_compact(F.array(*[F.when(F.expr(rows), F.lit(a)) for a, rows in arms.items()])))
    parts = products(df.withColumn("_arm", names), F.col("_arm"), features, y)
    tested = df.where(test).withColumn("arm", F.explode(F.array(*map(F.lit, arms))))
    return predicted(tested, {a: fitted(parts[a]) if a in parts else None for a in arms}, features, "arm")


def arms_by_features(df: DataFrame, arms: dict[str, list[str]], train: str, test: str, y: str = "log_price") -> DataFrame:
    """The test rows under a fit with each arm's own features (column ``arm``), all to the same rows."""
    features = list(dict.fromkeys(c for columns in arms.values() for c in columns))
    part = products(df.where(train), F.lit("all"), features, y).get("all")
    fits = {a: fitted(part, [features.index(c) for c in columns]) if part is not None else None for a, columns in arms.items()}
    tested = df.where(test).withColumn("arm", F.explode(F.array(*map(F.lit, arms))))
    return predicted(tested, fits, features, "arm")
