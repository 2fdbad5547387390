"""Splits, blends and conformal intervals around a model's residuals."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ranks


def time_split(df: DataFrame, day: str, key: str, test: float = 0.1, validation: float = 0.1) -> DataFrame:
    """Adds split: the last rows by (day, key) are test, the last of the rest validation.

    The rank is found without sorting all rows in one task: rows before each day are counted
    first, and only rows of one day are ranked against each other.
    """
    days = df.groupBy(day).agg(F.count(F.lit(1)).alias("_n"))
    before = days.select(day, (F.sum("_n").over(Window.orderBy(day)) - F.col("_n")).alias("_before"))
    total = days.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    n_test = max(1, int(total * test))
    n_val = max(1, int((total - n_test) * validation))
    place = F.col("_before") + F.row_number().over(Window.partitionBy(day).orderBy(key))
    split = F.when(F.col("_place") > total - n_test, "test").when(F.col("_place") > total - n_test - n_val, "validation").otherwise("fit")
    return df.join(before, day).withColumn("_place", place).withColumn("split", split).drop("_before", "_place")


def stack_weight(df: DataFrame, a: str, b: str, y: str, keys: list[str]) -> DataFrame:
    """Convex least-squares weight of a against b per group; one half where they are equal."""
    d = F.col(a) - F.col(b)
    w = F.try_divide(F.sum(d * (F.col(y) - F.col(b))), F.nullif(F.sum(d * d), F.lit(0.0)))
    return df.groupBy(*keys).agg(F.coalesce(F.least(F.greatest(w, F.lit(0.0)), F.lit(1.0)), F.lit(0.5)).alias("weight"))


def _placed(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``_k``, the row's place in its group from 1, and ``_n``, the group's rows; large groups run in many tasks."""
    df, size = ranks.sized(df, keys)
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return ranks.same_keys(ranks.running(df, keys, order, "_k", size=size), n, keys)


def split_quantiles(df: DataFrame, residual: str, keys: list[str], alpha: float = 0.1) -> DataFrame:
    """Lower and upper conformal offsets of each group: order statistics, infinite where there are too few rows.

    Without keys the whole table is one group; its order statistics come from counts per bucket.
    """
    if not keys:
        return _split_quantiles_of_all(df, residual, alpha)
    ranked = _placed(df.select(*keys, residual), keys, [residual])
    up = F.ceil((F.col("_n") + 1) * (1 - alpha / 2))
    low = F.col("_n") + 1 - up
    pick = lambda k: F.max(F.when(F.col("_k") == k, F.col(residual)))
    out = ranked.groupBy(*keys).agg(F.max("_n").alias("n"), pick(low).alias("lo"), pick(up).alias("hi"))
    inf = float("inf")
    return out.withColumns({"lo": F.coalesce("lo", F.lit(-inf)), "hi": F.coalesce("hi", F.lit(inf))})


def _split_quantiles_of_all(df: DataFrame, residual: str, alpha: float) -> DataFrame:
    spark, n = df.sparkSession, df.count()
    up = math.ceil((n + 1) * (1 - alpha / 2))
    inf = float("inf")
    values = df.where(F.col(residual).isNotNull())
    nulls = n - values.count()  # nulls come first in the order
    at = lambda k: ranks.kth(values, residual, k - nulls) if 1 <= k <= n else None
    lo, hi = at(n + 1 - up), at(up)
    rows = [(n, -inf if lo is None else lo, inf if hi is None else hi)] if n else []
    return spark.createDataFrame(rows, "n bigint, lo double, hi double")


def district_offsets(df: DataFrame, residual: str, district: str, min_rows: int = 200, alpha: float = 0.1) -> DataFrame:
    """Each district's own offsets if it has enough rows, else those of all rows."""
    own = split_quantiles(df, residual, [district], alpha)
    every = split_quantiles(df, residual, [], alpha).first()
    lo, hi = (every["lo"], every["hi"]) if every else (None, None)
    enough = F.col("n") >= min_rows
    return own.withColumns({"lo": F.when(enough, F.col("lo")).otherwise(F.lit(lo)), "hi": F.when(enough, F.col("hi")).otherwise(F.lit(hi)), "own": enough})


def cqr_correction(df: DataFrame, y: str, low: str, high: str, keys: list[str], alpha: float = 0.1) -> DataFrame:
    """Conformal correction of quantile heads: an order statistic of max(low - y, y - high)."""
    score = F.greatest(F.col(low) - F.col(y), F.col(y) - F.col(high))
    ranked = _placed(df.select(*keys, score.alias("_e")), keys, ["_e"])
    at = F.least(F.ceil((F.col("_n") + 1) * (1 - alpha)), F.col("_n"))
    return ranked.groupBy(*keys).agg(F.max("_n").alias("n"), F.max(F.when(F.col("_k") == at, F.col("_e"))).alias("correction"))


def risk_coverage(df: DataFrame, score: str, error: str, keys: list[str], shares: tuple[float, ...] = (0.25, 0.5, 0.75, 0.9, 1.0)) -> DataFrame:
    """Root mean square error of the least risky share of each group."""
    ranked = _placed(df.select(*dict.fromkeys([*keys, score, error])), keys, [score, error])
    ranked = ranked.withColumn("share", F.explode(F.array(*map(F.lit, shares)))).where(F.col("_k") <= F.ceil(F.col("_n") * F.col("share")))
    return ranked.groupBy(*keys, "share").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.col(error) * F.col(error))).alias("rmse"))


def modal_parent(df: DataFrame, fine: str, coarse: str) -> DataFrame:
    """The commonest coarse area of each fine one; ties go to the smaller name."""
    n = df.groupBy(fine, coarse).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(fine).orderBy(F.desc("_n"), coarse)
    return n.withColumn("_k", F.row_number().over(w)).where("_k = 1").select(fine, coarse)


def partial_pooling(df: DataFrame, residual: str, levels: list[str], strength: float = 20.0) -> DataFrame:
    """Closed-form shrinkage from the whole to each finer level: n / (n + strength) of what is left."""
    out = df.withColumn("_left", F.col(residual)).withColumn("effect", F.lit(0.0))
    for level in levels:
        means = out.groupBy(level).agg((F.sum("_left") / (F.count(F.lit(1)) + strength)).alias("_m"))
        out = out.join(means, level).withColumns({"effect": F.col("effect") + F.col("_m"), "_left": F.col("_left") - F.col("_m")}).drop("_m")
    return out.groupBy(*levels).agg(F.count(F.lit(1)).alias("n"), F.max("effect").alias("effect"))
