"""Order statistics of whole tables and of groups of any size, without sorting a large group in one task."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType

from ..sources.lake import kept

BUCKETS = 4096
FEW = 100_000
#: Groups of more rows than this are dealt to all tasks; smaller ones run each in one.
IN_ONE_TASK = 1_000_000
#: The most steps of a value that a group is dealt by.
MOST_PARTS = 1024
#: Steps of a value by which a group's quantiles are found.
STEPS = 64


def kth(df: DataFrame, c: str, k: int) -> float | None:
    """The k-th smallest value of a numeric column (from 1), nulls left out; None if there are fewer.

    Each round counts the rows in ``BUCKETS`` equal steps and goes on in the one that holds the
    k-th, until it has few rows or one value.  At most ``BUCKETS`` counts reach the driver.
    """
    rows = df.select(F.col(c).cast("double").alias("v")).where("v is not null")
    ends = rows.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n")).first()
    if not 1 <= k <= ends["n"]:
        return None
    lo, hi, n = ends["lo"], ends["hi"], ends["n"]
    while True:
        if lo == hi:
            return lo
        inside = rows.where(F.col("v").between(lo, hi))
        if n <= FEW:
            return inside.orderBy("v").offset(k - 1).limit(1).first()["v"]
        step = F.least(F.floor((F.col("v") - lo) / ((hi - lo) / BUCKETS)), F.lit(BUCKETS - 1))
        counts = inside.groupBy(step.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("b").collect()
        for r in counts:
            if k <= r["n"]:
                lo, hi, n = r["lo"], r["hi"], r["n"]
                break
            k -= r["n"]


def median(df: DataFrame, c: str) -> float | None:
    """The median of a numeric column, the mean of the middle two of an even number."""
    return quantile(df, c, 0.5)


def quantile(df: DataFrame, c: str, share: float) -> float | None:
    """The ``share`` quantile of a numeric column, interpolated between the two values around it."""
    n = df.where(F.col(c).isNotNull()).count()
    if not n:
        return None
    at = share * (n - 1)
    low = int(at)
    a = kth(df, c, low + 1)
    return a if at == low else a + (kth(df, c, low + 2) - a) * (at - low)


def largest_group(df: DataFrame, keys: list[str]) -> int:
    """How many rows the largest group has; one number reaches the driver."""
    if not keys:
        return df.count()
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0


def same_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Left's rows with right's columns where all keys are alike; a null key is like another null."""
    side = right.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    if not keys:
        row = right.first()
        return left.withColumns({c: F.lit(row[c]).cast(right.schema[c].dataType) for c in right.columns}) if row else left.limit(0)
    alike = functools.reduce(Column.__and__, [left[k].eqNullSafe(side[f"_key_{k}"]) for k in keys])
    return left.join(side, alike, how).drop(*[f"_key_{k}" for k in keys])


def sized(df: DataFrame, keys: list[str], in_one_task: int | None = None) -> tuple[DataFrame, int]:
    """``df`` and its largest group's rows; written once where that is too large for one task, as it is then read several times."""
    size = largest_group(df, keys)
    return (df if size <= _limit(in_one_task) else kept(df, "sized")), size


def _limit(in_one_task: int | None) -> int:
    return IN_ONE_TASK if in_one_task is None else in_one_task


def dealt_by_value(df: DataFrame, keys: list[str], c: Column, steps: int) -> DataFrame:
    """``df`` with ``_part``: its place among steps of ``c`` of about as many rows each, of its group; equal values share one.

    ``steps`` is rounded up to a power of two: the place is found by halving.
    """
    halvings = max(1, math.ceil(math.log2(steps)))
    ends = [k / 2**halvings for k in range(1, 2**halvings)]
    bounds = kept(df.groupBy(*keys).agg(F.percentile_approx(c, ends, 10 * MOST_PARTS).alias("_bounds")), "bounds")
    out = same_keys(df.withColumn("_by", c), bounds, keys).withColumn("_part", F.lit(0))
    for half in (2**h for h in reversed(range(halvings))):
        out = out.withColumn("_part", F.col("_part") + F.when(F.get("_bounds", F.col("_part") + F.lit(half - 1)) < F.col("_by"), half).otherwise(0))
    return out.drop("_bounds", "_by")


def running(df: DataFrame, keys: list[str], order: list, name: str, weight: Column | None = None, in_one_task: int | None = None, size: int | None = None) -> DataFrame:
    """``df`` with ``name``: the sum of ``weight`` (1 by default) over the group's rows up to and with this one.

    Groups are ordered by ``order`` (names or columns).  Where the largest is too large for one task, its
    rows are dealt by steps of the first of these, without a write; a row's sum is that in its part, plus
    the sums of the parts before, of which there is one number for each part and group.  Where too many
    share one value, rows are sorted by range of all of ``order``.  ``size``: the largest group's rows, if known, of a ``df``
    that is cheap to read several times.
    """
    w = F.lit(1).cast("long") if weight is None else weight
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    limit = _limit(in_one_task)
    if size is None:
        df, size = sized(df, keys, in_one_task)
    if size <= limit:
        upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(name, F.sum(w).over(upto))
    dealt = most = None
    if isinstance(df.select(order[0].alias("_by")).schema["_by"].dataType, (NumericType, DateType)):
        dealt = dealt_by_value(df.withColumn("_w", w), keys, order[0], min(MOST_PARTS, max(8, -(-2 * size // limit))))
        sums = kept(dealt.groupBy(*keys, "_part").agg(F.sum("_w").alias("_sum"), F.count(F.lit(1)).alias("_rows")), "part-sums")
        most = sums.agg(F.max("_rows")).first()[0]
    if most is None or most > limit:
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ranged = df.withColumn("_w", w).repartitionByRange(parts, *[F.col(k) for k in keys], *order)
        dealt = kept(ranged.withColumn("_part", F.spark_partition_id()), "ranges")
        sums = kept(dealt.groupBy(*keys, "_part").agg(F.sum("_w").alias("_sum")), "range-sums")
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    sums = sums.select(*keys, "_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    both = same_keys(dealt, sums, [*keys, "_part"])
    inside = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(name, F.sum("_w").over(inside) + F.col("_before")).drop("_w", "_part", "_before")


def group_quantiles(df: DataFrame, keys: list[str], c: str, shares: dict[str, float], in_one_task: int | None = None, size: int | None = None) -> DataFrame:
    """keys, ``_n`` rows with a value, and for each name of ``shares`` that quantile of ``c``, interpolated.

    Small groups go by Spark's own percentile, which holds their distinct values in memory; where
    the largest is too large for that, rows are counted by steps of the value, and only the values of
    steps around a quantile are put in order.  ``size`` as for ``running``.
    """
    rows = df.where(F.col(c).isNotNull())
    limit = _limit(in_one_task)
    if size is None:
        rows, size = sized(rows.select(*keys, c), keys, in_one_task)
    if size <= limit:
        return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.percentile(c, F.lit(s)).alias(name) for name, s in shares.items()])
    return dealt_quantiles(dealt_by_value(rows.select(*keys, F.col(c).cast("double").alias("_v")), keys, F.col("_v"), STEPS), keys, shares)


def dealt_quantiles(dealt: DataFrame, keys: list[str], shares: dict[str, float]) -> DataFrame:
    """``group_quantiles`` of ``_v`` in rows that have a ``_part``, the place of their value among steps; smaller values are in smaller parts."""
    counts = kept(dealt.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_rows")), "part-counts")
    group = Window.partitionBy(*keys)  # a row for each part
    counts = counts.withColumns({"_n": F.sum("_rows").over(group), "_upto": F.sum("_rows").over(group.orderBy("_part"))})
    place = {name: F.lit(s) * (F.col("_n") - 1) for name, s in shares.items()}
    holds = lambda at, upto, n: (at < F.col(upto)) & (at >= F.col(upto) - F.col(n))
    asked = functools.reduce(Column.__or__, [holds(at, "_upto", "_rows") for p in place.values() for at in (F.floor(p), F.ceil(p))])
    around = kept(counts.where(asked).select(*keys, "_part", "_n", (F.col("_upto") - F.col("_rows")).alias("_before")), "asked-parts")
    # Equal values are one row, so many of these cost no more than one.
    values = same_keys(dealt, around.drop("_n", "_before"), [*keys, "_part"], "left_semi").groupBy(*keys, "_part", "_v").agg(F.count(F.lit(1)).alias("_same"))
    inside = Window.partitionBy(*keys, "_part").orderBy("_v")
    values = same_keys(values, around, [*keys, "_part"]).withColumn("_at", F.sum("_same").over(inside) + F.col("_before"))

    def at(p):
        low, high = (F.max(F.when(holds(x, "_at", "_same"), F.col("_v"))) for x in (F.floor(p), F.ceil(p)))
        return low + (high - low) * F.max(p - F.floor(p))

    return kept(values.groupBy(*keys).agg(F.max("_n").alias("_n"), *[at(p).alias(name) for name, p in place.items()]), "quantiles")
