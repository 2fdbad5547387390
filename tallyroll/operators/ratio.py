"""Ratio-study statistics per group: fit, level, uniformity and vertical equity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import digitize, positive, ratio
from . import ranks


def clean_pairs(df: DataFrame, estimate: str, sale: str) -> DataFrame:
    """Rows whose estimate and sale are finite and above zero, as est, sale and r = est / sale."""
    out = df.withColumns({"est": positive(estimate), "sale": positive(sale)}).where("est is not null and sale is not null")
    return out.withColumn("r", F.col("est") / F.col("sale"))


def _with_ratio(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("r", F.col("est") / F.col("sale"))


def fit_metrics(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """n, rmse_log, mape and r2_log of clean pairs."""
    err = F.ln("est") - F.ln("sale")
    return pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sqrt(F.avg(err * err)).alias("rmse_log"),
        F.avg(F.abs(F.col("est") - F.col("sale")) / F.col("sale")).alias("mape"),
        (F.lit(1.0) - F.try_divide(F.sum(err * err), F.nullif(F.var_pop(F.ln("sale")) * F.count(F.lit(1)), F.lit(0.0)))).alias("r2_log"),
    )


def ratio_metrics(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """median_ratio, COD, PRD, PRB and MKI of clean pairs; null below three pairs.

    The median is needed row by row, so it is joined back by group; the ranks of the Kakwani
    index are taken within the group, over all tasks where it is large.  Only keys, estimate and sale
    are ever shuffled.  Keys may have any name but those of the result; a null key is a group.
    """
    pairs, size = ranks.sized(pairs.select(*keys, "est", "sale"), keys)
    level = ranks.group_quantiles(_with_ratio(pairs), keys, "r", {"_m": 0.5}, size=size)
    rows = ranks.running(pairs, keys, ["sale", "est"], "_rank", size=size)
    rows = _with_ratio(ranks.same_keys(rows, level, keys))
    value = F.log2((F.col("sale") + F.col("est") / F.col("_m")) / 2)
    n = F.max("_n")
    gini = lambda c: 2 * F.sum(F.col("_rank") * F.col(c)) / (n * F.sum(c)) - (n + 1) / n
    ok = lambda c: F.when(n >= 3, c)
    return rows.groupBy(*keys).agg(
        n.alias("n"),
        ok(F.max("_m")).alias("median_ratio"),
        ok(100 * F.avg(F.abs(F.col("r") - F.col("_m"))) / F.max("_m")).alias("cod"),
        ok(F.avg("r") / (F.sum("est") / F.sum("sale"))).alias("prd"),
        ok(F.regr_slope((F.col("r") - F.col("_m")) / F.col("_m"), value)).alias("prb"),
        ok(F.try_divide(gini("est"), gini("sale"))).alias("mki"),
    )


def evaluate(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """All of ``fit_metrics`` and ``ratio_metrics`` of clean pairs."""
    return ranks.same_keys(fit_metrics(pairs, keys), ratio_metrics(pairs, keys).drop("n"), keys)


def vertical_equity(pairs: DataFrame, keys: list[str], z: float = 1.64) -> DataFrame:
    """The vertical equity indicator per group with its significance and verdict.

    Percentile groups by a value proxy (half price, half level-adjusted estimate): 2 from 20
    pairs, 4 from 51, 10 from 501.  Medians have a rank-based interval of ``z``.  Keys may have
    any name but those of the result.
    """
    pairs, size = ranks.sized(pairs.select(*keys, "est", "sale"), keys)
    pairs = _with_ratio(pairs)
    level = ranks.group_quantiles(pairs, keys, "r", {"_m": 0.5}, size=size)
    count = F.when(F.col("_n") < 20, 0).when(F.col("_n") <= 50, 2).when(F.col("_n") <= 500, 4).otherwise(10)
    level = level.withColumn("_groups", count)
    rows = ranks.same_keys(pairs, level, keys).where("_groups > 0").select(*keys, "est", "sale", (0.5 * F.col("sale") + 0.5 * (F.col("est") / F.col("_m"))).alias("_proxy"))
    rows = ranks.running(rows, keys, ["_proxy", "est", "sale"], "_place", size=size).drop("_proxy")
    rows = ranks.same_keys(rows, level, keys)
    rows = rows.withColumn("_g", F.floor((F.col("_place") - 1) * F.col("_groups") / F.col("_n")).cast("int"))
    # The places of a group follow from its number, so its size is known without a count; only the first and the last are compared.
    first = lambda g: F.ceil(g * F.col("_n") / F.col("_groups"))
    rows = _with_ratio(rows.where((F.col("_g") == 0) | (F.col("_g") == F.col("_groups") - 1))).select(*keys, "_g", "r")
    half_size = -(-size // 2)
    if half_size > ranks.IN_ONE_TASK:
        rows, half_size = ranks.sized(rows, [*keys, "_g"])
    rows = ranks.running(rows, [*keys, "_g"], ["r"], "_k", size=half_size).withColumn("_k", F.col("_k") - 1)
    rows = ranks.same_keys(rows, level, keys).withColumn("_size", first(F.col("_g") + 1) - first(F.col("_g")))
    offset = F.ceil(z * F.sqrt(F.col("_size").cast("double")) / 2 + F.when(F.col("_size") % 2 == 0, 0.5).otherwise(0.0))
    half = F.floor(F.col("_size") / 2)
    odd = F.col("_size") % 2 == 1
    low = F.greatest(F.lit(0), half - offset)
    high = F.least(F.col("_size") - 1, F.when(odd, half + offset).otherwise(half - 1 + offset))
    middle = (F.col("_k") == half) | (~odd & (F.col("_k") == half - 1))
    groups = rows.groupBy(*keys, "_g").agg(
        F.max("_m").alias("_m"),
        F.max("_groups").alias("_groups"),
        F.avg(F.when(middle, F.col("r"))).alias("_med"),
        F.min(F.when(F.col("_k") == low, F.col("r"))).alias("_lo"),
        F.min(F.when(F.col("_k") == high, F.col("r"))).alias("_hi"),
    )
    at = lambda c, g: F.max(F.when(F.col("_g") == g, F.col(c)))
    ends = groups.groupBy(*keys).agg(
        F.max("_m").alias("_m"), F.max("_groups").alias("n_groups"),
        *[at(c, 0).alias(f"{c}_first") for c in ("_med", "_lo", "_hi")],
        *[at(c, F.col("_groups") - 1).alias(f"{c}_last") for c in ("_med", "_lo", "_hi")],
    )
    up = F.col("_med_last") >= F.col("_med_first")
    gap = 100 * (F.when(up, F.col("_lo_last") - F.col("_hi_first")).otherwise(F.col("_lo_first") - F.col("_hi_last"))) / F.col("_m")
    out = ends.withColumn("vei", 100 * (F.col("_med_last") - F.col("_med_first")) / F.col("_m")).withColumn("_gap", gap)
    out = out.withColumn("significance", F.when((F.abs("vei") > 10) & (F.col("_gap") > 0), F.col("_gap")))
    out = out.withColumn("verdict", F.when(F.col("significance") > 10, "unacceptable").otherwise("acceptable"))
    side = out.select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.lit(1).alias("_one"), "n_groups", "vei", "significance", "verdict")
    same = [F.lit(1) == F.col("_one"), *[F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]]
    return level.drop("_groups").join(side, same, "left").select(
        *keys, F.col("_n").alias("n"), F.coalesce("n_groups", F.lit(0)).alias("n_groups"), "vei", "significance",
        F.coalesce("verdict", F.lit("insufficient_sample")).alias("verdict"),
    )


def iqr_trim(pairs: DataFrame, keys: list[str], width: float = 3.0) -> DataFrame:
    """Pairs with ``is_outlier``: the ratio is more than ``width`` interquartile ranges outside the quartiles."""
    q = ranks.group_quantiles(pairs, keys, "r", {"q1": 0.25, "q3": 0.75}).drop("_n")
    iqr = F.col("q3") - F.col("q1")
    return ranks.same_keys(pairs, q, keys).withColumn("is_outlier", (F.col("r") < F.col("q1") - width * iqr) | (F.col("r") > F.col("q3") + width * iqr))


def segments(pairs: DataFrame, category: str, edges: list[float]) -> DataFrame:
    """Each pair once per segment it is in: overall, its category, its price fifth."""
    names = F.array(F.lit("overall"), F.concat(F.lit("category:"), F.col(category)), F.concat(F.lit("fifth:"), (digitize("sale", edges) + 1).cast("string")))
    return pairs.withColumn("segment", F.explode(F.array_compact(names)))


def ends_by(pairs: DataFrame, by: str, keys: list[str], size: int | None = None) -> DataFrame:
    """Median ratio in the bottom and the top fifth of ``by``; ``size`` as for ``ranks.running``."""
    pairs = pairs.select(*dict.fromkeys([*keys, by, "r"]))
    if size is None:
        pairs, size = ranks.sized(pairs, keys)
    cut = ranks.group_quantiles(pairs, keys, by, {"lo": 0.2, "hi": 0.8}, size=size).drop("_n")
    rows = ranks.same_keys(pairs, cut, keys)
    rows = rows.withColumns({"_low": F.when(F.col(by) <= F.col("lo"), F.col("r")), "_high": F.when(F.col(by) >= F.col("hi"), F.col("r"))})
    low, high = (ranks.group_quantiles(rows, keys, c, {name: 0.5}, size=size).drop("_n") for c, name in (("_low", "q1_median"), ("_high", "q5_median")))
    return ranks.same_keys(low, high, keys)


def tier_redistribution(df: DataFrame, assessed: str, value: str, keys: list[str]) -> DataFrame:
    """Per equal-count fifth by value: its share of assessment less its share of value, and the bottom two fifths' sum."""
    rows = df.withColumns({"_a": positive(assessed), "_v": positive(value)}).where("_a is not null and _v is not null")
    w = Window.partitionBy(*keys)  # over the five tiers
    rows = ranks.running(rows.select(*keys, "_v", "_a"), keys, ["_v", "_a"], "_place")
    rows = ranks.same_keys(rows, rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_all")), keys)
    rows = rows.withColumn("_tier", (F.floor((F.col("_place") - 1) * 5 / F.col("_all")) + 1).cast("int"))
    tiers = rows.groupBy(*keys, "_tier").agg(F.count(F.lit(1)).alias("_n"), F.sum("_a").alias("_a"), F.sum("_v").alias("_v"))
    share = lambda c: F.col(c) / F.sum(c).over(w)
    out = tiers.withColumn("_over", share("_a") - share("_v"))
    bottom = F.sum(F.when(F.col("_tier") <= 2, F.col("_over"))).over(w)
    return out.select(*keys, F.col("_tier").alias("tier"), F.col("_n").alias("n"), F.col("_over").alias("over_share"), bottom.alias("bottom40_over_share"))


def interval_row(df: DataFrame, low: str, high: str, actual: str, keys: list[str]) -> DataFrame:
    """Coverage, median high / low and mean width over actual."""
    lo, hi, y = F.col(low), F.col(high), F.col(actual)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(((y >= lo) & (y <= hi)).cast("double")).alias("coverage"),
        F.median(ratio(hi, lo)).alias("median_spread"),
        F.avg(ratio(hi - lo, y)).alias("mean_width"),
    )


def benchmark_direction(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Of two arms' metrics, which is nearer each one's ideal, and the verdict over all."""
    ideal = {"median_ratio": 1.0, "cod": 0.0, "prd": 1.0, "prb": 0.0, "mki": 1.0}
    two = a.select(*keys, *[F.col(c).alias(f"a_{c}") for c in ideal]).join(b.select(*keys, *[F.col(c).alias(f"b_{c}") for c in ideal]), keys)
    better = {c: (F.abs(F.col(f"a_{c}") - v) < F.abs(F.col(f"b_{c}") - v)) for c, v in ideal.items()}
    wins = sum((F.when(x, 1).otherwise(0) for x in better.values()), F.lit(0))
    return two.select(*keys, *[F.coalesce(x, F.lit(False)).alias(f"{c}_a_nearer") for c, x in better.items()], F.when(wins == 5, "a").when(wins == 0, "b").otherwise("mixed").alias("verdict"))
