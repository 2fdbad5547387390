"""Small studies and joins built from the other operators' columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import known, positive, ratio
from . import ranks


def sale_points(sales: DataFrame, low: float = 10.0, high: float = 2_000.0, areas: tuple[float, float] = (300.0, 10_000.0)) -> DataFrame:
    """Dated, priced sales with a plausible area and price per area: log price per area, month, place."""
    rows = sales.where(F.col("sale_date").isNotNull() & (F.col("sale_price") > 0) & F.col("area").between(*areas))
    rows = rows.withColumn("ppsf", ratio("sale_price", "area")).where(F.col("ppsf").between(low, high))
    return rows.select("sale_id", "parcel_id", F.ln("ppsf").alias("log_ppsf"), F.trunc("sale_date", "month").alias("month"), "x_m", "y_m")


def detrended(points: DataFrame) -> DataFrame:
    """Log price per area less the whole city's median of the month."""
    city = points.groupBy("month").agg(F.median("log_ppsf").alias("_m"))
    return points.join(city, "month").withColumn("level", F.col("log_ppsf") - F.col("_m")).drop("_m")


def levels(df: DataFrame, key: str, value: str, least: int) -> DataFrame:
    """Median of each group with at least ``least`` rows."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.median(value).alias("median")).where(F.col("n") >= least)


def periods(df: DataFrame, day: str, key: str, n: int) -> DataFrame:
    """Adds period: consecutive equal chunks by (day, key), ranked by counts per day first."""
    days = df.groupBy(day).agg(F.count(F.lit(1)).alias("_n"))
    before = days.select(day, (F.sum("_n").over(Window.orderBy(day)) - F.col("_n")).alias("_before"))
    total = df.count()
    place = F.col("_before") + F.row_number().over(Window.partitionBy(day).orderBy(key)) - 1
    return df.join(before, day).withColumn("period", F.floor(place * n / F.lit(max(1, total))).cast("int")).drop("_before")


def flag_agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def interval_eval(df: DataFrame, low: str, high: str, y: str, segment: str, least: int) -> DataFrame:
    """Coverage and median log width of each segment with enough rows."""
    inside = F.col(y).between(F.col(low), F.col(high)).cast("double")
    out = df.groupBy(segment).agg(F.count(F.lit(1)).alias("n"), F.avg(inside).alias("coverage"), F.median(F.col(high) - F.col(low)).alias("median_width"))
    return out.where(F.col("n") >= least)


def encode_levels(fit: DataFrame, df: DataFrame, c: str) -> DataFrame:
    """``c_code``: place of the value among the sorted values of the fit rows, null if unseen.

    The values are few by contract (a recorded category); they are ranked in one window.
    """
    codes = fit.select(c).where(F.col(c).isNotNull()).distinct().withColumn(f"{c}_code", F.row_number().over(Window.orderBy(c)) - 1)
    return df.join(codes, c, "left")


def standardise(fit: DataFrame, df: DataFrame, columns: list[str]) -> DataFrame:
    """``c_z``: median for nulls, then less the mean over the population deviation of the fit rows; and ``c_missing``."""
    med = {c: ranks.median(fit, c) for c in columns}
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(float(med[c] or 0.0))) for c in columns}
    stats = fit.agg(*[f(filled[c]).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    z = {f"{c}_z": (filled[c] - F.lit(stats[f"m_{c}"])) / F.lit(stats[f"s_{c}"] or 1.0) for c in columns}
    return df.withColumns(z | {f"{c}_missing": F.col(c).isNull().cast("int") for c in columns})


def repeat_parcels(sales: DataFrame, least: int = 2) -> DataFrame:
    return sales.groupBy("parcel_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def recency_half_life(age_days: str, years: float = 3.0):
    return F.pow(F.lit(0.5), F.col(age_days) / F.lit(365.25 * years))


def union_families(*frames: DataFrame) -> DataFrame:
    """All frames by column name; columns that a frame lacks are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def audit_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """Keys whose value is not the same in two (key, value) reports."""
    both = old.select("key", F.col("value").alias("old")).join(new.select("key", F.col("value").alias("new")), "key", "full_outer")
    return both.where(~F.col("old").eqNullSafe(F.col("new")))


def sales_chased(pairs: DataFrame, keys: list[str], width: float = 0.02) -> DataFrame:
    """Share of ratios within ``width`` of one, against the share in the two bands beside it."""
    r = F.col("r")
    near = F.avg((F.abs(r - 1) <= width).cast("double"))
    beside = F.avg(((F.abs(r - 1) > width) & (F.abs(r - 1) <= 2 * width)).cast("double"))
    return pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), near.alias("share_near"), beside.alias("share_beside"), (near > 2 * beside).alias("suspicious"))


def residual_bands(df: DataFrame, group: str, prediction: str, edges: list[float], residual: str) -> DataFrame:
    """Median residual gap between the group's two sides per prediction bin, shrunk by n / (n + 500)."""
    from ..functions.columns import digitize

    rows = df.select(digitize(prediction, edges).alias("bin"), F.col(group).alias("_side"), F.col(residual).alias("_e"))
    rows, size = ranks.sized(rows, ["bin", "_side"])
    middle = ranks.group_quantiles(rows, ["bin", "_side"], "_e", {"_middle": 0.5}, size=size)
    of = lambda side: F.max(F.when(side, F.col("_middle")))
    gaps = middle.groupBy("bin").agg((of(F.col("_side")) - of(~F.col("_side"))).alias("gap"))
    out = ranks.same_keys(rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n")), gaps, ["bin"], "left")
    return out.withColumn("gap", F.col("gap") * F.col("n") / (F.col("n") + 500))


def redistribution_by_group(df: DataFrame, assessed: str, fair: str, group: str, rate: float) -> DataFrame:
    """Net over-payment of each group at a fixed rate, against fair values with the same total."""
    k = df.agg((F.sum(positive(assessed)) / F.sum(positive(fair))).alias("k")).first()["k"] or 1.0
    over = (F.col(assessed) - F.col(fair) * F.lit(k)) * rate
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum(over).alias("net"))


def entity_ratios(df: DataFrame) -> DataFrame:
    """Area per account, accounts per building, and buildings recorded without a unit."""
    return df.withColumns({
        "area_per_account": ratio("area", F.greatest("accounts", F.lit(1))),
        "accounts_per_building": ratio("accounts", F.greatest("buildings", F.lit(1))),
        "unit_conflict": known((F.col("units") <= 0) & (F.col("accounts") > 1)).cast("int"),
    })


def record_quality(df: DataFrame) -> DataFrame:
    """No verdict (low) and warning flags of a record, from its conflicts and gaps."""
    low = known(F.col("area_conflict") > 0) | (F.coalesce("livable", F.lit(0.0)) <= 0)
    warn = low | F.col("year").isNull() | known(F.col("open_changes") > 0) | known(F.abs("story_gap") > 2)
    return df.withColumns({"record_quality_low": low, "record_quality_warning": warn})


def decode(df: DataFrame, c: str, codes: DataFrame) -> DataFrame:
    """``c_label``: the published label of a code; unknown codes stay null."""
    return df.join(codes.select(F.col("code").alias(c), F.col("label").alias(f"{c}_label")), c, "left")


def join_current(df: DataFrame, current: DataFrame, key: str, flags: list[str]) -> DataFrame:
    """Current-only flags by key, 0 where there is no row."""
    return df.join(current.select(key, *flags), key, "left").withColumns({f: F.coalesce(f, F.lit(0)) for f in flags})
