"""Studies of who is over- and under-valued: roll changes, levels by value, tax shifts, gates."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import digitize, ratio
from . import ranks
from .ratio import ends_by


def annual_roll(rolls: DataFrame, old: int, new: int) -> DataFrame:
    """Parcels on both rolls with both values and the change, from (parcel_id, year, value)."""
    wide = rolls.where(F.col("year").isin(old, new)).groupBy("parcel_id").pivot("year", [old, new]).agg(F.max("value"))
    out = wide.select("parcel_id", F.col(str(old)).alias("value_old"), F.col(str(new)).alias("value_new"))
    return out.where("value_old > 0 and value_new > 0").withColumn("change", ratio("value_new", "value_old") - 1)


def roll_summary(matched: DataFrame, dead_band: float = 0.02) -> DataFrame:
    """Directions with a dead band, quartiles of the change and totals, per value fifth of the old roll."""
    # Ranks over all rows: counts per value bucket come first, so no task sorts the whole roll.
    buckets = matched.groupBy(F.floor("value_old").alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    before = buckets.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_before"))
    n = matched.count()
    rows = matched.withColumn("_b", F.floor("value_old")).join(before, "_b")
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_b").orderBy("value_old", "parcel_id")) - 1
    rows = rows.withColumn("fifth", (F.floor(place * 5 / F.lit(max(1, n))) + 1).cast("int"))
    return rows.groupBy("fifth").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("change") > dead_band).alias("n_up"),
        F.count_if(F.col("change") < -dead_band).alias("n_down"),
        F.median("change").alias("median_change"),
        F.percentile("change", F.lit(0.25)).alias("q25"),
        F.percentile("change", F.lit(0.75)).alias("q75"),
        (F.sum("value_new") / F.sum("value_old")).alias("total_ratio"),
    )


def value_standardised(pairs: DataFrame, group: str, edges: list[float], min_cell: int) -> DataFrame:
    """Groups compared within value bins that all groups fill: mean over bins of the log median ratio."""
    rows = pairs.withColumn("bin", digitize("sale", edges))
    cells = rows.groupBy("bin", group).agg(F.count(F.lit(1)).alias("n"), F.ln(F.median("r")).alias("level")).where(F.col("n") >= min_cell)
    groups = rows.select(group).distinct().count()
    full = cells.groupBy("bin").agg(F.count_distinct(group).alias("_g")).where(F.col("_g") == groups).select("bin")
    return cells.join(full, "bin", "left_semi").groupBy(group).agg(F.count(F.lit(1)).alias("bins"), F.avg("level").alias("level"))


def tax_shift(df: DataFrame, assessed: str, fair: str, edges: list[float], rate: float) -> DataFrame:
    """Per value bin: how much more tax is paid at a fixed rate than on fair values with the same total."""
    total = df.agg((F.sum(assessed) / F.sum(fair)).alias("k")).first()["k"] or 1.0
    over = (F.col(assessed) - F.col(fair) * F.lit(total)) * rate
    return df.groupBy(digitize(fair, edges).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum(over).alias("shift"), F.avg(over).alias("per_row"))


def robustness_grid(pairs: DataFrame, subset: str, by: list[str]) -> DataFrame:
    """Bottom and top fifth medians for all rows and a subset, by each of several columns."""
    pairs, size = ranks.sized(pairs.select(F.col(subset).alias("_subset"), "r", *[F.col(b).cast("double").alias(b) for b in by]), [])
    long = pairs.withColumn("which", F.explode(F.when(F.col("_subset"), F.array(F.lit("all"), F.lit("subset"))).otherwise(F.array(F.lit("all")))))
    ends = [ends_by(long, b, ["which"], size).select("which", F.lit(b).alias("by"), "q1_median", "q5_median") for b in by]
    return functools.reduce(DataFrame.unionByName, ends)


def promotion_gate(challenger: DataFrame, incumbent: DataFrame, key: str, metric: str, tolerance: float) -> DataFrame:
    """One row: segments compared, worst change, whether overall improved and no segment got worse than allowed."""
    two = challenger.select(key, F.col(metric).alias("_c")).join(incumbent.select(key, F.col(metric).alias("_i")), key).withColumn("delta", F.col("_c") - F.col("_i"))
    overall = F.max(F.when(F.col(key) == "overall", F.col("delta")))
    return two.agg(F.count(F.lit(1)).alias("segments"), F.max("delta").alias("worst"), ((overall < 0) & F.bool_and(F.col("delta") <= tolerance)).alias("promote"))


def cash_value(price: str, edges: list[float], discounts: list[float]):
    """A retail price with its tier's discount, and the retail equivalent of a cash price."""
    d = F.element_at(F.array(*map(F.lit, discounts)), digitize(price, edges) + 1)
    return F.col(price) * (1 + d), F.col(price) / (1 + d)


def event_sample(population: DataFrame, touched: list[DataFrame], n: int, seed: int) -> DataFrame:
    """n rows of the population that no event touched, by a seeded hash of their key."""
    union = touched[0].select("parcel_id")
    for t in touched[1:]:
        union = union.unionByName(t.select("parcel_id"))
    quiet = population.join(union.distinct(), "parcel_id", "left_anti")
    return quiet.orderBy(F.xxhash64(F.lit(seed), "parcel_id"), "parcel_id").limit(n)


def router_weight(log_value, centre: float, scale: float):
    """Logistic weight of the low-value model."""
    x = F.col(log_value) if isinstance(log_value, str) else log_value
    return 1 / (1 + F.exp((x - centre) / scale))


def classifier_calibration(df: DataFrame, probability: str, label: str, keys: list[str]) -> DataFrame:
    """Brier score, and the area under the curve by average ranks."""
    w = Window.partitionBy(*keys)
    ranked = df.withColumns({"_lo": F.rank().over(w.orderBy(probability)), "_ties": F.count(F.lit(1)).over(Window.partitionBy(*keys, probability))})
    rank = F.col("_lo") + (F.col("_ties") - 1) / 2
    y = F.col(label).cast("double")
    n1, n = F.sum(y), F.count(F.lit(1))
    auc = F.try_divide(F.sum(F.when(y == 1, rank)) - n1 * (n1 + 1) / 2, n1 * (n - n1))
    return ranked.groupBy(*keys).agg(n.alias("n"), F.avg((F.col(probability) - y) * (F.col(probability) - y)).alias("brier"), auc.alias("auc"))
