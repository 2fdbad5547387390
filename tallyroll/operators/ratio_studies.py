"""Ratio studies put together from the metrics: convention ladders, certification windows, folds and arms.

Where a study compares estimators, they are fitted by least squares on all features (``folds``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import digitize, known, positive
from ..sources.lake import kept
from . import ranks
from .ratio import clean_pairs, ends_by, iqr_trim, ratio_metrics, tier_redistribution

METRICS = ("n", "median_ratio", "cod", "prd", "prb", "mki")


def convention_ladder(cases: DataFrame, trim_width: float = 3.0, least: int = 50) -> DataFrame:
    """Metrics of each (estimator, step) overall and, where outliers are left out, per style of at least ``least`` rows.

    ``cases``: estimator, step, estimate, price, style, trim: whether the step leaves outliers out.
    """
    keys = ["estimator", "step"]
    pairs = iqr_trim(clean_pairs(cases, "estimate", "price"), keys, trim_width).withColumn("_out", F.col("trim") & F.col("is_outlier"))
    gone = pairs.groupBy(*keys).agg(F.count_if("_out").alias("n_trimmed"))
    rows = pairs.where("NOT _out").withColumn("segment", F.explode(F.array_compact(F.array(F.lit("overall"), F.when(F.col("trim"), F.col("style"))))))
    out = ratio_metrics(rows, [*keys, "segment"]).where((F.col("segment") == "overall") | (F.col("n") >= least))
    return out.join(gone, keys)


#: The ladder from the plain out-of-time comparison to that of a published study, in its order.
BRIDGE = ("out_of_time", "time_adjusted", "fresh_roll", "in_window_model", "iaao_trimmed")


def bridge_cases(test: DataFrame, rolls: DataFrame) -> DataFrame:
    """The cases of ``convention_ladder`` for a model and a roll, with ``at``: the step's place in ``BRIDGE``.

    ``test``: parcel_id, sale_price, time_adj_log, style, roll (the value of the sale's own year) and two log predictions of
    today's price: ``before``, learned from earlier sales only, and ``within``, learned from sales of the
    window too, as a reassessment is.  ``rolls``: parcel_id, roll_year, roll_value; the newest year of all is the fresh roll.
    """
    newest = rolls.agg(F.max("roll_year").alias("y")).first()["y"]
    fresh = rolls.where(F.col("roll_year") == F.lit(newest)).groupBy("parcel_id").agg(F.max("roll_value").alias("_fresh"))
    adjust = F.coalesce("time_adj_log", F.lit(0.0))
    today = F.col("sale_price") * F.exp(adjust)
    steps = (
        ("roll", 0, F.col("roll"), F.col("sale_price")), ("model", 0, F.exp(F.col("before") - adjust), F.col("sale_price")),
        ("roll", 1, F.col("roll"), today), ("model", 1, F.exp("before"), today), ("roll", 2, F.col("_fresh"), today), ("model", 3, F.exp("within"), today),
        ("roll", 4, F.col("_fresh"), today), ("model", 4, F.exp("within"), today),
    )
    cases = F.array(*[F.struct(F.lit(e).alias("estimator"), F.lit(k).alias("at"), F.lit(BRIDGE[k]).alias("step"), v.cast("double").alias("estimate"), p.alias("price"), F.lit(k == 4).alias("trim")) for e, k, v, p in steps])
    joined = kept(test.join(fresh, "parcel_id", "left").select("style", "sale_price", "time_adj_log", "roll", "_fresh", "before", "within"), "bridge")
    return joined.select("style", F.explode(cases).alias("c")).select("c.*", "style")


def sale_chasing(sales: DataFrame, rolls: DataFrame, least: int = 200) -> DataFrame:
    """The same roll against sales its assessor could see and sales that came after it.

    ``sales``: parcel_id, sale_date, sale_price, time_adj_log.  ``rolls``: parcel_id, roll_year,
    roll_value.  A roll of year T is certified in spring of T - 1: sales of calendar year T - 2
    were known, those from July of T - 1 to June of T were not.
    """
    year = F.col("roll_year")
    day = lambda y, m, d: F.make_date(y, F.lit(m), F.lit(d))
    both = sales.join(rolls.where("roll_value > 0"), "parcel_id")
    window = F.when(F.year("sale_date") == year - 2, "before_certification").when(F.col("sale_date").between(day(year - 1, 7, 1), day(year, 6, 30)), "after_certification")
    both = both.withColumn("window", window).where("window is not null and sale_price > 0").withColumn("_now", F.col("sale_price") * F.exp(F.coalesce("time_adj_log", F.lit(0.0))))
    keys = ["roll_year", "window"]
    both = kept(both.select(*keys, "roll_value", "sale_price", "_now"), "chased")
    close = F.abs(F.col("roll_value") / F.col("sale_price") - 1) <= 0.02
    raw = both.groupBy(*keys).agg(F.count(F.lit(1)).alias("_all"), F.avg(close.cast("double")).alias("within_2pct")).where(F.col("_all") >= least)
    pairs = iqr_trim(clean_pairs(both, "roll_value", "_now"), keys).where("NOT is_outlier")
    return ratio_metrics(pairs, keys).drop("mki").join(raw.drop("_all"), keys)


def redistribution(sales: DataFrame, levies: DataFrame, residents: int, least: int = 500) -> DataFrame:
    """Per year and benchmark: level, regressivity, the cheaper two fifths' overpayment as a share of the levy and in money.

    ``sales``: sale_date, sale_price, assessed, cash.  ``levies``: year, levy.  The year of the last
    sale is partial unless that sale is of December.
    """
    keys = ["year", "benchmark"]
    rows = sales.select(F.year("sale_date").alias("year"), "assessed", "sale_price", "cash").where("assessed > 0 and sale_price > 0")
    rows = rows.withColumn("benchmark", F.explode(F.when(known("cash"), F.array(F.lit("raw_sale"))).otherwise(F.array(F.lit("raw_sale"), F.lit("financed")))))
    last = sales.agg(F.max("sale_date").alias("d")).first()["d"]
    partial = last.year if last and last.month < 12 else None
    tiers = tier_redistribution(rows, "assessed", "sale_price", keys).groupBy(*keys).agg(F.sum("n").alias("n_sales"), F.max("bottom40_over_share").alias("bottom40"))
    pairs, size = ranks.sized(clean_pairs(rows, "assessed", "sale_price").select(*keys, "sale", "r"), keys)
    level = ranks.group_quantiles(pairs, keys, "r", {"median_ratio": 0.5}, size=size).drop("_n")
    ends = ends_by(pairs, "sale", keys, size)
    out = tiers.where(F.col("n_sales") >= least).join(level, keys).join(ends, keys).join(levies, "year", "left")
    shifted = F.col("bottom40") * F.coalesce("levy", F.lit(0.0))
    return out.select(
        *keys, (F.col("year") == F.lit(partial)).alias("partial_year") if partial else F.lit(False).alias("partial_year"), "n_sales", "median_ratio",
        (F.col("q1_median") / F.col("q5_median")).alias("q1_q5_ratio"), "bottom40", shifted.alias("shifted"), (shifted / residents).alias("per_resident"),
    )


def site_cards(sales: DataFrame, least: int = 50) -> DataFrame:
    """(card, part, n, value): level and uniformity of all and of financed time-adjusted sales, level by price fifth of the
    financed, cash share and cash-to-financed gap of each district with enough of both."""
    pairs = clean_pairs(sales, "assessed", "sale_price")
    moved = clean_pairs(sales.where(~known("cash")).withColumn("_now", F.col("sale_price") * F.exp(F.coalesce("time_adj_log", F.lit(0.0)))), "assessed", "_now")
    moved = iqr_trim(moved, []).where("NOT is_outlier")
    parts = []
    for card, rows in (("full", pairs), ("financed", moved)):
        m = ratio_metrics(rows, [])
        parts.append(m.select(F.lit(card).alias("card"), F.explode(F.array(*[F.struct(F.lit(c).alias("part"), F.col("n").alias("n"), F.col(c).alias("value")) for c in ("median_ratio", "cod", "prd")])).alias("x")).select("card", "x.*"))
    cuts = [ranks.quantile(moved, "sale", k / 5) for k in range(1, 5)]
    tier = sum((F.when(F.col("sale") >= c, 1).otherwise(0) for c in cuts if c is not None), F.lit(1))
    tiers = ranks.group_quantiles(moved.withColumn("part", tier.cast("string")), ["part"], "r", {"value": 0.5}).withColumnRenamed("_n", "n")
    parts.append(tiers.select(F.lit("tier").alias("card"), "part", "n", "value"))
    by = pairs.groupBy(F.col("district").cast("string").alias("part")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(known("cash").cast("double")).alias("cash_share"), F.count_if(known("cash")).alias("_c"), F.count_if(~known("cash")).alias("_f"),
        (F.median(F.when(known("cash"), F.col("r"))) - F.median(F.when(~known("cash"), F.col("r")))).alias("gap"),
    )
    parts.append(by.select(F.lit("cash_share").alias("card"), "part", "n", F.col("cash_share").alias("value")))
    parts.append(by.where((F.col("_c") >= least) & (F.col("_f") >= least)).select(F.lit("cash_gap").alias("card"), "part", "n", F.col("gap").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def leakage_split(predictions: DataFrame, permits: DataFrame) -> DataFrame:
    """Metrics of model and roll over all sales, those without and those with a permit after the sale, and the model's edge.

    ``predictions``: sale_id, parcel_id, sale_date, sale_price, model, roll.  ``permits``: parcel_id, issued.
    """
    last = permits.groupBy("parcel_id").agg(F.max("issued").alias("_last"))
    rows = predictions.join(last, "parcel_id", "left").select("sale_price", "model", "roll", known(F.col("_last") > F.col("sale_date")).alias("_exposed"))
    rows = kept(rows, "leakage")  # both joins once, not again for each arm and pass
    rows = rows.withColumn("subset", F.explode(F.array(F.lit("overall"), F.when(F.col("_exposed"), "exposed").otherwise("safe"))))
    arms = {a: ratio_metrics(clean_pairs(rows, a, "sale_price"), ["subset"]).select("subset", "n", F.col("cod").alias(f"{a}_cod"), F.col("median_ratio").alias(f"{a}_ratio")) for a in ("model", "roll")}
    out = arms["model"].join(arms["roll"].drop("n"), "subset")
    total = F.max(F.when(F.col("subset") == "overall", F.col("n"))).over(Window.partitionBy(F.lit(1)))  # three rows
    return out.select("subset", "n", (F.col("n") / total).alias("share"), "model_cod", "model_ratio", "roll_cod", "roll_ratio", (F.col("roll_cod") - F.col("model_cod")).alias("edge"))


def segment_knots(df: DataFrame, prediction: str, actual: str, segments: int = 5) -> DataFrame:
    """segment, n, center and correction of equal-count segments of the prediction, calibrated values never falling."""
    edges = [ranks.quantile(df, prediction, k / segments) for k in range(1, segments)]
    edges = [] if None in edges else edges
    place = sum((F.when(F.col(prediction) >= e, 1).otherwise(0) for e in edges), F.lit(0)) + 1
    placed = df.withColumns({"segment": place, "_off": F.col(actual) - F.col(prediction)})
    center = ranks.group_quantiles(placed, ["segment"], prediction, {"center": 0.5}).withColumnRenamed("_n", "n")
    rows = ranks.same_keys(center, ranks.group_quantiles(placed, ["segment"], "_off", {"_c": 0.5}).drop("_n"), ["segment"])
    upto = Window.partitionBy(F.lit(1)).orderBy("segment")  # as many rows as segments
    return rows.select("segment", "n", "center", (F.max(F.col("center") + F.col("_c")).over(upto) - F.col("center")).alias("correction"))


def apply_knots(df: DataFrame, knots: DataFrame, prediction: str) -> DataFrame:
    """``calibrated``: the prediction with the correction interpolated between the knots, level outside them."""
    rows = [(r["center"], r["correction"]) for r in knots.orderBy("segment").collect()]  # as many as segments
    x = F.col(prediction)
    if not rows:
        return df.withColumn("calibrated", x)
    out = F.when(x <= rows[0][0], rows[0][1])
    for (a, p), (b, q) in zip(rows, rows[1:]):
        out = out.when(x <= b, F.lit(p) + (q - p) * (x - a) / (b - a if b > a else 1.0))
    return df.withColumn("calibrated", x + out.otherwise(rows[-1][1]))


def control_threshold(scores: DataFrame, level: float = 0.9) -> DataFrame:
    """Screened parcels with their score and whether it is above the controls' ``level`` quantile."""
    limit = ranks.quantile(scores.where("role = 'control'"), "score", level)
    screened = scores.where("role = 'screened' and score is not null")
    return screened.select("parcel_id", "score", (F.col("score") > F.lit(limit)).alias("flag") if limit is not None else F.lit(None).cast("boolean").alias("flag"))


def fold_summary(tested: DataFrame, fold: str, price: str = "sale_price") -> DataFrame:
    """One row: folds, and mean, deviation, least and greatest of their COD."""
    pairs = clean_pairs(tested.withColumn("_e", F.exp("predicted")), "_e", price)
    by = ratio_metrics(pairs, [fold])
    return by.agg(F.count(F.lit(1)).alias("folds"), F.avg("cod").alias("mean"), F.stddev_pop("cod").alias("sd"), F.min("cod").alias("min"), F.max("cod").alias("max"))


def group_gap(tested: DataFrame, keys: list[str], group: str, actual: str = "log_price") -> DataFrame:
    """Per keys: rows of both sides and the median prediction error of the group less that of the others."""
    sides = [*keys, "_side"]
    rows, size = ranks.sized(tested.select(*keys, known(group).alias("_side"), (F.col("predicted") - F.col(actual)).alias("_error")), sides)
    middle = ranks.group_quantiles(rows, sides, "_error", {"_middle": 0.5}, size=size)
    of = lambda side: F.max(F.when(side, F.col("_middle")))
    gaps = middle.groupBy(*keys).agg((of(F.col("_side")) - of(~F.col("_side"))).alias("gap"))
    counts = rows.groupBy(*keys).agg(F.count_if("_side").alias("n_group"), F.count_if(~F.col("_side")).alias("n_rest"))
    return ranks.same_keys(counts, gaps, keys, "left")


def price_fifth(sales: DataFrame, price: str = "sale_price") -> Column:
    """q1 to q5: the fifth of ``sales`` that a price is in; null without prices."""
    cuts = [ranks.quantile(sales, price, k / 5) for k in range(1, 5)]
    return F.lit(None).cast("string") if cuts[0] is None else F.concat(F.lit("q"), (digitize(price, cuts) + 1).cast("string"))


def value_conventions(sales: DataFrame, estimate: str, discounts: dict[str, float]) -> DataFrame:
    """(arm, segment, n, cash_share, median_ratio): a roll's level at the price paid (roll) and at the retail price (roll_retail).

    ``sales``: segment, cash and sale_price.  What was sold for cash would have fetched its price over one plus the
    cash discount of its segment; a sale of which that isn't known counts as one for cash.
    """
    cash = F.coalesce("cash", F.lit(True))
    off = F.coalesce(*[F.when(F.col("segment") == s, F.lit(float(d))) for s, d in discounts.items()], F.lit(0.0))
    level, retail = positive(estimate) / positive("sale_price"), 1 + F.when(cash, off).otherwise(0.0)
    both = F.array(F.struct(F.lit("roll").alias("arm"), level.alias("r")), F.struct(F.lit("roll_retail").alias("arm"), (level * retail).alias("r")))
    keys = ["arm", "segment"]
    rows, size = ranks.sized(sales.select("segment", cash.alias("_cash"), F.explode(both).alias("_b")).select("segment", "_cash", "_b.arm", "_b.r"), keys)
    told = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("_cash").cast("double")).alias("cash_share"))
    return ranks.same_keys(told, ranks.group_quantiles(rows, keys, "r", {"median_ratio": 0.5}, size=size).drop("_n"), keys, "left")
