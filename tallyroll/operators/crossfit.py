"""Scores that no row's own outcome has touched: recorded facts by hash folds, transitions by expanding time."""

from __future__ import annotations

import functools
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import known
from ..sources.lake import kept
from . import ranks
from .models import SEED, _features, fit_arm

# Plausible areas, how far the recorded area may be from the building's, and what counts as an outlier.
AREA_RANGE = (300.0, 10_000.0)
COHERENT_RATIO = (0.55, 1.30)
AREA_OUTLIER_SHARE = 0.995
RECORD_OUTLIER_SHARE = 0.95
MAD_TO_SIGMA = 1.4826
MOST_ROOMS = 20.0
FEWEST_PER_FOLD = 100
#: Steps of a number, as many as the trees tell apart, and how many models are fitted at once.
BINS, FITS_AT_ONCE = 64, 4
#: Fixed names of the result, with their types.
QUALITY = {
    "quality_expected_livable_area": "double", "quality_area_reference_low_90": "double", "quality_area_reference_high_90": "double",
    "quality_area_ratio_to_expected": "double", "quality_area_log_residual": "double", "quality_area_disagreement_z": "double",
    "quality_area_outlier": "boolean", "quality_expected_beds": "double", "quality_expected_baths": "double",
    "quality_bed_zero_conflict": "double", "quality_bath_zero_conflict": "double", "quality_zero_bed_bath_conflict": "boolean",
    "quality_characteristic_conflict_score": "double", "quality_characteristic_outlier": "boolean",
}


def hash_fold(key: str, folds: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(folds)).cast("int")


def binned(rows: DataFrame, numeric: list[str]) -> DataFrame:
    """``rows`` with ``_<name>_bin`` for each of ``numeric``: its place among at most ``BINS`` steps of about as many rows, null for none.

    A column of at most ``BINS`` values has a step for each.  The steps depend on the columns themselves alone.
    """
    num = {c: F.col(c).cast("double") for c in numeric}
    num = {c: F.when(~F.isnan(v), v) for c, v in num.items()}
    shares = [k / (BINS - 1) for k in range(BINS - 1)]
    told = rows.agg(*[F.percentile_approx(v, shares, 10_000).alias(f"e_{c}") for c, v in num.items()], *[F.approx_count_distinct(v).alias(f"n_{c}") for c, v in num.items()]).first()
    out = {}
    for c, v in num.items():
        edges = sorted(set(told[f"e_{c}"] or []))
        if told[f"n_{c}"] < 2 * BINS:
            each = sorted(r[0] for r in rows.select(v.alias("v")).where("v IS NOT NULL").distinct().limit(BINS + 1).collect())
            edges = each[:-1] if each and len(each) <= BINS else edges
        out[f"_{c}_bin"] = F.when(v.isNotNull(), _steps_below(v, edges, 0, len(edges)))
    return rows.withColumns(out)


def _steps_below(v: Column, edges: list[float], low: int, high: int) -> Column:
    """How many of the sorted ``edges`` are below ``v``, by halving; between ``low`` and ``high`` of them."""
    if low == high:
        return F.lit(float(low))
    middle = (low + high) // 2
    return F.when(F.lit(edges[middle]) < v, _steps_below(v, edges, middle + 1, high)).otherwise(_steps_below(v, edges, low, middle))


def out_of_fold(rows: DataFrame, labels: dict[str, tuple[Column, Column]], numeric: list[str], categorical: list[str], folds: int) -> DataFrame:
    """``rows`` with a column for each name of ``labels`` (which rows are learned from, and their label): each row's
    prediction by the arm fitted to the learned rows of the other folds.

    Trees see numbers only by steps (``binned``), so rows that are alike in all steps and categories are one row of their
    number and mean label: a fit's work doesn't grow with the table but with how many differ.
    """
    ready = binned(rows, numeric)
    bins = [f"_{c}_bin" for c in numeric]
    sums = [e for t, (learned, label) in labels.items() for e in (F.count_if(learned & label.isNotNull()).alias(f"{t}_n"), F.sum(F.when(learned, label)).alias(f"{t}_sum"))]
    alike = kept(ready.groupBy("fold", *bins, *categorical).agg(*sums).where(" + ".join(f"{t}_n" for t in labels) + " > 0"), "alike")
    # How many rows of each fold lie in each step: the middle one stands for a number that is missing.
    steps = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("bin")) for c in bins])).alias("s")
    counts = alike.select("fold", steps, *[f"{t}_n" for t in labels]).where("s.bin IS NOT NULL").groupBy("fold", "s.name", "s.bin").agg(*[F.sum(f"{t}_n").alias(t) for t in labels]).collect()

    def middle(t: str, f: int, c: str) -> float:
        held = sorted((r["bin"], r[t]) for r in counts if r["fold"] != f and r["name"] == c)
        half = sum(n for _, n in held) / 2
        return next((b for i, (b, _) in enumerate(held) if sum(n for _, n in held[: i + 1]) >= half), 0.0)

    def fit(task: tuple[str, int]):
        t, f = task
        filled = {c: middle(t, f, c) for c in bins}
        some = alike.where((F.col("fold") != f) & (F.col(f"{t}_n") > 0)).fillna(filled)
        some = some.groupBy(*bins, *categorical).agg(F.sum(f"{t}_n").cast("double").alias("_weight"), (F.sum(f"{t}_sum") / F.sum(f"{t}_n")).alias("_label"))
        return filled, fit_arm(some, "gbt", bins, categorical, "_label", weight="_weight", output=t)

    tasks = [(t, f) for t in labels for f in range(folds)]
    with ThreadPool(FITS_AT_ONCE) as pool:
        arms = dict(zip(tasks, pool.map(inheritable_thread_target(fit), tasks)))
    parts = []
    for f in range(folds):
        out, names = ready.where(F.col("fold") == f), list(rows.columns)
        for t in labels:
            filled, arm = arms[t, f]
            told = arm.transform(out.withColumns({f"_own_{c}": F.col(c) for c in bins}).fillna(filled, bins))
            names.append(t)
            out = told.select(*names, *[F.col(f"_own_{c}").alias(c) for c in bins])
        parts.append(out.select(*names))
    return functools.reduce(DataFrame.unionByName, parts)


def characteristic_quality(
    records: DataFrame, numeric: list[str], categorical: list[str], folds: int = 3, seed: int = 42, least: int = 1000
) -> tuple[DataFrame, dict]:
    """(parcel_id and the ``QUALITY`` columns, what was fitted) of records with one row for each parcel.

    ``records``: parcel_id, livable_area, beds, baths, gross_area (the building's own), area_conflict, and the
    predictors, which may not include the first three.  Area, beds and baths are reconstructed by
    models that never saw the parcel, fitted to records whose area agrees with the building's.  The residual of the log area is
    centred and scaled by median and median absolute deviation over a wider set of records.  Records
    without an area have no score.  With too few records to learn from, the results are null (false for the flags).
    """
    num = lambda c: F.col(c).cast("double")
    fine = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    rows = kept(records.withColumns({"livable_area": num("livable_area"), "beds": num("beds"), "baths": num("baths"), "gross_area": num("gross_area"), "fold": hash_fold("parcel_id", folds, seed)}), "records")
    agree = F.coalesce(num("area_conflict"), F.lit(0.0)) <= 0
    plausible = known(fine("livable_area") & F.col("livable_area").between(*AREA_RANGE)) & agree
    calibrated = plausible & known(fine("gross_area") & (F.col("gross_area") > 0))
    coherent = calibrated & known(F.try_divide("livable_area", "gross_area").between(*COHERENT_RATIO))
    positive = {c: coherent & known(fine(c) & (F.col(c) > 0) & (F.col(c) <= MOST_ROOMS)) for c in ("beds", "baths")}
    counts = rows.agg(
        F.count_if(coherent).alias("area"), *[F.count_if(p).alias(c) for c, p in positive.items()], *[F.count_if(coherent & (F.col("fold") != f)).alias(f"_{f}") for f in range(folds)]
    ).first()
    reason = None
    if counts["area"] < least:
        reason = "too_few_coherent_area_records"
    elif any(counts[f"_{f}"] < FEWEST_PER_FOLD for f in range(folds)):
        reason = "too_few_area_records_per_fold"
    else:
        reason = next((f"too_few_positive_{c}_records" for c in positive if counts[c] < least), None)
    if reason:
        none = [(F.lit(False) if t == "boolean" else F.lit(None).cast(t)).alias(c) for c, t in QUALITY.items()]
        return records.select("parcel_id", *none), {"status": "not_fit", "reason": reason}
    log_area = F.when(fine("livable_area"), F.ln(F.greatest("livable_area", F.lit(1.0))))
    labels = {"_log_area": (coherent, log_area)} | {f"_{c}": (p, F.log1p(F.greatest(c, F.lit(0.0)))) for c, p in positive.items()}
    out = out_of_fold(rows, labels, numeric, categorical, folds)
    out = kept(out.withColumn("_residual", log_area - F.col("_log_area")), "reconstructed")
    seen = out.where(calibrated & F.col("_residual").isNotNull())
    centre = ranks.median(seen, "_residual")
    off = seen.withColumn("_off", F.abs(F.col("_residual") - centre))
    sigma = max(MAD_TO_SIGMA * ranks.median(off, "_off"), 1e-6)
    low, high = (ranks.quantile(seen, "_residual", q) for q in (0.05, 0.95))
    limit = ranks.quantile(off.withColumn("_off", F.col("_off") / sigma), "_off", AREA_OUTLIER_SHARE)
    expected = F.exp("_log_area")
    z = (F.col("_residual") - centre) / sigma
    rooms = {c: F.greatest(F.expm1(f"_{c}"), F.lit(0.0)) for c in positive}
    zero = {c: known(fine(c) & (F.col(c) <= 0)) for c in positive}
    gap = {c: F.when(zero[c], rooms[c]).otherwise(0.0) for c in positive}
    score = F.when(z.isNotNull(), F.greatest(F.abs(z) / 3, gap["beds"] / 3, gap["baths"] / 1.5))
    out = kept(out.select(
        "parcel_id",
        expected.alias("quality_expected_livable_area"), (expected * F.exp(F.lit(low))).alias("quality_area_reference_low_90"), (expected * F.exp(F.lit(high))).alias("quality_area_reference_high_90"),
        (F.col("livable_area") / expected).alias("quality_area_ratio_to_expected"), F.col("_residual").alias("quality_area_log_residual"), z.alias("quality_area_disagreement_z"),
        known(F.abs(z) > limit).alias("quality_area_outlier"), rooms["beds"].alias("quality_expected_beds"), rooms["baths"].alias("quality_expected_baths"),
        gap["beds"].alias("quality_bed_zero_conflict"), gap["baths"].alias("quality_bath_zero_conflict"),
        (zero["beds"] & zero["baths"] & (gap["beds"] >= 1.0) & (gap["baths"] >= 0.75)).alias("quality_zero_bed_bath_conflict"),
        score.alias("quality_characteristic_conflict_score"),
    ), "quality")
    cut = ranks.quantile(out, "quality_characteristic_conflict_score", RECORD_OUTLIER_SHARE)
    out = out.withColumn("quality_characteristic_outlier", known(F.col("quality_characteristic_conflict_score") >= cut))
    found = {"status": "ok", "folds": folds, "seed": seed, "area_records": counts["area"], "bed_records": counts["beds"], "bath_records": counts["baths"]}
    return out, found | {"centre": centre, "sigma": sigma, "q05": low, "q95": high, "outlier_z": limit, "score_cut": cut}


# Fixed values of the transition classifier: the least of each class, of the calibration rows, and where these begin.
LEAST_OF_CLASS = 100
LEAST_HELD = 100
TRAIN_SHARE = 0.8


@dataclass
class Transition:
    """A classifier with a monotone calibration; ``score`` adds ``probability``."""

    model: object
    calibration: object
    rounds: int
    rows: int
    positives: int

    def score(self, rows: DataFrame) -> DataFrame:
        raw = self.model.transform(rows).withColumn("_raw", F.get(vector_to_array("probability"), F.lit(1))).select(*rows.columns, "_raw")
        told = self.calibration.transform(raw)
        eligible = F.coalesce(F.col("eligible").cast("double"), F.lit(0.0))
        return told.withColumn("probability", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "_calibrated")) * eligible).select(*rows.columns, "probability")


def fit_transition(labelled: DataFrame, inputs: list[str], rounds: int = 20, seed: int = SEED) -> Transition | None:
    """Fitted to ``labelled`` (label, inputs and ``_nth``: the row's number by time, from 1); None with too few rows.

    The first four fifths train, the later fifth picks the number of boosting rounds and calibrates; the
    classifier is then fitted again to all rows with that many rounds.
    """
    n, positives = labelled.agg(F.count(F.lit(1)), F.count_if(F.col("label") > 0)).first()
    if positives < LEAST_OF_CLASS or n - positives < LEAST_OF_CLASS:
        return None
    cut = max(1, int(n * TRAIN_SHARE))
    train, held = labelled.where(F.col("_nth") <= cut), labelled.where(F.col("_nth") > cut)
    held_n, held_positives = held.agg(F.count(F.lit(1)), F.count_if(F.col("label") > 0)).first()
    if held_n < LEAST_HELD or held_positives in (0, held_n):
        return None
    boost = lambda m: GBTClassifier(labelCol="label", featuresCol="features", maxDepth=4, maxIter=m, stepSize=0.2, minInstancesPerNode=10, seed=seed)
    first = Pipeline(stages=[*_features(inputs, [], False), boost(rounds)]).fit(train)
    prepared = held
    for stage in first.stages[:-1]:
        prepared = stage.transform(prepared)
    losses = first.stages[-1].evaluateEachIteration(prepared)
    best = 1 + min(range(len(losses)), key=losses.__getitem__)
    if best < rounds:
        first = Pipeline(stages=[*_features(inputs, [], False), boost(best)]).fit(train)
    raw = first.transform(held).select(F.get(vector_to_array("probability"), F.lit(1)).alias("_raw"), F.col("label").cast("double").alias("label"))
    calibration = IsotonicRegression(featuresCol="_raw", labelCol="label", predictionCol="_calibrated").fit(raw)
    final = Pipeline(stages=[*_features(inputs, [], False), boost(best)]).fit(labelled)
    return Transition(final, calibration, best, n, positives)


def crossfit_transition(rows: DataFrame, inputs: list[str], folds: int = 5, rounds: int = 20, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(rows with fold and probability, one row for each fold): expanding time, so no row meets its own or a later label.

    ``rows``: sale_id, sale_date, eligible, label (0, 1 or null) and inputs.  Fold f is the f-th equal
    count of rows by (sale_date, sale_id) and is scored by a classifier of the labelled rows before it.  Where
    these are too few, eligible rows have a null probability and others zero.
    """
    timed = ranks.running(rows, [], ["sale_date", "sale_id"], "_place")
    timed = ranks.running(timed, [], ["sale_date", "sale_id"], "_nth", F.col("label").isNotNull().cast("long"))
    total = rows.count()
    starts = [total * f // folds for f in range(folds + 1)]
    fold = functools.reduce(lambda a, s: a + F.when(F.col("_place") > s, 1).otherwise(0), starts[1:-1], F.lit(1))
    timed = kept(timed.withColumn("fold", fold), "timed")
    labelled = timed.where("label IS NOT NULL")
    scored, told = [], []
    for f in range(folds):
        current = timed.where(F.col("fold") == f + 1)
        earlier = labelled.where(F.col("_place") <= starts[f])
        fitted = fit_transition(earlier, inputs, rounds, seed + f) if starts[f] else None
        if fitted:
            scored.append(fitted.score(current))
        else:
            unknown = F.when(F.coalesce(F.col("eligible").cast("double"), F.lit(0.0)) > 0, F.lit(None).cast("double")).otherwise(0.0)
            scored.append(current.withColumn("probability", unknown))
        told.append((f + 1, starts[f + 1] - starts[f], earlier.count() if starts[f] else 0, "trained" if fitted else "insufficient_history_missing"))
    folds_told = rows.sparkSession.createDataFrame(told, "fold int, prediction_rows long, label_rows_before_fold long, status string")
    out = functools.reduce(DataFrame.unionByName, scored)
    return out.drop("_place", "_nth"), folds_told
