"""How wrong an estimate is likely to be: a model of the absolute log error, admitted only if it holds up out of time."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.lake import kept
from . import ranks
from .models import fit_arm

# Fixed values of the rule: least rows, shares of the calibration scores where tiers begin, and what a model must show.
LEAST_VALIDATION, LEAST_TEST = 500, 300
ELEVATED_SHARE, HIGH_SHARE = 0.75, 0.90
LEAST_SPEARMAN, LEAST_RMSE_RATIO = 0.10, 1.20
RETAINED = (0.25, 0.50, 0.75, 0.90, 1.0)
TIERS = ("standard", "elevated", "high")
#: The model's own prediction, under a name that rows scored by other arms don't have.
ARM = "_risk_gbt"


def average_ranks(df: DataFrame, c: str, name: str) -> DataFrame:
    """``df`` with the rank of ``c`` from 1, equal values sharing the mean of their places; by counts per value."""
    values = df.groupBy(c).agg(F.count(F.lit(1)).alias("_same"))
    placed = ranks.running(values, [], [c], "_upto", F.col("_same")).withColumn(name, F.col("_upto") - (F.col("_same") - 1) / 2)
    return df.join(placed.select(c, name), c)


def spearman(df: DataFrame, a: str, b: str) -> float | None:
    """Rank correlation; None where a column doesn't vary."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("_a"), F.col(b).alias("_b"))
    both = average_ranks(average_ranks(rows, "_a", "_ra"), "_b", "_rb")
    found = both.agg(F.covar_pop("_ra", "_rb").alias("c"), F.var_pop("_ra").alias("a"), F.var_pop("_rb").alias("b")).first()
    return found["c"] / math.sqrt(found["a"] * found["b"]) if found["a"] and found["b"] else None


def tier_of(score: str, elevated: float, high: float):
    return F.when(F.col(score) >= high, TIERS[2]).when(F.col(score) >= elevated, TIERS[1]).otherwise(TIERS[0])


def evaluate(df: DataFrame, score: str, error: str, elevated: float, high: float) -> DataFrame:
    """(view, segment, n, share, mean_score, mean_error, rmse): each tier, and what is left when only the least risky are retained.

    Rows are retained by score, ties by error.
    """
    rows = kept(ranks.running(df.select(F.col(score).alias("s"), F.col(error).alias("e")), [], ["s", "e"], "k"), "risk")
    n = rows.count()
    told = lambda g: g.agg(F.count(F.lit(1)).alias("n"), F.avg("s").alias("mean_score"), F.avg("e").alias("mean_error"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"))
    tiers = told(rows.groupBy(F.lit("tier").alias("view"), tier_of("s", elevated, high).alias("segment")))
    shares = F.explode(F.array(*[F.struct(F.lit(f"retain_{r:.2f}").alias("name"), F.lit(max(1, math.ceil(n * r))).alias("upto")) for r in RETAINED]))
    left = told(rows.withColumn("x", shares).where(F.col("k") <= F.col("x.upto")).groupBy(F.lit("risk_coverage").alias("view"), F.col("x.name").alias("segment")))
    both = tiers.unionByName(left)
    return both.select("view", "segment", "n", (F.col("n") / F.lit(max(n, 1))).alias("share"), "mean_score", "mean_error", "rmse")


def promotion(evaluation: DataFrame, correlation: float | None) -> str | None:
    """Why a model is not admitted; None if it is."""
    tiers = {r["segment"]: r for r in evaluation.where("view = 'tier'").collect()}
    if any(t not in tiers for t in TIERS):
        return "a tier has no rows"
    if (correlation or 0.0) < LEAST_SPEARMAN:
        return "rank correlation with the error is too low"
    errors = [tiers[t]["mean_error"] for t in TIERS]
    if not errors[0] < errors[1] < errors[2]:
        return "errors do not rise with the tier"
    if tiers["high"]["rmse"] < LEAST_RMSE_RATIO * tiers["standard"]["rmse"]:
        return "the high tier is not wrong enough"
    return None


@dataclass
class Risk:
    """What ``fit_risk`` found; without a promoted model every row is standard, with score 0."""

    model: object | None
    elevated: float | None
    high: float | None
    correlation: float | None
    evaluation: DataFrame | None
    rejected: str | None

    def score(self, rows: DataFrame) -> DataFrame:
        if self.rejected or self.model is None:
            return rows.withColumns({"risk_score": F.lit(0.0), "risk_tier": F.lit(TIERS[0])})
        scored = _scored(self.model, rows)
        return scored.withColumn("risk_tier", tier_of("risk_score", self.elevated, self.high))


def _scored(model, rows: DataFrame) -> DataFrame:
    out = model.transform(rows).withColumn("risk_score", F.greatest(ARM, F.lit(0.0)))
    return out.select(*rows.columns, "risk_score")


def fit_risk(validation: DataFrame, test: DataFrame, inputs: list[str], error: str, order: list[str]) -> Risk:
    """A model of ``error`` (absolute, in logs) learned from the first four fifths of the validation rows by ``order``.

    The last fifth sets where the tiers begin, the test rows decide whether the model is admitted.  Missing
    inputs count as zero.
    """
    if validation.count() < LEAST_VALIDATION or test.count() < LEAST_TEST:
        return Risk(None, None, None, None, None, "too few rows")
    filled = lambda df: df.fillna(0.0, inputs)
    placed = kept(ranks.running(filled(validation), [], order, "_nth"), "risk-validation")
    cut = max(1, int(placed.count() * 0.8))
    model = fit_arm(placed.where(F.col("_nth") <= cut), "gbt", inputs, [], error, output=ARM)
    calibration = kept(_scored(model, placed.where(F.col("_nth") > cut)), "risk-calibration")
    elevated, high = (ranks.quantile(calibration, "risk_score", q) for q in (ELEVATED_SHARE, HIGH_SHARE))
    scored = kept(_scored(model, filled(test)), "risk-test")
    told = kept(evaluate(scored, "risk_score", error, elevated, high), "risk-evaluation")
    correlation = spearman(scored, "risk_score", error)
    return Risk(model, elevated, high, correlation, told, promotion(told, correlation))
