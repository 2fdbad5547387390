"""Valuation arms on Spark ML: trees, forest, ridge, isotonic calibration, forest quantiles, clusters.

Random choices are seeded; what a fit sees is split by time before.
"""

from __future__ import annotations

import json

from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.lake import kept
from . import ranks

SEED = 7


def _features(numeric: list[str], categorical: list[str], one_hot: bool) -> list:
    stages: list = [Imputer(strategy="median", inputCols=numeric, outputCols=[f"_{c}" for c in numeric])]
    names = [f"_{c}" for c in numeric]
    if categorical:
        stages.append(StringIndexer(inputCols=categorical, outputCols=[f"_{c}_ix" for c in categorical], stringOrderType="alphabetAsc", handleInvalid="keep"))
        names += [f"_{c}_ix" for c in categorical]
        if one_hot:
            stages.append(OneHotEncoder(inputCols=[f"_{c}_ix" for c in categorical], outputCols=[f"_{c}_oh" for c in categorical]))
            names = [f"_{c}" for c in numeric] + [f"_{c}_oh" for c in categorical]
    stages.append(VectorAssembler(inputCols=names, outputCol="features"))
    return stages


def fit_arm(df: DataFrame, kind: str, numeric: list[str], categorical: list[str], label: str, weight: str | None = None, output: str | None = None):
    """A fitted pipeline; ``kind``: gbt, forest or ridge.  Its prediction is in the column ``output``, by default ``kind``."""
    own = {"labelCol": label, "featuresCol": "features", "predictionCol": output or kind} | ({"weightCol": weight} if weight else {})
    if kind == "gbt":
        model = GBTRegressor(maxDepth=4, maxIter=12, stepSize=0.2, seed=SEED, maxBins=64, **own)
    elif kind == "forest":
        model = RandomForestRegressor(numTrees=16, maxDepth=6, seed=SEED, maxBins=64, leafCol="leaves", **own)
    elif kind == "ridge":
        model = LinearRegression(elasticNetParam=0.0, regParam=1.0 / max(1, df.count()), **(own | {"featuresCol": "scaled"}))
    else:
        raise ValueError(kind)
    stages = _features(numeric, categorical, kind == "ridge")
    if kind == "ridge":
        stages.append(StandardScaler(inputCol="features", outputCol="scaled"))
    return Pipeline(stages=[*stages, model]).fit(df)


def isotonic_residual(df: DataFrame, prediction: str, label: str):
    """A monotone correction of the residual by the prediction; its output is in ``correction``."""
    rows = df.withColumn("_residual", F.col(label) - F.col(prediction))
    return IsotonicRegression(featuresCol=prediction, labelCol="_residual", predictionCol="correction").fit(rows)


def leaf_quantiles(fitted: DataFrame, label: str, shares: dict[str, float], in_one_task: int | None = None) -> DataFrame:
    """tree, leaf and for each name of ``shares`` that quantile of the fit rows' label in the leaf.

    The trees share the label's order, so many rows are dealt by steps of it once for all trees, and only the values of the
    steps around a leaf's quantiles are put in order.
    """
    rows = fitted.where(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("_v"), vector_to_array("leaves").cast("array<int>").alias("_leaves"))
    leaf = F.posexplode("_leaves").alias("tree", "leaf")
    if rows.count() <= (ranks.IN_ONE_TASK if in_one_task is None else in_one_task):
        return rows.select("_v", leaf).groupBy("tree", "leaf").agg(*[F.percentile("_v", F.lit(s)).alias(name) for name, s in shares.items()])
    dealt = kept(ranks.dealt_by_value(kept(rows, "leaves"), [], F.col("_v"), ranks.MOST_PARTS), "dealt-leaves")
    return ranks.dealt_quantiles(dealt.select("_v", "_part", leaf), ["tree", "leaf"], shares).drop("_n")


def with_forest_quantiles(fitted: DataFrame, target: DataFrame, label: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """``target`` with q_low and q_high: quantiles of the fit rows' label in each of the row's leaves, averaged over the trees.

    Both frames carry ``leaves`` from the forest arm.  One row for each leaf of the forest, whose size the
    fit bounds, reaches the driver and goes to every task, so no row is copied for each tree.
    """
    table = leaf_quantiles(fitted, label, {"_lo": low, "_hi": high}).collect()
    wide = [1 + max((r["leaf"] for r in table if r["tree"] == t), default=-1) for t in range(1 + max((r["tree"] for r in table), default=-1))]
    found = {c: [[None] * n for n in wide] for c in ("_lo", "_hi")}
    for r in table:
        for c in found:
            found[c][r["tree"]][r["leaf"]] = r[c]
    told = lambda c: F.from_json(F.lit(json.dumps(found[c])), "array<array<double>>")
    leaves = vector_to_array("leaves").cast("array<int>")

    def mean(c: str) -> Column:
        own = F.array_compact(F.transform(leaves, lambda leaf, tree: F.get(F.get(F.col(c), tree), leaf)))
        return F.try_divide(F.aggregate(own, F.lit(0.0), lambda s, v: s + v), F.nullif(F.size(own), F.lit(0)))

    both = target.withColumns({c: told(c) for c in found}).withColumns({"_a": mean("_lo"), "_b": mean("_hi")})
    return both.withColumns({"q_low": F.least("_a", "_b"), "q_high": F.greatest("_a", "_b")}).drop("_lo", "_hi", "_a", "_b")


def forest_quantiles(fitted: DataFrame, target: DataFrame, key: str, label: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """key, q_low, q_high of ``with_forest_quantiles``, without rows that have none."""
    return with_forest_quantiles(fitted, target, label, low, high).where("q_low IS NOT NULL").select(key, "q_low", "q_high")


def market_areas(points: DataFrame, n_areas: int, columns: tuple[str, ...] = ("x_m", "y_m", "level"), scaled: bool = True) -> DataFrame:
    """points with area: k-means on the columns, each divided by its deviation where ``scaled``."""
    stages = [VectorAssembler(inputCols=list(columns), outputCol="_raw")]
    if scaled:
        stages.append(StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True))
    stages.append(KMeans(featuresCol="_scaled" if scaled else "_raw", predictionCol="area", k=n_areas, seed=SEED))
    return Pipeline(stages=stages).fit(points).transform(points).drop("_raw", "_scaled")


def districts(points: DataFrame, n_districts: int) -> DataFrame:
    """area, district, n, level: k-means on the areas' centres, with their number of points and median level."""
    areas = points.groupBy("area").agg(F.avg("x_m").alias("x_m"), F.avg("y_m").alias("y_m"))
    stats = ranks.group_quantiles(points, ["area"], "level", {"level_": 0.5}).withColumnsRenamed({"_n": "n", "level_": "level"})
    placed = market_areas(areas.withColumnRenamed("area", "_area"), n_districts, ("x_m", "y_m"), scaled=False).select(F.col("_area").alias("area"), F.col("area").alias("district"))
    return placed.join(stats, "area")


def drivers(model, df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, feature, contribution of a ridge arm over numeric columns: coefficient times distance from the mean."""
    ridge = model.stages[-1]
    means = df.agg(*[F.avg(f"_{c}").alias(c) for c in columns]).first()
    scale = model.stages[-2].std
    parts = [F.struct(F.lit(c).alias("feature"), ((F.col(f"_{c}") - means[c]) * float(ridge.coefficients[i] / scale[i])).alias("contribution")) for i, c in enumerate(columns)]
    return df.select(key, F.explode(F.array(*parts)).alias("p")).select(key, "p.*")
