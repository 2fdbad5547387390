"""Snapshots and derived tables in a lake folder, with provenance beside them.

Layout: ``raw/source=…/dataset=…/fetched_at=…`` for snapshots and ``<layer>/<table>`` for derived
tables; a derived table's provenance is one JSON row in ``_provenance/layer=…/table=…``.
"""

from __future__ import annotations

import datetime
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIX = {"staged": "stg", "mart": "mart"}


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh folder under spark.checkpoint.dir; only on one machine, where that is unset, a local one."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not base:
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/tallyroll-{os.getpid()}"
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def kept(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once in the shared folder and read back: lineage ends there, and its shuffle files go."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)
    return spark.read.schema(df.schema).parquet(path)


def write_snapshot(df: DataFrame, base: str, source: str, dataset: str, stamp: str) -> str:
    """A snapshot, whole or not at all: Spark's commit leaves _SUCCESS only when all is written."""
    path = f"{base}/raw/source={source}/dataset={dataset}/fetched_at={stamp}"
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    return path


def _statuses(spark: SparkSession, pattern: str) -> list[str]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return [s.getPath().toString() for s in found or []]


def list_snapshots(spark: SparkSession, base: str) -> DataFrame:
    """source, dataset, fetched_at and complete, of snapshots that were finished."""
    rows = []
    for p in sorted(_statuses(spark, f"{base}/raw/source=*/dataset=*/fetched_at=*/_SUCCESS")):
        part = dict(x.split("=", 1) for x in p.split("/") if "=" in x)
        rows.append((part["source"], part["dataset"], part["fetched_at"], True))
    return spark.createDataFrame(rows, "source string, dataset string, fetched_at string, complete boolean").orderBy("dataset", "fetched_at")


def latest_snapshot(spark: SparkSession, base: str, source: str, dataset: str) -> DataFrame:
    """The newest finished snapshot; only its folder is read."""
    done = _statuses(spark, f"{base}/raw/source={source}/dataset={dataset}/fetched_at=*/_SUCCESS")
    if not done:
        raise ValueError(f"no snapshot of {source}/{dataset}")
    return spark.read.parquet(max(done).removesuffix("/_SUCCESS"))


def latest_snapshots(spark: SparkSession, base: str) -> DataFrame:
    """dataset and the newest finished ``fetched_at`` of each; stamps sort as text."""
    return list_snapshots(spark, base).groupBy("dataset").agg(F.max("fetched_at").alias("fetched_at"))


def freshness(spark: SparkSession, base: str, expected: DataFrame, now: str, max_age_days: float) -> DataFrame:
    """dataset, fetched_at, age_days and status of every expected dataset: ok, STALE beyond ``max_age_days``, or MISSING.

    ``now``: a stamp like those of the snapshots.
    """
    moment = lambda c: F.to_timestamp(c, "yyyyMMdd'T'HHmmss'Z'")
    seconds = F.unix_timestamp(moment(F.lit(now))) - F.unix_timestamp(moment(F.col("fetched_at")))
    out = expected.select("dataset").join(latest_snapshots(spark, base), "dataset", "left").withColumn("age_days", seconds / 86_400)
    status = F.when(F.col("age_days").isNull(), "MISSING").when(F.col("age_days") > max_age_days, "STALE").otherwise("ok")
    return out.select("dataset", "fetched_at", "age_days", status.alias("status"))


PROVENANCE = "layer string, table string, built_at string, rows long, inputs array<string>"


def write_derived(df: DataFrame, base: str, layer: str, table: str, inputs: dict[str, str], built_at: str | None = None) -> str:
    """A derived table and, when it is whole, its provenance: when it was built, of how many rows, from which ``layer/table``."""
    path = f"{base}/{layer}/{table}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    at = built_at or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    spark = df.sparkSession
    side = spark.createDataFrame([(layer, table, at, spark.read.parquet(path).count(), sorted(inputs))], PROVENANCE)
    side.write.mode("overwrite").json(f"{base}/_provenance/{layer}-{table}")
    return path


def provenance(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.schema(PROVENANCE).json(f"{base}/_provenance/*")


class StaleError(RuntimeError):
    """A derived table is older than something it was built from."""


def lineage(spark: SparkSession, base: str) -> DataFrame:
    """(layer, table, input_layer, input_table, depth): everything a derived table was built from, at the fewest steps.

    One join a step, until no new pair is found; a table that was built from itself by a detour ends, too.
    """
    p = provenance(spark, base)
    side = lambda c: F.struct(F.element_at(F.split(c, "/", 2), 1).alias("layer"), F.element_at(F.split(c, "/", 2), 2).alias("table"))
    uses = p.select("layer", "table", F.explode("inputs").alias("i")).where(F.col("i").contains("/")).select("layer", "table", side(F.col("i")).alias("i"))
    step = kept(uses.select("layer", "table", F.col("i.layer").alias("input_layer"), F.col("i.table").alias("input_table")).distinct(), "lineage")
    known, depth = step.withColumn("depth", F.lit(1)), 1
    last = step
    while True:
        depth += 1
        nearer = step.select(F.col("layer").alias("input_layer"), F.col("table").alias("input_table"), F.col("input_layer").alias("_l"), F.col("input_table").alias("_t"))
        more = last.join(nearer, ["input_layer", "input_table"]).select("layer", "table", F.col("_l").alias("input_layer"), F.col("_t").alias("input_table")).distinct()
        last = kept(more.join(known, ["layer", "table", "input_layer", "input_table"], "left_anti"), "lineage")
        if last.isEmpty():
            return known
        known = kept(known.unionByName(last.withColumn("depth", F.lit(depth))), "lineage")


def stale(spark: SparkSession, base: str) -> DataFrame:
    """Derived tables and what they were built from, at any depth, that is newer than they are or than a table on the way.

    (layer, table, input_layer, input_table, depth, built_at, input_built_at): a table is stale if it is
    older than an input, and so is everything built from it, through the same input.
    """
    made = provenance(spark, base).select("layer", "table", "built_at")
    own = made.withColumnsRenamed({"layer": "input_layer", "table": "input_table", "built_at": "input_built_at"})
    every = lineage(spark, base)
    late = every.join(made, ["layer", "table"]).join(own, ["input_layer", "input_table"]).where("input_built_at > built_at")
    late = kept(late, "late")
    # What was built from a stale table has the same newer input, further away.
    through = every.select("layer", "table", F.col("input_layer").alias("_l"), F.col("input_table").alias("_t"), F.col("depth").alias("_d"))
    passed = through.join(late.select(F.col("layer").alias("_l"), F.col("table").alias("_t"), "input_layer", "input_table", "depth", "input_built_at"), ["_l", "_t"])
    passed = passed.select("layer", "table", "input_layer", "input_table", (F.col("_d") + F.col("depth")).alias("depth"), "input_built_at").join(made, ["layer", "table"])
    both = late.unionByName(passed)
    keys = ["layer", "table", "input_layer", "input_table"]
    return both.groupBy(*keys).agg(F.min("depth").alias("depth"), F.max("built_at").alias("built_at"), F.max("input_built_at").alias("input_built_at"))


def require_fresh(spark: SparkSession, base: str, layer: str, table: str, allow_stale: bool = False) -> list[str]:
    """Refuses to go on with a stale table; with ``allow_stale`` only tells what is newer."""
    newer = stale(spark, base).where((F.col("layer") == layer) & (F.col("table") == table)).orderBy("depth", "input_layer", "input_table").collect()
    told = [f"{layer}/{table} ({r['built_at']}) predates {r['input_layer']}/{r['input_table']} ({r['input_built_at']})" for r in newer]
    if told and not allow_stale:
        raise StaleError("; ".join(told))
    return told


def register_views(spark: SparkSession, base: str) -> list[str]:
    """A temporary view per derived table: stg_<table>, mart_<table>."""
    names = []
    for r in provenance(spark, base).select("layer", "table").distinct().collect():
        name = f"{PREFIX.get(r['layer'], r['layer'])}_{r['table']}"
        spark.read.parquet(f"{base}/{r['layer']}/{r['table']}").createOrReplaceTempView(name)
        names.append(name)
    return sorted(names)
