"""Cross-fitted scores of records and transitions, and the channel gap in stages, over orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import channel, crossfit
from .adapters import read
from .catalog import query, r

# Orders as records of parcels: what is recorded, what the building itself measures, and predictors.
_TRUE = "(300.0E0 + (o_custkey * 37) % 2500)"
_RECORD = {
    "parcel_id": "o_orderkey",
    "livable_area": f"CASE WHEN o_orderkey % 71 = 0 THEN NULL WHEN o_orderkey % 50 = 0 THEN {_TRUE} * 3 ELSE {_TRUE} * (0.9E0 + (o_orderkey * 7) % 21 / 100.0E0) END",
    "beds": f"CASE WHEN o_orderkey % 17 = 0 THEN 0 ELSE 1 + floor({_TRUE} / 500) END",
    "baths": f"CASE WHEN o_orderkey % 34 = 0 OR o_orderkey % 23 = 0 THEN 0 ELSE 1 + floor({_TRUE} / 1100) END",
    "gross_area": f"CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE {_TRUE} * (1.0E0 + o_orderkey % 13 / 50.0E0) END",
    "area_conflict": "CASE WHEN o_orderkey % 41 = 0 THEN 1.0E0 END",
    "footprint": f"{_TRUE} * (0.45E0 + o_orderkey % 3 / 20.0E0)",
    "floors": "1.0E0 + o_orderkey % 3",
    "x_m": "CAST((o_custkey * 7919) % 10007 AS DOUBLE)",
    "style": "CASE o_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'row' ELSE 'twin' END",
}
RECORD_NUMERIC, RECORD_CATEGORICAL = ["footprint", "floors", "x_m", "gross_area"], ["style"]


def records(spark, sf_dir):
    return read(spark, sf_dir, "orders").selectExpr(*[f"{e} AS {c}" for c, e in _RECORD.items()])


@query()
def chr_quality_crossfit(spark, sf_dir):
    rows = records(spark, sf_dir).withColumn("style", F.coalesce("style", F.lit("none")))
    return crossfit.characteristic_quality(rows, RECORD_NUMERIC, RECORD_CATEGORICAL)[0]


_EPISODE = {
    "sale_id": "o_orderkey",
    "sale_date": "CAST(o_orderdate AS DATE)",
    "eligible": "CASE WHEN o_orderkey % 6 = 0 THEN 0 ELSE 1 END",
    "label": "CASE WHEN o_orderkey % 3 > 0 THEN CASE WHEN (o_custkey * 13) % 100 + (o_orderkey * 7) % 60 > 80 THEN 1.0E0 ELSE 0.0E0 END END",
    "distress": "CAST((o_custkey * 13) % 100 AS DOUBLE)",
    "gain": "CASE WHEN o_orderkey % 14 = 0 THEN NULL ELSE o_totalprice / 100000.0E0 END",
    "works": "CAST(o_custkey % 5 AS DOUBLE)",
}
EPISODE_INPUTS = ["distress", "gain", "works"]


def episodes(spark, sf_dir):
    return read(spark, sf_dir, "orders").selectExpr(*[f"{e} AS {c}" for c, e in _EPISODE.items()])


@query()
def mdl_transition(spark, sf_dir):
    return crossfit.crossfit_transition(episodes(spark, sf_dir), EPISODE_INPUTS)[0].select("sale_id", "fold", "probability")


# Orders as sales through two channels: houses, their faults, and how they were paid.
CHANNEL_SALE = {
    "sale_id": "o_orderkey",
    "sale_price": "o_totalprice * CASE WHEN o_orderkey % 4 = 0 THEN 0.8E0 ELSE 1.0E0 END",
    "time_adj_log": "CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE (o_orderkey % 20) / 100.0E0 END",
    "district": "CASE WHEN o_custkey % 31 > 0 THEN o_custkey % 6 END",
    "cash": "o_orderkey % 4 = 0",
    "area": "CAST(300 + (o_custkey * 37) % 2500 AS DOUBLE)",
    "beds": "CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE 1 + o_custkey % 4 END",
    "style": "CASE o_custkey % 5 WHEN 0 THEN 'row' WHEN 1 THEN 'twin' WHEN 2 THEN 'detached' WHEN 3 THEN NULL ELSE 'row' END",
    "delinquent": "CASE WHEN o_custkey % 13 = 0 THEN 1 ELSE 0 END",
    "violations": "CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 3 END",
}
CHANNEL_INPUTS = (["area"], ["beds"], ["style"], ["delinquent", "violations"])


def channel_sales(spark, sf_dir, columns: dict[str, str] = CHANNEL_SALE):
    return read(spark, sf_dir, "orders").selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])


def staged_parts(columns: dict[str, str] = CHANNEL_SALE) -> list[str]:
    """CTEs w0 to w7: each column is freed of the district means, then of the columns before it, one after the other; what
    is left of cash explains what is left of the price."""
    hedonic = ["ln(1 + area) AS a1", "coalesce(beds, mb) AS a2", "CAST(style = 'row' AS INT) AS a3", "CAST(style = 'twin' AS INT) AS a4", "CAST(style = 'detached' AS INT) AS a5"]
    distress = ["delinquent AS a6", "coalesce(violations, 0) AS a7"]
    names = [f"a{i}" for i in range(1, 8)]
    parts = [
        f"d AS (SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM orders), e AS (SELECT * FROM d WHERE district IS NOT NULL AND sale_price > 0)",
        "q AS (SELECT quantile_cont(sale_price, [0.2, 0.4, 0.6, 0.8]) AS c FROM e)",
        "s AS (SELECT e.*, unnest(['overall', 'q' || CAST(len(list_filter(c, lambda z: z <= sale_price)) + 1 AS VARCHAR)]) AS segment FROM e, q)",
        "m AS (SELECT segment, median(beds) AS mb FROM s GROUP BY segment)",
        f"x AS (SELECT segment, district, {', '.join([*hedonic, *distress])}, CAST(cash AS INT) AS c, ln(sale_price) + coalesce(time_adj_log, 0) AS y FROM s JOIN m USING (segment))",
        "w0 AS (SELECT segment, " + ", ".join(f"coalesce({v}, 0) - avg(coalesce({v}, 0)) OVER (PARTITION BY segment, district) AS {v}" for v in [*names, "c", "y"]) + " FROM x)",
    ]
    for i, v in enumerate(names):
        rest = [*names[i + 1 :], "c", "y"]
        free = ", ".join(f"{o} - {v} * coalesce(sum({o} * {v}) OVER g / nullif(sum({v} * {v}) OVER g, 0), 0) AS {o}" for o in rest)
        parts.append(f"w{i + 1} AS (SELECT segment, {free} FROM w{i} WINDOW g AS (PARTITION BY segment))")
    return parts


def _staged_sql() -> str:
    parts = staged_parts()
    stages = " UNION ALL ".join(f"SELECT segment, '{stage}' AS stage, sum(c * y) / sum(c * c) AS b, count(*) AS n FROM w{k} GROUP BY segment" for stage, k in (("raw", 0), ("hedonic", 5), ("distress", 7)))
    return f"WITH {', '.join(parts)} SELECT segment, stage, {r('exp(b) - 1', 'cash_discount_pct')}, n FROM ({stages})"


@query(_staged_sql())
def eq_channel_decomposition(spark, sf_dir):
    return channel.decompose(channel_sales(spark, sf_dir), *CHANNEL_INPUTS, draws=0)[0].drop("ci_low", "ci_high")


@query()
def eq_channel_bootstrap(spark, sf_dir):
    table = channel.decompose(channel_sales(spark, sf_dir), *CHANNEL_INPUTS)[0]
    return table.where("segment = 'overall'")
