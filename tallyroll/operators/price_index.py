"""Constant-quality price indexes: repeat sales, and monthly medians shrunk to the city."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import quarter_number

MIN_HELD_YEARS = 0.49
MAX_LOG_PER_YEAR = 0.35
CITY = "__city__"


def repeat_pairs(sales: DataFrame, min_price: float = 10_000.0, first: str = "1997-01-01") -> DataFrame:
    """Consecutive sales of a parcel: quarters, log change and years held, extremes left out."""
    chain = Window.partitionBy("parcel_id").orderBy("sale_date", "sale_id")
    rows = sales.where((F.col("sale_price") > min_price) & F.col("sale_date").isNotNull())
    rows = rows.withColumns({"d1": F.lag("sale_date").over(chain), "p1": F.lag("sale_price").over(chain)})
    rows = rows.withColumns({"held": F.datediff("sale_date", "d1") / F.lit(365.25), "dlog": F.ln("sale_price") - F.ln("p1")})
    keep = (F.col("held") >= MIN_HELD_YEARS) & (F.abs(F.col("dlog") / F.nullif("held", F.lit(0.0))) <= MAX_LOG_PER_YEAR)
    rows = rows.where(keep & (F.col("d1") >= F.lit(first).cast("date")))
    return rows.withColumns({"q1": quarter_number("d1"), "q2": quarter_number("sale_date")})


def repeat_curve(pairs: DataFrame, geo: str, parent: DataFrame | None = None, ridge: float = 0.0) -> DataFrame:
    """(geo, quarter, log_index) by least squares on the pairs' quarters, the first pinned to 0.

    The normal equations are summed in Spark, one row per (geo, q1, q2), so a task gets at most the
    square of the number of quarters, whatever the number of sales.  With a parent curve the
    solution is pulled towards it by ``ridge``; without one a quarter that no pair touches carries
    the last value on.
    """
    cells = pairs.groupBy(F.col(geo).alias("geo"), "q1", "q2").agg(F.count(F.lit(1)).alias("n"), F.sum("dlog").alias("s"))
    last = pairs.agg(F.max("q2")).first()[0]
    quarters = 1 + (last if last is not None else 0)
    if parent is not None:
        cells = cells.join(parent, "geo", "left")
    else:
        cells = cells.withColumn("prior", F.lit(None).cast("array<double>"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = np.zeros((quarters, quarters)), np.zeros(quarters)
        q1, q2 = pdf["q1"].to_numpy(), pdf["q2"].to_numpy()
        n, s = pdf["n"].to_numpy(float), pdf["s"].to_numpy(float)
        for i, j, v in ((q1, q1, n), (q2, q2, n), (q1, q2, -n), (q2, q1, -n)):
            np.add.at(a, (i, j), v)
        np.add.at(b, q2, s)
        np.add.at(b, q1, -s)
        prior = pdf["prior"].iloc[0]
        x = np.zeros(quarters)
        touched = np.diag(a) > 0
        touched[0] = False
        if prior is not None and ridge > 0:
            free = np.arange(1, quarters)
            x[free] = np.linalg.solve(a[np.ix_(free, free)] + ridge * np.eye(len(free)), b[free] + ridge * np.asarray(prior)[free])
        else:
            free = np.flatnonzero(touched)
            if len(free):
                x[free] = np.linalg.lstsq(a[np.ix_(free, free)], b[free], rcond=None)[0]
            for t in range(1, quarters):
                if not touched[t]:
                    x[t] = x[t - 1]
        return pd.DataFrame({"geo": pdf["geo"].iloc[0], "quarter": np.arange(quarters), "log_index": x})

    return cells.groupBy("geo").applyInPandas(solve, "geo string, quarter int, log_index double")


def curve_arrays(curve: DataFrame) -> DataFrame:
    """(geo, prior): a curve as one array per geography, to be a parent."""
    return curve.groupBy("geo").agg(F.transform(F.array_sort(F.collect_list(F.struct("quarter", "log_index"))), lambda x: x["log_index"]).alias("prior"))


def hierarchy(pairs: DataFrame, area: str, district: str, min_pairs: int = 200, district_ridge: float = 25.0, area_ridge: float = 6.0) -> DataFrame:
    """City, then districts pulled to the city, then areas with enough pairs pulled to their district."""
    city = repeat_curve(pairs.withColumn("_g", F.lit(CITY)), "_g")
    prior = curve_arrays(city).select("prior")
    districts = pairs.select(F.col(district).alias("geo")).distinct()
    top = prior.first()
    parent = districts.withColumn("prior", F.array(*[F.lit(float(x)) for x in (top["prior"] if top else [])]))
    by_district = repeat_curve(pairs, district, parent, district_ridge)
    big = pairs.groupBy(area).agg(F.count(F.lit(1)).alias("_n"), F.min(district).alias("_d")).where(F.col("_n") >= min_pairs)
    parent = big.join(curve_arrays(by_district).withColumnRenamed("geo", "_d"), "_d").select(F.col(area).alias("geo"), "prior")
    rows = pairs.join(big.select(area), area, "left_semi")
    return city.unionByName(by_district).unionByName(repeat_curve(rows, area, parent, area_ridge))


def median_index(sales: DataFrame, geo: str, value: str, shrink: float = 15.0) -> DataFrame:
    """(geo, month, log_index, n_sales): monthly medians on the whole grid, shrunk to the city's."""
    rows = sales.select(F.col(geo).alias("geo"), F.trunc("sale_date", "month").alias("month"), F.col(value).alias("v"))
    city = rows.groupBy("month").agg(F.median("v").alias("city"))
    cells = rows.groupBy("geo", "month").agg(F.median("v").alias("own"), F.count(F.lit(1)).alias("n_sales"))
    # The grid: months are few (one row a month); each geography gets all of them.
    months = city.agg(F.sort_array(F.collect_set("month"))).first()[0]
    grid = rows.select("geo").distinct().withColumn("month", F.explode(F.array(*[F.lit(m) for m in months]) if months else F.array().cast("array<date>")))
    out = grid.join(cells, ["geo", "month"], "left").join(city, "month")
    n = F.coalesce("n_sales", F.lit(0))
    blend = (n * F.coalesce("own", F.lit(0.0)) + shrink * F.col("city")) / (n + shrink)
    return out.select("geo", "month", blend.alias("log_index"), n.alias("n_sales"))


def smooth(index: DataFrame, half: int = 2) -> DataFrame:
    """Centred moving mean over ``2 * half + 1`` months of each geography."""
    w = Window.partitionBy("geo").orderBy("month").rowsBetween(-half, half)
    return index.withColumn("log_index", F.avg("log_index").over(w))


def reference(index: DataFrame, months: int = 12) -> DataFrame:
    """Less the mean of each geography's last months, and its last month as ref_month."""
    w = Window.partitionBy("geo")
    place = F.row_number().over(w.orderBy(F.desc("month")))
    rows = index.withColumn("_k", place)
    level = F.avg(F.when(F.col("_k") <= months, F.col("log_index"))).over(w)
    return rows.withColumns({"log_index": F.col("log_index") - level, "ref_month": F.max("month").over(w)}).drop("_k")


def snap_tail(index: DataFrame, area_to_district: DataFrame, months: int = 12) -> DataFrame:
    """In the last months an area takes its district's index where there is one."""
    districts = index.select(F.col("geo").alias("_d"), "month", F.col("log_index").alias("_v"))
    end = index.agg(F.add_months(F.max("month"), 1 - months).alias("m")).first()["m"]
    out = index.join(area_to_district.select(F.col("area").alias("geo"), F.col("district").alias("_d")), "geo", "left").join(districts, ["_d", "month"], "left")
    value = F.when((F.col("month") >= F.lit(end)) & F.col("_v").isNotNull(), F.col("_v")).otherwise(F.col("log_index"))
    return out.withColumn("log_index", value).select(index.columns)


def time_adjust(sales: DataFrame, index: DataFrame, geos: list[str], day: str = "sale_date") -> DataFrame:
    """time_adj_log: minus the index at the sale's month (held to the index's range) of the first geography that has one."""
    ends = index.agg(F.min("month").alias("lo"), F.max("month").alias("hi")).first()
    month = F.least(F.greatest(F.trunc(day, "month"), F.lit(ends["lo"])), F.lit(ends["hi"]))
    out = sales.withColumn("_m", month)
    for i, g in enumerate([*geos, F.lit(CITY)]):
        side = index.select(F.col("geo").alias(f"_g{i}"), F.col("month").alias("_m"), F.col("log_index").alias(f"_v{i}"))
        out = out.withColumn(f"_g{i}", F.col(g).cast("string") if isinstance(g, str) else g).join(side, [f"_g{i}", "_m"], "left")
    n = len(geos) + 1
    adj = -F.coalesce(*[F.col(f"_v{i}") for i in range(n)], F.lit(0.0))
    return out.withColumn("time_adj_log", adj).drop("_m", *[f"_{x}{i}" for i in range(n) for x in "gv"])
