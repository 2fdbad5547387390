"""Geometry and model queries over customers, orders and embeddings."""

from __future__ import annotations

import math

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..functions.columns import M_PER_DEG_LAT, M_PER_DEG_LON_EQUATOR, ORIGIN_LAT, ORIGIN_LON
from ..operators import comps, geometry, intervals, models
from ..sources.lake import kept
from .adapters import read, sales
from .catalog import query, r

XY = "CAST((c_custkey * 7919) % 10007 AS DOUBLE) AS x_m, CAST((c_custkey * 104729) % 10009 AS DOUBLE) AS y_m"


_XY = ("CAST((c_custkey * 7919) % 10007 AS DOUBLE) AS x_m", "CAST((c_custkey * 104729) % 10009 AS DOUBLE) AS y_m")


def _points(spark, sf_dir):
    return read(spark, sf_dir, "customer").selectExpr("c_custkey AS point_id", "c_nationkey", "c_acctbal", *_XY)


def _ring(*corners):
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in corners])


@query(
    f"""WITH p AS (SELECT c_custkey AS point_id, {XY} FROM customer)
SELECT point_id, CASE WHEN x_m < 4000 AND y_m < 3000 THEN 'south west' WHEN x_m >= 6000 AND x_m < 10000 AND y_m < 2 * (x_m - 6000) AND y_m < 2 * (10000 - x_m) THEN 'triangle' END AS poly_id FROM p
WHERE NOT (y_m = 0 OR y_m = 2 * (x_m - 6000) OR y_m = 2 * (10000 - x_m))"""
)
def geo_tract_join(spark, sf_dir):
    shapes = spark.range(1).select(F.explode(F.array(
        F.struct(F.lit("south west").alias("poly_id"), _ring((0, 0), (4000, 0), (4000, 3000), (0, 3000)).alias("ring")),
        F.struct(F.lit("triangle").alias("poly_id"), _ring((6000, 0), (10000, 0), (8000, 4000)).alias("ring")),
    )).alias("s")).select("s.*")
    p = _points(spark, sf_dir).where("NOT (y_m = 0 OR y_m = 2 * (x_m - 6000) OR y_m = 2 * (10000 - x_m))")
    return geometry.point_in_polygons(p, shapes, 1000.0)


@query(
    f"""WITH p AS (SELECT c_custkey AS point_id, {XY} FROM customer), s AS (SELECT s_suppkey % 100 AS id, CAST((s_suppkey * 7919) % 10007 AS DOUBLE) AS x1, CAST((s_suppkey * 104729) % 10009 AS DOUBLE) AS y1 FROM supplier),
d AS (SELECT point_id, x_m, y_m, x1, y1, x1 + 500 AS x2, y1 + 300 AS y2, least(greatest(((x_m - x1) * 500 + (y_m - y1) * 300) / 340000.0e0, 0), 1) AS t FROM p, s),
m AS (SELECT point_id, min(sqrt((x_m - x1 - t * 500) ** 2 + (y_m - y1 - t * 300) ** 2)) AS d FROM d GROUP BY point_id)
SELECT point_id, {r("d", "distance")} FROM m"""
)
def geo_nearest_distance(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").selectExpr("CAST((s_suppkey * 7919) % 10007 AS DOUBLE) AS x1", "CAST((s_suppkey * 104729) % 10009 AS DOUBLE) AS y1")
    s = s.withColumns({"x2": F.col("x1") + 500, "y2": F.col("y1") + 300})
    return geometry.nearest_segment(_points(spark, sf_dir), s, 500.0, 1)


@query(
    f"""WITH RECURSIVE p AS (SELECT c_custkey AS id, {XY} FROM customer), e AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON (a.x_m - b.x_m) ** 2 + (a.y_m - b.y_m) ** 2 <= 10000),
w AS (SELECT a AS id, b AS c FROM e UNION SELECT w.id, e.b FROM w JOIN e ON w.c = e.a)
SELECT id AS point_id, min(c) AS component FROM w GROUP BY id"""
)
def geo_connected_components(spark, sf_dir):
    p = _points(spark, sf_dir)
    return geometry.near_components(p, 100.0)


@query(
    f"""WITH RECURSIVE p AS (SELECT c_custkey AS id, {XY} FROM customer WHERE c_mktsegment = 'BUILDING'), e AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON (a.x_m - b.x_m) ** 2 + (a.y_m - b.y_m) ** 2 <= 90000),
w AS (SELECT a AS id, b AS c FROM e UNION SELECT w.id, e.b FROM w JOIN e ON w.c = e.a), m AS (SELECT id, min(c) AS component FROM w GROUP BY id)
SELECT component, count(*) AS units FROM m GROUP BY component"""
)
def mkt_building_clusters(spark, sf_dir):
    units = read(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").selectExpr("c_custkey AS point_id", *_XY)
    found = geometry.near_components(units, 300.0)
    return found.groupBy("component").agg(F.count(F.lit(1)).alias("units"))


@query(
    """WITH n AS (SELECT p_size AS street, p_type AS class, count(*) AS n FROM part GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY street ORDER BY n DESC, class) AS k FROM n)
SELECT street, class FROM k WHERE k = 1"""
)
def geo_street_class(spark, sf_dir):
    return geometry.modal_value(read(spark, sf_dir, "part").select(F.col("p_size").alias("street"), F.col("p_type").alias("class")), "street", "class")


@query(f"SELECT c_custkey AS point_id, {XY} FROM customer WHERE (c_custkey * 7919) % 10007 BETWEEN 1000 AND 3000 AND (c_custkey * 104729) % 10009 BETWEEN 1000 AND 3000")
def geo_bbox_query(spark, sf_dir):
    return _points(spark, sf_dir).where("x_m BETWEEN 1000 AND 3000 AND y_m BETWEEN 1000 AND 3000").select("point_id", "x_m", "y_m")


@query("SELECT c_nationkey, least(count(*), 5) AS n FROM customer GROUP BY ALL")
def geo_stratified_sample(spark, sf_dir):
    picked = geometry.stratified_sample(_points(spark, sf_dir), "c_nationkey", "point_id", 5, 7)
    return picked.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH p AS (SELECT c_custkey AS id, c_acctbal AS v, {XY} FROM customer), m AS (SELECT avg(v) AS m, var_pop(v) AS s, count(*) AS n FROM p), z AS (SELECT id, v - m AS z, x_m, y_m FROM p, m),
d AS (SELECT a.id, a.z, b.z AS y, (a.x_m - b.x_m) ** 2 + (a.y_m - b.y_m) ** 2 AS d, b.id AS o FROM z a JOIN z b ON a.id <> b.id),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, o) AS k FROM d), l AS (SELECT id, avg(y) AS lag FROM k WHERE k <= 10 GROUP BY id)
SELECT max(n) AS n, {r("avg(z * coalesce(lag, 0)) / max(s)", "morans_i")} FROM z LEFT JOIN l USING (id), m"""
)
def met_morans_i(spark, sf_dir):
    return geometry.morans_i(_points(spark, sf_dir), "c_acctbal", 10, 1000.0, 2)


def _rectangle(width: str, height: str) -> str:
    """A SQL text of a GeoJSON part, in degrees, of so many metres from the plane's origin."""
    lon, lat = M_PER_DEG_LON_EQUATOR * math.cos(math.radians(ORIGIN_LAT)), M_PER_DEG_LAT
    corner = lambda x, y: f"'[', CAST({ORIGIN_LON}E0 + ({x}) / {lon}E0 AS STRING), ',', CAST({ORIGIN_LAT}E0 + ({y}) / {lat}E0 AS STRING), ']'"
    return "concat('[[', " + ", ',', ".join(corner(x, y) for x, y in (("0", "0"), (width, "0"), (width, height), ("0", height), ("0", "0"))) + ", ']]')"


_LOT = _rectangle("10 + c_custkey % 40", "20")
# Every fifth lot is a multipolygon whose first part is a shed.
_GEO = f"""CASE WHEN c_custkey % 5 > 0 THEN concat('{{"type":"Polygon","coordinates":', {_LOT}, '}}') ELSE concat('{{"type":"MultiPolygon","coordinates":[', {_rectangle("3", "2")}, ',', {_LOT}, ']}}') END"""


@query(
    f"""WITH a AS (SELECT c_custkey AS id, 10 + c_custkey % 40 AS w FROM customer)
SELECT id, {r("CASE WHEN id % 13 <> 0 THEN w * 20 END", "area")}, {r("CASE WHEN id % 13 <> 0 THEN 2 * w + 40 END", "perimeter")}, CASE WHEN id % 13 <> 0 THEN 4 END AS vertices,
{r("CASE WHEN id % 13 <> 0 THEN abs(w - 20) / 2 END", "edge_sd")}, {r("CASE WHEN id % 13 <> 0 THEN 0 END", "angle_sd")}, {r("CASE WHEN id % 13 <> 0 THEN 0 END", "centroid_sd")},
{r("CASE WHEN id % 13 <> 0 THEN 1 END", "box_area_ratio")}, {r("CASE WHEN id % 13 <> 0 THEN greatest(w, 20) / least(w, 20) END", "box_side_ratio")} FROM a"""
)
def stg_parcel_shapes(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").selectExpr("c_custkey AS id", f"CASE WHEN c_custkey % 13 <> 0 THEN {_GEO} WHEN c_custkey % 26 = 0 THEN 'no json' END AS g")
    rings = rows.select("id", geometry.in_metres(geometry.part_of("g")).alias("rings"))
    parts = rings.select("id", F.get("rings", F.lit(0)).alias("ring"), F.slice("rings", F.lit(2), F.size("rings")).alias("holes"))
    return geometry.shape_measures(parts, "ring", "holes").drop("ring", "holes")


N_AREAS, N_DISTRICTS, VOTES = 350, 18, 7


def _sale_points(spark, sf_dir):
    """Orders as sale points: log price per area less the median of its month."""
    p = sales(spark, sf_dir).select(F.col("sale_id").alias("point_id"), "x_m", "y_m", F.trunc("sale_date", "month").alias("month"), F.ln(F.col("sale_price") / F.col("area")).alias("v"))
    months = p.groupBy("month").agg(F.median("v").alias("_m"))
    return kept(p.join(months, "month").select("point_id", "x_m", "y_m", (F.col("v") - F.col("_m")).alias("level")), "sale-points")


def _parcels(spark, sf_dir):
    return _points(spark, sf_dir).select(F.col("point_id").alias("parcel_id"), F.when(F.col("point_id") % 19 > 0, F.col("x_m") + 3).alias("x_m"), "y_m")


@query()
def geo_market_areas(spark, sf_dir):
    return geometry.vote_areas(_parcels(spark, sf_dir), models.market_areas(_sale_points(spark, sf_dir), N_AREAS), VOTES)


@query(
    f"""WITH p AS (SELECT c_custkey AS parcel_id, CASE WHEN c_custkey % 19 > 0 THEN CAST((c_custkey * 7919) % 10007 AS DOUBLE) + 3 END AS x, CAST((c_custkey * 104729) % 10009 AS DOUBLE) AS y FROM customer),
s AS (SELECT o_orderkey AS point_id, CAST((o_custkey * 7919) % 10007 AS DOUBLE) AS x_m, CAST((o_custkey * 104729) % 10009 AS DOUBLE) AS y_m, o_orderkey % 5 AS area FROM orders),
m AS (SELECT parcel_id, list_max(min((x - x_m) ** 2 + (y - y_m) ** 2, {VOTES})) AS far FROM p, s WHERE x IS NOT NULL GROUP BY parcel_id),
k AS (SELECT parcel_id, area, row_number() OVER (PARTITION BY parcel_id ORDER BY sqrt((x - x_m) ** 2 + (y - y_m) ** 2), point_id) AS k FROM p JOIN m USING (parcel_id), s WHERE (x - x_m) ** 2 + (y - y_m) ** 2 <= far),
v AS (SELECT parcel_id, area, row_number() OVER (PARTITION BY parcel_id ORDER BY count(*) DESC, area) AS r FROM k WHERE k <= {VOTES} GROUP BY parcel_id, area)
SELECT p.parcel_id, v.area FROM p LEFT JOIN v ON p.parcel_id = v.parcel_id AND r = 1"""
)
def geo_area_vote(spark, sf_dir):
    points = sales(spark, sf_dir).select(F.col("sale_id").alias("point_id"), "x_m", "y_m", (F.col("sale_id") % 5).alias("area"))
    return geometry.vote_areas(_parcels(spark, sf_dir), points, VOTES)


@query()
def geo_districts(spark, sf_dir):
    return models.districts(models.market_areas(_sale_points(spark, sf_dir), N_AREAS), N_DISTRICTS)


@query()
def geo_contiguity(spark, sf_dir):
    labels = models.market_areas(_sale_points(spark, sf_dir), N_AREAS)
    voted = geometry.vote_areas(_parcels(spark, sf_dir), labels, VOTES).join(_parcels(spark, sf_dir), "parcel_id")
    return geometry.contiguous_areas(voted.withColumnRenamed("parcel_id", "point_id"), "area")


NUMERIC, CATEGORICAL = ["area", "x_m", "y_m", "month"], ["priority"]


def _sample(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sale_id"), F.col("o_orderpriority").alias("priority"))
    rows = sales(spark, sf_dir).join(o, "sale_id").withColumns({"month": F.month("sale_date").cast("double"), "label": F.ln("sale_price") / 4 + F.ln("area")})
    return kept(intervals.time_split(rows, "sale_date", "sale_id"), "sample")  # every stage of a fit reads it again


def _scored(spark, sf_dir, kind):
    rows = _sample(spark, sf_dir)
    model = models.fit_arm(rows.where("split = 'fit'"), kind, NUMERIC, CATEGORICAL, "label")
    return model.transform(rows)


def _fit_of(scored, kind):
    return scored.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.pow(F.col(kind) - F.col("label"), 2))).alias("rmse"))


@query()
def mdl_gbm_arm_a(spark, sf_dir):
    return _fit_of(_scored(spark, sf_dir, "gbt"), "gbt")


@query()
def mdl_gbm_arm_b(spark, sf_dir):
    return _fit_of(_scored(spark, sf_dir, "forest"), "forest")


@query()
def mdl_ridge(spark, sf_dir):
    return _fit_of(_scored(spark, sf_dir, "ridge"), "ridge")


@query()
def mdl_isotonic(spark, sf_dir):
    scored = _scored(spark, sf_dir, "ridge")
    fixed = models.isotonic_residual(scored.where("split = 'validation'"), "ridge", "label").transform(scored)
    return _fit_of(fixed.withColumn("calibrated", F.col("ridge") + F.col("correction")), "calibrated")


@query()
def mdl_quantile_heads(spark, sf_dir):
    scored = _scored(spark, sf_dir, "forest")
    both = models.with_forest_quantiles(scored.where("split = 'fit'"), scored.where("split = 'test'"), "label").where("q_low IS NOT NULL")
    return both.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("label").between(F.col("q_low"), F.col("q_high")).cast("double")).alias("coverage"))


@query()
def mdl_drivers(spark, sf_dir):
    rows = _sample(spark, sf_dir)
    model = models.fit_arm(rows.where("split = 'fit'"), "ridge", NUMERIC, [], "label")
    found = models.drivers(model, model.transform(rows), "sale_id", NUMERIC)
    return found.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs("contribution")).alias("mean_size"))


def comps_inputs(spark, sf_dir):
    """Every customer as a target of the newest month, every order as a sale; both with the leaves of one boosted arm."""
    c = read(spark, sf_dir, "customer")
    place = {"lon": F.lit(-75.3) + F.col("x_m") / 85_000, "lat": F.lit(39.85) + F.col("y_m") / 110_540}
    rows = _sample(spark, sf_dir).join(c.select(F.col("c_custkey").alias("parcel_id"), F.col("c_mktsegment").alias("style")), "parcel_id")
    model = models.fit_arm(rows.where("split = 'fit'"), "gbt", NUMERIC, CATEGORICAL, "label")
    model.stages[-1].setLeafCol("leaf_vector")
    newest = rows.agg(F.month(F.max("sale_date")).cast("double").alias("m")).first()["m"]
    targets = c.selectExpr(
        "c_custkey AS parcel_id", "c_mktsegment AS style", "CAST(300 + (c_custkey * 37) % 2500 AS DOUBLE) AS area", *_XY, "'3-MEDIUM' AS priority"
    ).withColumn("month", F.lit(newest))
    leaves = vector_to_array(F.col("leaf_vector")).cast("array<int>")
    scored = model.transform(targets).withColumns(place).select("parcel_id", "style", "area", "lon", "lat", leaves.alias("leaves"))
    sold = model.transform(rows).withColumns(place).withColumn("time_adj_log", (F.col("sale_id") % 20) / 100)
    return scored, sold.select("sale_id", "parcel_id", "sale_date", "sale_price", "time_adj_log", "style", "area", "lon", "lat", leaves.alias("leaves"))


@query()
def mdl_comps(spark, sf_dir):
    return comps.find_comps(*comps_inputs(spark, sf_dir))
