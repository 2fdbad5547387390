"""Features of units, parcels and sales: condominiums, distress and tenure, episodes, proximity, street images."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import events as ev
from ..operators import features
from .adapters import EVENTS, SALES, events, read, sales
from .catalog import query, r

S = f"s AS ({SALES})"
E = f"e AS ({EVENTS})"
XY = "CAST((c_custkey * 7919) % 10007 AS DOUBLE) AS x_m, CAST((c_custkey * 104729) % 10009 AS DOUBLE) AS y_m"
RENO = "(lower(kind) LIKE '%alter%' OR lower(kind) = 'major' OR lower(kind) LIKE '%change of use%')"
DAY = "1999-01-01"

# Customers as accounts of the roll: nine in ten are condominium units, of two hundred buildings.
_UNIT = {
    "parcel_id": "concat(CASE WHEN c_custkey % 10 = 0 THEN '77' ELSE '88' END, lpad(CAST(c_custkey AS {text}), 7, '0'))",
    "category": "c_mktsegment",
    "building_code": "CASE WHEN c_custkey % 13 = 0 THEN 'PARKING' ELSE 'RES CONDO 2 STY' END",
    "unit": "CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN concat('#', CAST(c_custkey % 9000 AS {text})) WHEN 2 THEN concat(CAST(c_custkey % 60 AS {text}), 'l') ELSE 'PH' END",
    "unit_area": "CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE CAST(400 + c_custkey % 900 AS DOUBLE) END",
    "lon": "-75.0E0 - (c_custkey % 200) / 1000.0E0",
    "lat": "39.9E0 + (c_custkey % 200) / 1000.0E0",
    "lonlat_status": "CASE WHEN c_custkey % 7 = 0 THEN 'missing' ELSE 'ok' END",
    "street_code": "CASE WHEN c_custkey % 14 = 0 THEN NULL ELSE c_custkey % 200 END",
    "house_number": "(c_custkey % 200) * 2 + 100",
}


def _unit(text: str) -> list[str]:
    return [f"{e.format(text=text)} AS {c}" for c, e in _UNIT.items()]


_BUILDING = """CASE WHEN lonlat_status = 'ok' THEN concat('geo_', CAST(CAST(round(lon * 1e4) AS BIGINT) AS VARCHAR), '_', CAST(CAST(round(lat * 1e4) AS BIGINT) AS VARCHAR))
  WHEN street_code IS NOT NULL THEN concat(CAST(street_code AS VARCHAR), '_', CAST(house_number AS VARCHAR)) END AS building_id"""
_UNITS = f"""roll AS (SELECT {', '.join(_unit('VARCHAR'))} FROM customer), digits AS (SELECT *, {_BUILDING}, TRY_CAST(regexp_extract(unit, '([0-9]{{1,4}})', 1) AS BIGINT) AS d FROM roll
  WHERE parcel_id LIKE '88%' AND category IN ('BUILDING', 'HOUSEHOLD', 'FURNITURE') AND building_code LIKE 'RES CONDO%'),
fl AS (SELECT *, CASE WHEN d >= 100 THEN d // 100 ELSE d END AS f FROM digits), size AS (SELECT building_id, count(*) AS n, sum(unit_area) AS area FROM fl WHERE building_id IS NOT NULL GROUP BY building_id),
units AS (SELECT fl.*, CASE WHEN f BETWEEN 1 AND 70 THEN f END AS floor, n AS building_units, CASE WHEN area > 0 THEN unit_area / area END AS area_share FROM fl LEFT JOIN size USING (building_id))"""


def _units(spark, sf_dir):
    return features.condo_units(read(spark, sf_dir, "customer").selectExpr(*_unit("STRING")), ["BUILDING", "HOUSEHOLD", "FURNITURE"])


@query(f"WITH roll AS (SELECT {', '.join(_unit('VARCHAR'))} FROM customer) SELECT parcel_id, {_BUILDING} FROM roll")
def mkt_building_id(spark, sf_dir):
    roll = read(spark, sf_dir, "customer").selectExpr(*_unit("STRING"))
    return roll.select("parcel_id", features.building_id("lon", "lat", "lonlat_status", "street_code", "house_number").alias("building_id"))


@query(f"WITH {_UNITS} SELECT parcel_id, building_id, floor, building_units, {r('area_share', 'area_share', 6)} FROM units", digits=6)
def mkt_condo_units(spark, sf_dir):
    return _units(spark, sf_dir).select("parcel_id", "building_id", "floor", "building_units", "area_share")


# Sales of units: an order of customer k is a sale of that account; the index moves a price by some per cent.
_CONDO_SALES = "SELECT o_orderkey AS sale_id, concat('88', lpad(CAST(o_custkey AS {0}), 7, '0')) AS parcel_id, CAST(o_orderdate AS DATE) AS sale_date, o_totalprice AS sale_price, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE (o_orderkey % 40) / 100.0E0 END AS time_adj_log FROM orders"


@query(
    f"""WITH {_UNITS}, cs AS ({_CONDO_SALES.format('VARCHAR')}), b AS (SELECT cs.*, building_id FROM cs JOIN units USING (parcel_id) WHERE building_id IS NOT NULL),
j AS (SELECT u.parcel_id, b.parcel_id AS comp_id, sale_id, sale_date, sale_price, sale_price * exp(coalesce(time_adj_log, 0)) AS price_now, row_number() OVER (PARTITION BY u.parcel_id ORDER BY sale_date DESC, sale_id DESC) AS k
  FROM units u JOIN b USING (building_id) WHERE u.parcel_id <> b.parcel_id)
SELECT parcel_id, CAST(k AS INT) AS rank, comp_id, sale_id, sale_date, {r('sale_price', 'sale_price', 2)}, {r('price_now', 'price_now', 2)} FROM j WHERE k <= 8""",
    digits=2,
)
def mkt_condo_building_comps(spark, sf_dir):
    units = _units(spark, sf_dir).select("parcel_id", "building_id")
    sold = read(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS sale_id", "concat('88', lpad(CAST(o_custkey AS STRING), 7, '0')) AS parcel_id", "CAST(o_orderdate AS DATE) AS sale_date", "o_totalprice AS sale_price",
        "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE (o_orderkey % 40) / 100.0E0 END AS time_adj_log",
    )
    return features.building_comps(units, sold.join(units, "parcel_id"))


@query(
    f"""WITH a AS (SELECT o_orderkey AS sale_id, o_custkey % 3 = 0 AS nb, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice / 1e5 END AS s, o_custkey / 1e3 AS g FROM orders)
SELECT sale_id, {r("CAST(nb AS INT) * coalesce(s - g, 0)", "premium")} FROM a"""
)
def mkt_newbuild_premium(spark, sf_dir):
    o = read(spark, sf_dir, "orders").selectExpr("o_orderkey AS sale_id", "CAST(o_custkey % 3 = 0 AS DOUBLE) AS nb", "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice / 1e5 END AS s", "o_custkey / 1e3 AS g")
    return o.select("sale_id", features.newbuild_premium("nb", "s", "g").alias("premium"))


@query(f"WITH {E} SELECT event_id, CASE WHEN least(closed, c2) IS NULL THEN coalesce(closed, c2) ELSE least(closed, c2) END AS completed FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN issued + 30 END AS c2 FROM e)")
def evt_completion_date(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("c2", F.when(F.col("event_id") % 3 == 0, F.date_add("issued", 30)))
    return e.select("event_id", ev.completion_date("closed", "c2").alias("completed"))


@query("SELECT lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS parcel_id, 2027 AS hs_year, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal > 0 END AS is_homestead FROM customer")
def evt_homestead_now(spark, sf_dir):
    roll = read(spark, sf_dir, "customer").selectExpr("c_custkey AS parcel_number", "CASE WHEN c_custkey % 5 = 0 THEN 'n/a' ELSE CAST(c_acctbal AS STRING) END AS homestead_exemption")
    return features.homestead_now(roll, 2027)


@query(
    f"""WITH {S}, {E}, w AS (SELECT sale_id, date_diff('day', issued, sale_date) AS age, severe, kind, event_id FROM s JOIN e USING (parcel_id)),
c AS (SELECT sale_id, count(*) FILTER (age <= 1825) AS n, count(*) FILTER (age <= 1825 AND severe) AS x, min(age) AS d, count(*) FILTER (age <= 1825 AND event_id % 4 = 0) AS g FROM w WHERE age > 0 GROUP BY sale_id),
o AS (SELECT sale_id, count(*) AS n, count(*) FILTER (severe) AS x FROM s JOIN e USING (parcel_id) WHERE issued <= sale_date AND (closed IS NULL OR closed > sale_date) GROUP BY sale_id),
l AS (SELECT s.sale_id, max(e.event_id % 10) AS u FROM s JOIN e USING (parcel_id) WHERE kind = 'Sign' AND issued <= sale_date AND (closed IS NULL OR closed > sale_date) GROUP BY s.sale_id)
SELECT s.sale_id, coalesce(c.n, 0) AS n_complaints, coalesce(c.x, 0) AS n_exterior, c.d AS days_since_complaint, coalesce(o.n, 0) AS n_open_cases, coalesce(o.x, 0) AS n_open_court, l.sale_id IS NOT NULL AS rented, l.u AS rental_units,
  coalesce(c.g, 0) AS n_granted, CAST(NULL AS BOOLEAN) AS is_homestead FROM s LEFT JOIN c USING (sale_id) LEFT JOIN o USING (sale_id) LEFT JOIN l USING (sale_id)"""
)
def evt_distress_tenure(spark, sf_dir):
    return features.distress_tenure(sales(spark, sf_dir), **tenure_tables(spark, sf_dir))


def tenure_tables(spark, sf_dir):
    e = events(spark, sf_dir)
    complaints = e.select("parcel_id", F.col("issued").alias("day"), F.col("severe").alias("exterior"))
    cases = e.select("parcel_id", F.col("issued").alias("opened"), "closed", F.col("severe").alias("court"))
    licenses = e.where("kind = 'Sign'").select("parcel_id", F.col("issued").alias("start"), F.col("closed").alias("stop"), F.lit(False).alias("owner_occupied"), (F.col("event_id") % 10).alias("units"))
    appeals = e.select("parcel_id", F.col("issued").alias("day"), (F.col("event_id") % 4 == 0).alias("granted"))
    return {"complaints": complaints, "investigations": cases, "licenses": licenses, "appeals": appeals}


_ADJ = "CASE WHEN sale_id % 3 = 0 THEN NULL ELSE (sale_id % 20) / 100.0E0 END AS time_adj_log"


@query(
    f"""WITH {S}, {E}, a AS (SELECT *, {_ADJ} FROM s), b AS (SELECT *, lag(sale_date) OVER w AS bought, ln(sale_price) + coalesce(time_adj_log, 0) AS lv, lag(ln(sale_price) + coalesce(time_adj_log, 0)) OVER w AS bv FROM a WINDOW w AS (PARTITION BY parcel_id ORDER BY sale_date, sale_id)),
h AS (SELECT *, date_diff('day', bought, sale_date) AS held, coalesce(date_diff('day', bought, sale_date) BETWEEN 120 AND 1095, false) AS eligible FROM b),
p AS (SELECT sale_id, count(*) AS n, count(*) FILTER ({RENO}) AS reno, count(DISTINCT kind) AS kinds FROM h JOIN e ON h.parcel_id = e.parcel_id AND issued > bought AND issued < sale_date WHERE eligible GROUP BY sale_id),
g AS (SELECT h.sale_id, held, eligible, coalesce(n, 0) AS n_permits, coalesce(reno, 0) > 0 OR coalesce(kinds, 0) >= 2 AS conf, CASE WHEN eligible THEN lv - bv END AS gain FROM h LEFT JOIN p USING (sale_id))
SELECT sale_id, held, eligible, n_permits, {r('gain', 'recovery_log')}, CAST(gain >= ln(1.6) AS INT) AS high_recovery, CASE WHEN gain IS NOT NULL THEN CAST(gain >= ln(1.6) AND conf AS INT) END AS permit_confirmed FROM g"""
)
def evt_episode_labels(spark, sf_dir):
    return features.episode_labels(sales(spark, sf_dir).selectExpr("*", _ADJ), events(spark, sf_dir))


@query(
    f"""WITH {S}, {E}, l AS (SELECT parcel_id, max(sale_date) AS bought FROM s GROUP BY parcel_id), h AS (SELECT *, date_diff('day', bought, DATE '{DAY}') AS held, date_diff('day', bought, DATE '{DAY}') BETWEEN 120 AND 1095 AS eligible FROM l),
p AS (SELECT parcel_id, count(*) AS n, count(*) FILTER ({RENO}) AS reno, count(DISTINCT kind) AS kinds FROM h JOIN e USING (parcel_id) WHERE eligible AND issued > bought AND issued < DATE '{DAY}' GROUP BY parcel_id)
SELECT parcel_id, held, eligible, coalesce(n, 0) AS n_permits, coalesce(reno, 0) AS n_reno, coalesce(kinds, 0) AS n_kinds FROM h LEFT JOIN p USING (parcel_id)"""
)
def evt_episode_current(spark, sf_dir):
    last = sales(spark, sf_dir).groupBy("parcel_id").agg(F.max("sale_date").alias("last_sale_date"))
    return features.episode_current(last, events(spark, sf_dir), DAY)


@query(
    f"""WITH p AS (SELECT c_custkey AS parcel_id, c_mktsegment = 'MACHINERY' AND c_custkey % 3 = 0 AS vacant, {XY} FROM customer)
SELECT a.parcel_id, {r("min(sqrt((a.x_m - b.x_m) ** 2 + (a.y_m - b.y_m) ** 2))", "distance")} FROM p a LEFT JOIN p b ON b.vacant GROUP BY a.parcel_id"""
)
def geo_vacant_distance(spark, sf_dir):
    p = read(spark, sf_dir, "customer").selectExpr("c_custkey AS parcel_id", "c_mktsegment = 'MACHINERY' AND c_custkey % 3 = 0 AS vacant", *_split(XY))
    return features.vacant_distance(p)


def fact_tables(spark, sf_dir):
    """Name -> (table of parcels, key, its columns with their types), as ``join_mart`` takes them."""
    c = read(spark, sf_dir, "customer").withColumn("parcel_id", F.col("c_custkey"))
    return {
        "place": (c.where("c_custkey % 4 <> 0").selectExpr("parcel_id", "c_acctbal AS prox_station", "c_mktsegment AS street_class"), "parcel_id", {"prox_station": "double", "prox_park": "double", "street_class": "string"}),
        "shape": (c.where("c_custkey % 3 = 0").selectExpr("parcel_id", "10.0E0 + c_custkey % 50 AS shp_area", "c_custkey % 9 AS shp_vertices"), "parcel_id", {"shp_area": "double", "shp_vertices": "bigint"}),
        "record": (c.where("c_custkey % 2 = 0").selectExpr("parcel_id", "c_custkey % 10 = 0 AS quality_outlier"), "parcel_id", {"quality_outlier": "boolean", "quality_score": "double"}),
    }


@query(
    f"""SELECT o_orderkey AS sale_id, {r("CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal END", "prox_station")}, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS street_class, CAST(NULL AS DOUBLE) AS prox_park FROM orders JOIN customer ON c_custkey = o_custkey"""
)
def geo_join_proximity(spark, sf_dir):
    out = features.join_mart(sales(spark, sf_dir), *fact_tables(spark, sf_dir)["place"])
    return out.select("sale_id", "prox_station", "street_class", "prox_park")


@query(f"""SELECT o_orderkey AS sale_id, {r("CASE WHEN o_custkey % 3 = 0 THEN 10.0 + o_custkey % 50 END", "shp_area")}, CASE WHEN o_custkey % 3 = 0 THEN o_custkey % 9 END AS shp_vertices FROM orders""")
def chr_shapes_join(spark, sf_dir):
    return features.join_mart(sales(spark, sf_dir), *fact_tables(spark, sf_dir)["shape"]).select("sale_id", "shp_area", "shp_vertices")


@query("""SELECT o_orderkey AS sale_id, CASE WHEN o_custkey % 2 = 0 THEN o_custkey % 10 = 0 END AS quality_outlier, CAST(NULL AS DOUBLE) AS quality_score FROM orders""")
def chr_quality_join(spark, sf_dir):
    return features.join_mart(sales(spark, sf_dir), *fact_tables(spark, sf_dir)["record"]).select("sale_id", "quality_outlier", "quality_score")


# Parcels on both sides of a line, on a plane of 111 km a degree at the equator.
_TRANSECT = {
    "parcel_id": "c_custkey",
    "side": "CASE WHEN c_custkey % 5 = 0 THEN 'core' ELSE 'corridor' END",
    "x_m": "CAST((c_custkey * 7919) % 10007 AS DOUBLE)",
    "y_m": "CAST((c_custkey * 104729) % 10009 AS DOUBLE)",
    "lon": "(c_custkey * 7919) % 10007 / 111194.9E0",
    "lat": "(c_custkey * 104729) % 10009 / 111194.9E0",
    "change": "c_acctbal / 1e4",
    "old_ratio": "c_custkey % 100 / 100.0E0",
    "new_ratio": "c_custkey % 90 / 100.0E0",
    "direction": "CASE c_custkey % 3 WHEN 0 THEN 'corrective' WHEN 1 THEN 'widening' ELSE 'no_clear_change' END",
}
_TRANSECT_COLUMNS = [f"{e} AS {c}" for c, e in _TRANSECT.items()]
_HAV = "2 * 6371008.8 * asin(sqrt(least(1, sin(radians(b.lat - a.lat) / 2) ** 2 + cos(radians(a.lat)) * cos(radians(b.lat)) * sin(radians(b.lon - a.lon) / 2) ** 2)))"


@query(
    f"""WITH t AS (SELECT {', '.join(_TRANSECT_COLUMNS)} FROM customer), d AS (SELECT a.parcel_id, min({_HAV}) AS d FROM t a JOIN t b ON a.side = 'corridor' AND b.side = 'core' GROUP BY a.parcel_id),
b AS (SELECT t.*, CAST(d >= 500 AS INT) + CAST(d >= 1000 AS INT) + CAST(d >= 1500 AS INT) + CAST(d >= 2500 AS INT) AS band FROM t JOIN d USING (parcel_id))
SELECT band, count(*) AS n, {r('median(change)', 'median_change')}, {r('median(old_ratio)', 'old_ratio')}, {r('median(new_ratio)', 'new_ratio')}, {r("avg(CAST(direction = 'corrective' AS INT))", 'corrective')},
{r("avg(CAST(direction = 'widening' AS INT))", 'widening')}, {r("avg(CAST(direction = 'no_clear_change' AS INT))", 'no_clear')} FROM b GROUP BY band"""
)
def geo_boundary_transect(spark, sf_dir):
    return features.boundary_transect(read(spark, sf_dir, "customer").selectExpr(*_TRANSECT_COLUMNS))


# A camera passes each parcel at a few metres to a few tens, looking some way or all round.
_POINTS = "c_custkey AS parcel_id, CASE WHEN c_nationkey < 12 THEN 'east' ELSE 'west' END AS district, -75.0E0 - (c_custkey % 1000) / 1000.0E0 AS lon, 39.9E0 + CAST(floor(c_custkey / 1000) AS BIGINT) / 1000.0E0 AS lat"
_IMAGES = """o_orderkey AS image_id, -75.0E0 - (o_custkey % 1000) / 1000.0E0 + ((o_orderkey % 13) - 6) / 20000.0E0 AS lon, 39.9E0 + CAST(floor(o_custkey / 1000) AS BIGINT) / 1000.0E0 + ((o_orderkey % 11) - 5) / 20000.0E0 AS lat,
CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST((o_orderkey * 37) % 360 AS DOUBLE) END AS heading, o_orderkey % 5 = 0 AS is_pano, 2012 + o_orderkey % 13 AS year"""
_MATCH = f"""p AS (SELECT {_POINTS} FROM customer), i AS (SELECT {_IMAGES} FROM orders), c AS (SELECT p.parcel_id, i.*, (p.lon - i.lon) * 111132.0 * cos(radians(p.lat)) AS dx, (p.lat - i.lat) * 111132.0 AS dy FROM p JOIN i ON abs(p.lat - i.lat) < 0.0005 AND abs(p.lon - i.lon) < 0.001),
d AS (SELECT *, sqrt(dx * dx + dy * dy) AS distance, degrees(atan2(dx, dy)) - heading + 180 AS t FROM c), u AS (SELECT *, row_number() OVER (PARTITION BY parcel_id ORDER BY year DESC, distance, image_id) AS k, count(*) OVER (PARTITION BY parcel_id) AS n FROM d
  WHERE distance BETWEEN 4 AND 45 AND (is_pano OR coalesce(abs(t - 360 * floor(t / 360) - 180) <= 55, false))), m AS (SELECT p.parcel_id, district, coalesce(n, 0) AS n_usable, image_id AS best_image_id, year AS best_year, distance AS best_distance, is_pano AS best_is_pano FROM p LEFT JOIN (SELECT * FROM u WHERE k = 1) USING (parcel_id))"""


def _matched(spark, sf_dir):
    images = read(spark, sf_dir, "orders").selectExpr(*[c.strip() for c in _split(_IMAGES)])
    return features.facade_match(read(spark, sf_dir, "customer").selectExpr(*[c.strip() for c in _split(_POINTS)]), images)


def _split(columns: str) -> list[str]:
    """The columns of a list, cut at commas outside brackets."""
    out, depth = [""], 0
    for c in columns:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


@query(f"WITH {_MATCH} SELECT parcel_id, n_usable, best_image_id, best_year, {r('best_distance', 'best_distance', 3)}, best_is_pano FROM m", digits=3)
def geo_facade_match(spark, sf_dir):
    return _matched(spark, sf_dir).select("parcel_id", "n_usable", "best_image_id", "best_year", "best_distance", "best_is_pano")


@query(
    f"""WITH {_MATCH} SELECT district, count(*) AS n, {r('avg(CAST(n_usable > 0 AS INT))', 'any_usable')}, {r('avg(CAST(coalesce(best_year, 0) >= 2020 AS INT))', 'since_2020')}, {r('avg(CAST(coalesce(best_year, 0) >= 2023 AS INT))', 'since_2023')} FROM m GROUP BY district"""
)
def geo_facade_summary(spark, sf_dir):
    return features.facade_summary(_matched(spark, sf_dir), "district")


@query(
    f"""WITH {S}, a AS (SELECT *, {_ADJ} FROM s), t AS (SELECT abs(exp(coalesce(time_adj_log, 0)) - 1) AS m FROM a WHERE sale_date >= DATE '1998-01-01'),
i AS (SELECT CAST(date_trunc('month', sale_date) AS DATE) AS month, median(ln(sale_price / area)) AS x FROM s GROUP BY 1)
SELECT count(*) AS n, {r('avg(m)', 'mean_adjustment')}, {r('quantile_cont(m, 0.95)', 'p95_adjustment')}, {r("(SELECT exp(max(abs(x))) - 1 FROM i WHERE month >= DATE '1998-01-01')", 'max_drift', 2)} FROM t""",
)
def idx_lookahead_bound(spark, sf_dir):
    s = sales(spark, sf_dir)
    index = s.groupBy(F.trunc("sale_date", "month").alias("month")).agg(F.median(F.ln(F.col("sale_price") / F.col("area"))).alias("log_index"))
    out = features.lookahead_bound(s.selectExpr("*", _ADJ), index, "1998-01-01")
    return out.withColumn("max_drift", F.round("max_drift", 2))
