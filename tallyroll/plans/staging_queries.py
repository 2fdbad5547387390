"""Staging, snapshots and characteristics over customers, orders and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import characteristics as ch
from ..functions.columns import norm_address, norm_unit
from ..operators import staging
from ..sources import lake
from .adapters import read
from .catalog import query, r

RAW_DATE = """CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'garbage' WHEN 2 THEN '0206-04-22T04:56:02Z' ELSE concat({day}, 'T00:00:00Z') END"""
RAW_YEAR = "CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '196Y' WHEN 2 THEN ' 0 ' WHEN 3 THEN '2099' ELSE concat(' ', CAST(1900 + c_custkey % 120 AS {text})) END"


@query(
    f"""WITH a AS (SELECT o_orderkey AS id, {RAW_DATE.format(day="strftime(o_orderdate, '%Y-%m-%d')")} AS raw FROM orders),
b AS (SELECT *, try_strptime(raw, '%Y-%m-%dT%H:%M:%SZ') AS p FROM a)
SELECT id, raw, CASE WHEN raw IS NULL THEN 'missing' WHEN p IS NULL THEN 'invalid' WHEN year(p) NOT BETWEEN 1650 AND 2035 THEN 'implausible' ELSE 'ok' END AS raw_status,
CASE WHEN year(p) BETWEEN 1650 AND 2035 THEN CAST(CAST(p AS DATE) AS VARCHAR) END AS raw_parsed FROM b"""
)
def stg_ts_status(spark, sf_dir):
    raw = RAW_DATE.format(day="date_format(o_orderdate, 'yyyy-MM-dd')")
    rows = read(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", f"{raw} AS raw")
    out = staging.parsed_timestamp(rows, "raw")
    return out.select("id", "raw", "raw_status", F.to_date("raw_parsed").cast("string").alias("raw_parsed"))


@query(
    f"""WITH a AS (SELECT c_custkey AS id, {RAW_YEAR.format(text="VARCHAR")} AS raw FROM customer), b AS (SELECT *, TRY_CAST(trim(raw) AS INT) AS p FROM a)
SELECT id, CASE WHEN raw IS NULL THEN 'missing' WHEN p IS NULL THEN 'invalid' WHEN p NOT BETWEEN 1650 AND 2035 THEN 'implausible' ELSE 'ok' END AS raw_status,
CASE WHEN p BETWEEN 1650 AND 2035 THEN p END AS raw_parsed FROM b"""
)
def stg_year_status(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").selectExpr("c_custkey AS id", f"{RAW_YEAR.format(text='STRING')} AS raw")
    return staging.parsed_year(rows, "raw").select("id", "raw_status", "raw_parsed")


# Points of a few known places as hex EWKB, by nation.
_POINTS = {"0101000020E6100000B81E85EB51B852C09A99999999F94340": (-74.88, 39.95), "0101000020E6100000000000000000F03F000000000000F0BF": (1.0, -1.0), "0101000020E61000000000000000C052C00000000000004440": (-75.0, 40.0)}
_HEX = "CASE c_nationkey % 5 " + " ".join(f"WHEN {i} THEN '{h}'" for i, h in enumerate(_POINTS)) + " WHEN 3 THEN 'zz' END"


@query(
    f"""WITH a AS (SELECT c_custkey AS id, c_nationkey % 5 AS k FROM customer)
SELECT id, {r("CASE k " + " ".join(f"WHEN {i} THEN {p[0]}" for i, p in enumerate(_POINTS.values())) + " END", "lon")},
{r("CASE k " + " ".join(f"WHEN {i} THEN {p[1]}" for i, p in enumerate(_POINTS.values())) + " END", "lat")},
CASE WHEN k = 4 THEN 'missing' WHEN k = 3 THEN 'invalid' ELSE 'ok' END AS lonlat_status FROM a"""
)
def stg_point_lonlat(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").selectExpr("c_custkey AS id", f"{_HEX} AS geom")
    return staging.point_lonlat(rows, "geom").select("id", "lon", "lat", "lonlat_status")


@query("""SELECT c_custkey % 300 AS parcel, c_nationkey AS year, max(c_custkey) AS kept, count(*) AS key_copies FROM customer GROUP BY ALL""")
def stg_assessments(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select((F.col("c_custkey") % 300).alias("parcel"), F.col("c_nationkey").alias("year"), F.col("c_custkey").alias("kept"))
    return staging.latest_per_key(rows, ["parcel", "year"], [F.desc("kept")], "key_copies")


@query(
    """SELECT c_custkey AS id, trim(regexp_replace(upper(concat('  ', c_name, '   Apt ', c_mktsegment)), '\\s+', ' ', 'g')) AS address,
ltrim(regexp_replace(upper(concat('00-', CAST(c_custkey % 70 AS VARCHAR), 'b')), '[^0-9A-Z]', '', 'g'), '0') AS unit FROM customer"""
)
def stg_norm_address(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    address = F.concat(F.lit("  "), "c_name", F.lit("   Apt "), "c_mktsegment")
    unit = F.concat(F.lit("00-"), (F.col("c_custkey") % 70).cast("string"), F.lit("b"))
    return c.select(F.col("c_custkey").alias("id"), norm_address(address).alias("address"), norm_unit(unit).alias("unit"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 9 <> 0 AND c_custkey > 0 THEN lpad(CAST(c_custkey AS VARCHAR), 9, '0') END AS account FROM customer")
def stg_delinquencies(spark, sf_dir):
    c = read(spark, sf_dir, "customer").withColumn("opa_number", F.when(F.col("c_custkey") % 9 != 0, F.col("c_custkey").cast("string")).otherwise("0"))
    return c.select(F.col("c_custkey").alias("id"), staging.account_key("opa_number").alias("account"))


@query(
    """WITH f AS (SELECT o_custkey AS pid, o_orderkey AS objectid, floor(o_totalprice / 100) AS sq FROM orders WHERE floor(o_totalprice / 100) > 50),
m AS (SELECT *, count(*) OVER (PARTITION BY pid) AS footprint_count, row_number() OVER (PARTITION BY pid ORDER BY sq DESC, objectid) AS k FROM f),
j AS (SELECT m.*, CAST(pid % 400 AS VARCHAR) AS parcel_id FROM m WHERE k = 1 AND pid % 11 <> 0), x AS (SELECT *, row_number() OVER (PARTITION BY parcel_id ORDER BY sq DESC, objectid) AS k2 FROM j)
SELECT parcel_id, pid AS pwd_parcel_id, objectid, sq + 0.0 AS footprint_sqft, footprint_count FROM x WHERE k2 = 1"""
)
def stg_footprints(spark, sf_dir):
    o = read(spark, sf_dir, "orders").selectExpr("CAST(o_custkey AS STRING) AS parcel_id_num", "o_orderkey AS objectid", "floor(o_totalprice / 100) AS sq")
    raw = o.select("parcel_id_num", "objectid", F.when(F.col("sq") > 50, F.col("sq")).otherwise(0).alias("square_ft"))
    bridge = read(spark, sf_dir, "customer").selectExpr("c_custkey AS parcelid", "CASE WHEN c_custkey % 11 <> 0 THEN CAST(c_custkey % 400 AS STRING) ELSE ' ' END AS brt_id")
    return staging.footprints(raw, bridge).select("parcel_id", "pwd_parcel_id", "objectid", "footprint_sqft", "footprint_count")


_DOC = "CASE o_orderkey % 5 WHEN 0 THEN 'DEED ' WHEN 1 THEN 'SHERIFF DEED' WHEN 2 THEN 'MORTGAGE' WHEN 3 THEN 'deed land bank' ELSE 'MISCELLANEOUS DEED' END"


@query(
    """SELECT CASE o_orderkey % 5 WHEN 0 THEN 'standard' WHEN 1 THEN 'sheriff' WHEN 3 THEN 'land_bank' ELSE 'miscellaneous' END AS deed_kind, count(*) AS n FROM orders WHERE o_orderkey % 5 <> 2 GROUP BY ALL"""
)
def stg_deeds(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").selectExpr(f"{_DOC} AS document_type").withColumn("deed_kind", staging.deed_kind("document_type"))
    return rows.where("deed_kind is not null").groupBy("deed_kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH roll AS (SELECT concat('88', lpad(CAST(c_custkey AS VARCHAR), 7, '0')) AS acct, concat('MAIN ', CAST(c_custkey % 150 AS VARCHAR)) AS base, CAST(c_custkey % 40 AS VARCHAR) AS unit FROM customer WHERE c_custkey % 40 <> 0),
once AS (SELECT base, unit, min(acct) AS acct FROM roll GROUP BY ALL HAVING count(*) = 1),
r AS (SELECT o_orderkey AS record_id, CASE WHEN o_orderkey % 3 = 0 THEN 'known' END AS acct, concat('MAIN ', CAST(o_custkey % 150 AS VARCHAR)) AS base, CASE WHEN o_custkey % 40 = 0 THEN NULL ELSE CAST(o_custkey % 40 AS VARCHAR) END AS unit FROM orders)
SELECT record_id, coalesce(r.acct, once.acct) AS account, CASE WHEN r.acct IS NOT NULL THEN 'recorded' WHEN once.acct IS NOT NULL THEN 'recovered' ELSE 'none' END AS link_source FROM r LEFT JOIN once USING (base, unit)"""
)
def stg_link_recovery(spark, sf_dir):
    roll = read(spark, sf_dir, "customer").selectExpr("concat('88', lpad(CAST(c_custkey AS STRING), 7, '0')) AS parcel_number", "concat('main  ', CAST(c_custkey % 150 AS STRING)) AS location", "concat('0', CAST(c_custkey % 40 AS STRING)) AS unit")
    rows = read(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS record_id", "CASE WHEN o_orderkey % 3 = 0 THEN 'known' END AS opa_account_num",
        "concat('Main ', CAST(o_custkey % 150 AS STRING), CASE WHEN o_orderkey % 2 = 0 THEN concat(' Apt ', CAST(o_custkey % 40 AS STRING)) ELSE '' END) AS street_address",
        "CASE WHEN o_orderkey % 2 = 1 THEN concat('#', CAST(o_custkey % 40 AS STRING)) END AS unit_num",
    )
    return staging.link_recovery(rows, roll).select("record_id", F.col("opa_account_num").alias("account"), "link_source")


@query(
    f"""WITH t AS (SELECT c_nationkey AS tract, count(*) FILTER (c_nationkey <> 4) AS total, count(*) FILTER (c_mktsegment IN ('BUILDING', 'FURNITURE', 'HOUSEHOLD') AND c_nationkey <> 4) AS a,
  count(*) FILTER (c_mktsegment = 'MACHINERY' AND c_nationkey <> 4) AS b FROM customer GROUP BY ALL)
SELECT tract, {r("CASE WHEN total > 0 THEN a / total END", "a_share")}, {r("CASE WHEN total > 0 THEN b / total END", "b_share")},
CASE WHEN total > 0 THEN CASE WHEN a / total > 0.5 THEN 'a' WHEN b / total > 0.5 THEN 'b' ELSE 'none' END END AS majority FROM t"""
)
def stg_tract_shares(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    live = F.col("c_nationkey") != 4
    t = c.groupBy(F.col("c_nationkey").alias("tract")).agg(
        F.count_if(live).cast("string").alias("total"),
        F.count_if(live & F.col("c_mktsegment").isin("BUILDING", "FURNITURE", "HOUSEHOLD")).alias("a"),
        F.count_if(live & (F.col("c_mktsegment") == "MACHINERY")).alias("b"),
    )
    return staging.tract_shares(t, "total", ["a", "b"]).select("tract", "a_share", "b_share", "majority")


def _snapshots(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    new = c.where(F.col("c_custkey") % 101 != 0).withColumns({
        "c_acctbal": F.when(F.col("c_custkey") % 17 == 0, F.col("c_acctbal") + 100).otherwise(F.col("c_acctbal")),
        "c_mktsegment": F.when(F.col("c_custkey") % 34 == 0, F.lit(None)).otherwise(F.col("c_mktsegment")),
    })
    added = c.where(F.col("c_custkey") % 50 == 0).withColumn("c_custkey", F.col("c_custkey") + 1_000_000)
    return c, new.unionByName(added)


@query(
    f"""WITH n AS (SELECT c_custkey, CASE WHEN c_custkey % 17 = 0 THEN c_acctbal + 100 ELSE c_acctbal END AS bal, CASE WHEN c_custkey % 34 <> 0 THEN c_mktsegment END AS seg FROM customer WHERE c_custkey % 101 <> 0
  UNION ALL SELECT c_custkey + 1000000, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 50 = 0),
j AS (SELECT c.c_custkey AS a, n.c_custkey AS b, c_acctbal AS x, bal AS y, c_mktsegment AS s, seg AS t FROM customer c FULL JOIN n USING (c_custkey)),
t AS (SELECT count(*) FILTER (a IS NULL) AS n_added, count(*) FILTER (b IS NULL) AS n_removed, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL AND (x IS DISTINCT FROM y OR s IS DISTINCT FROM t)) AS n_changed_rows,
  count(*) FILTER (a IS NOT NULL AND b IS NOT NULL AND x IS DISTINCT FROM y) AS cx, median(y - x) FILTER (a IS NOT NULL AND b IS NOT NULL AND x IS DISTINCT FROM y) AS mx,
  count(*) FILTER (a IS NOT NULL AND b IS NOT NULL AND s IS DISTINCT FROM t) AS cs FROM j)
SELECT 'c_acctbal' AS "column", cx AS n_changed, {r("mx", "median_delta")}, n_added, n_removed, n_changed_rows FROM t
UNION ALL SELECT 'c_mktsegment', cs, NULL, n_added, n_removed, n_changed_rows FROM t"""
)
def diff_snapshot(spark, sf_dir):
    return staging.diff_snapshot(*_snapshots(spark, sf_dir), ["c_custkey"], ["c_acctbal", "c_mktsegment"])


@query(
    """WITH n AS (SELECT c_custkey, CASE WHEN c_custkey % 34 <> 0 THEN c_mktsegment END AS seg FROM customer WHERE c_custkey % 101 <> 0)
SELECT c_nationkey AS year, count(*) FILTER (seg IS DISTINCT FROM c_mktsegment) AS n_changed FROM customer JOIN n USING (c_custkey) GROUP BY ALL"""
)
def diff_notes(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    both = old.join(new.select("c_custkey", F.col("c_mktsegment").alias("_new")), "c_custkey")
    return both.groupBy(F.col("c_nationkey").alias("year")).agg(F.count_if(~F.col("c_mktsegment").eqNullSafe(F.col("_new"))).alias("n_changed"))


@query("SELECT c_nationkey, count(*) AS n, max(c_custkey) AS last FROM customer GROUP BY ALL")
def src_latest_snapshot(spark, sf_dir):
    base = lake.scratch(spark, "snapshots")
    c = read(spark, sf_dir, "customer")
    lake.write_snapshot(c.where("c_custkey < 10"), base, "city", "customers", "20240101T000000Z")
    lake.write_snapshot(c, base, "city", "customers", "20240108T000000Z")
    latest = lake.latest_snapshot(spark, base, "city", "customers")
    return latest.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.max("c_custkey").alias("last"))


# Snapshots of orders, one dataset for each priority, stamped with the day of their newest order before a cut.
_CUTS = ("1997-01-01", "1999-06-01")


def order_snapshots(spark, sf_dir):
    """(base, newest stamp): the snapshots written; one of them breaks off before it is finished."""
    base = lake.scratch(spark, "snapshots")
    o = read(spark, sf_dir, "orders").withColumn("dataset", F.lower(F.substring("o_orderpriority", 3, 20)))
    stamp = F.date_format(F.max("o_orderdate"), "yyyyMMdd'T000000Z'")
    for cut in _CUTS:
        for r_ in o.where(F.col("o_orderdate") < cut).groupBy("dataset").agg(stamp.alias("at")).collect():  # a row for each priority
            rows = o.where((F.col("dataset") == r_["dataset"]) & (F.col("o_orderdate") < cut))
            if r_["dataset"] == "low" and cut == _CUTS[1]:
                rows.limit(1).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{base}/raw/source=city/dataset=low/fetched_at={r_['at']}")
            else:
                lake.write_snapshot(rows, base, "city", r_["dataset"], r_["at"])
    return base, o.agg(stamp.alias("at")).first()["at"]


_SNAPSHOTS = "s AS (" + " UNION ALL ".join(f"SELECT '{c}' AS cut, lower(substr(o_orderpriority, 3)) AS dataset, strftime(max(o_orderdate), '%Y%m%dT000000Z') AS fetched_at FROM orders WHERE o_orderdate < '{c}' GROUP BY ALL" for c in _CUTS) + f"), done AS (SELECT * FROM s WHERE NOT (dataset = 'low' AND cut = '{_CUTS[1]}'))"


@query(f"WITH {_SNAPSHOTS} SELECT DISTINCT 'city' AS source, dataset, fetched_at, true AS complete FROM done")
def src_list_snapshots(spark, sf_dir):
    return lake.list_snapshots(spark, order_snapshots(spark, sf_dir)[0])


@query(
    f"""WITH {_SNAPSHOTS}, l AS (SELECT dataset, max(fetched_at) AS fetched_at FROM done GROUP BY dataset), e AS (SELECT DISTINCT lower(substr(o_orderpriority, 3)) AS dataset FROM orders UNION ALL SELECT 'parcels'),
a AS (SELECT e.dataset, fetched_at, date_diff('day', strptime(fetched_at, '%Y%m%dT000000Z'), (SELECT date_trunc('day', max(o_orderdate)) FROM orders)) AS age FROM e LEFT JOIN l USING (dataset))
SELECT dataset, fetched_at, {r("age", "age_days")}, CASE WHEN age IS NULL THEN 'MISSING' WHEN age > 30 THEN 'STALE' ELSE 'ok' END AS status FROM a"""
)
def cat_freshness(spark, sf_dir):
    base, newest = order_snapshots(spark, sf_dir)
    expected = read(spark, sf_dir, "orders").select(F.lower(F.substring("o_orderpriority", 3, 20)).alias("dataset")).distinct()
    return lake.freshness(spark, base, expected.unionByName(spark.createDataFrame([("parcels",)], "dataset string")), newest, 30)


@query("SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) + 0.0 AS total FROM customer GROUP BY ALL")
def sink_derived(spark, sf_dir):
    base = lake.scratch(spark, "lake")
    path = lake.write_derived(read(spark, sf_dir, "customer"), base, "staged", "customers", {"raw_customers": "20240101T000000Z"})
    back = spark.read.parquet(path)
    return back.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@query("SELECT c_custkey AS parcel_id, CAST(round(c_acctbal) AS BIGINT) AS price FROM customer WHERE c_acctbal > 0")
def sink_csv(spark, sf_dir):
    path = f"{lake.scratch(spark, 'csv')}/out"
    rows = read(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("parcel_id"), F.round("c_acctbal").cast("long").alias("price"))
    rows.write.option("header", True).csv(path)
    return spark.read.option("header", True).schema("parcel_id long, price long").csv(path)


@query("SELECT count(*) AS rows_, CAST(round(sum(c_acctbal)) AS BIGINT) AS total FROM customer")
def src_sql_views(spark, sf_dir):
    base = lake.scratch(spark, "lake")
    lake.write_derived(read(spark, sf_dir, "customer"), base, "staged", "customers", {})
    lake.register_views(spark, base)
    return spark.sql("SELECT count(*) AS rows_, CAST(round(sum(c_acctbal)) AS BIGINT) AS total FROM stg_customers")


# Derived tables of the lake: what each holds, what it was built from; it was built on the day of its newest row.
_LAKE = (
    ("staged", "roll", "o_orderkey % 9 = 0 AND o_orderdate < '1996-06-01'", ()),
    ("staged", "sales", "o_orderdate < '1998-01-01'", ()),
    ("mart", "areas", "o_orderdate < '1996-09-01'", ("staged/roll",)),
    ("mart", "features", "o_orderdate < '1997-06-01'", ("staged/sales", "mart/areas")),
    ("mart", "screen", "o_orderdate < '1998-07-01'", ("mart/features", "staged/roll")),
)


def order_lake(spark, sf_dir):
    base = lake.scratch(spark, "lake")
    o = read(spark, sf_dir, "orders")
    for layer, name, rows, inputs in _LAKE:
        part = o.where(rows)
        at = part.agg(F.date_format(F.max("o_orderdate"), "yyyy-MM-dd'T00:00:00Z'").alias("at")).first()["at"]
        lake.write_derived(part, base, layer, name, dict.fromkeys(inputs, ""), built_at=at or "1992-01-01T00:00:00Z")
    return base


_MADE = "t AS (" + " UNION ALL ".join(f"SELECT '{y}' AS layer, '{t}' AS name, count(*) AS n, coalesce(strftime(max(o_orderdate), '%Y-%m-%dT00:00:00Z'), '1992-01-01T00:00:00Z') AS made FROM orders WHERE {w}" for y, t, w, _ in _LAKE) + "), u AS (" + " UNION ALL ".join(f"SELECT '{y}/{t}' AS a, '{i}' AS b" for y, t, _, inputs in _LAKE for i in inputs) + ")"


@query(
    f"""WITH RECURSIVE {_MADE}, p AS (SELECT layer || '/' || name AS k, n, made FROM t), c AS (SELECT a, b, 1 AS depth FROM u UNION SELECT c.a, u.b, depth + 1 FROM c JOIN u ON c.b = u.a),
late AS (SELECT a, b, depth FROM c JOIN p x ON c.a = x.k JOIN p y ON c.b = y.k WHERE y.made > x.made), alle AS (SELECT * FROM late UNION ALL SELECT c.a, late.b, c.depth + late.depth FROM c JOIN late ON c.b = late.a)
SELECT split_part(a, '/', 1) AS layer, split_part(a, '/', 2) AS "table", split_part(b, '/', 1) AS input_layer, split_part(b, '/', 2) AS input_table, CAST(min(depth) AS INT) AS depth, max(x.made) AS built_at, max(y.made) AS input_built_at, max(x.n) AS rows_, max(y.n) AS input_rows
FROM alle JOIN p x ON a = x.k JOIN p y ON b = y.k GROUP BY a, b"""
)
def cat_stale_gate(spark, sf_dir):
    base = order_lake(spark, sf_dir)
    sizes = lake.provenance(spark, base).select("layer", "table", F.col("rows").alias("rows_"))
    own = sizes.withColumnsRenamed({"layer": "input_layer", "table": "input_table", "rows_": "input_rows"})
    return lake.stale(spark, base).join(sizes, ["layer", "table"]).join(own, ["input_layer", "input_table"])


_STYLE = "CASE o_orderkey % 6 WHEN 0 THEN ' ROW TYPICAL' WHEN 1 THEN 'TWIN BUNGALOW' WHEN 2 THEN 'RANCH' WHEN 3 THEN 'DET CONVENTIONAL' WHEN 4 THEN 'LOFT' END"


@query("SELECT CASE o_orderkey % 6 WHEN 0 THEN 'row' WHEN 1 THEN 'twin' WHEN 2 THEN 'detached' WHEN 3 THEN 'detached' WHEN 4 THEN 'other' ELSE 'unknown' END AS style, count(*) AS n FROM orders GROUP BY ALL")
def chr_style(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").selectExpr(f"{_STYLE} AS t")
    return rows.groupBy(ch.style("t").alias("style")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH y AS (SELECT CASE WHEN c_custkey % 10 <> 0 THEN 1880 + c_custkey % 140 END AS y FROM customer)
SELECT CASE WHEN y IS NULL THEN 'unknown' WHEN y < 1900 THEN 'pre1900' WHEN y < 1920 THEN '1900s' WHEN y < 1940 THEN '1920s_30s' WHEN y < 1960 THEN '1940s_50s' WHEN y < 1980 THEN '1960s_70s'
WHEN y < 2000 THEN '1980s_90s' WHEN y < 2010 THEN '2000s' ELSE '2010plus' END AS era, count(*) AS n FROM y GROUP BY ALL"""
)
def chr_era(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").selectExpr("CASE WHEN c_custkey % 10 <> 0 THEN 1880 + c_custkey % 140 END AS y")
    return rows.groupBy(ch.era("y").alias("era")).agg(F.count(F.lit(1)).alias("n"))


_PART = {
    "id": "p_partkey", "height_ft": "CASE WHEN p_partkey % 13 <> 0 THEN CAST(p_size AS DOUBLE) END", "footprint": "CAST(p_partkey % 900 AS DOUBLE)", "stories": "CAST(1 + p_partkey % 5 AS DOUBLE)",
    "livable": "p_retailprice - 850.0E0", "category": "CASE WHEN p_partkey % 2 = 0 THEN 'Multi Family' ELSE p_type END", "beds": "CASE WHEN p_partkey % 3 = 0 THEN 1 END", "baths": "0",
}
_PARTS = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in _PART.items()) + " FROM part"


@query(
    f"""WITH a AS ({_PARTS}), b AS (SELECT *, CASE WHEN height_ft IS NOT NULL THEN least(greatest(round_even(height_ft / 10, 0), 1), 6) END AS fl FROM a), c AS (SELECT *, footprint * fl AS g, stories - fl AS gap FROM b),
d AS (SELECT *, CASE WHEN g > 0 THEN livable / g END AS q FROM c)
SELECT id, {r("fl", "floors")}, {r("g", "gross")}, {r("gap", "story_gap")}, {r("q", "livable_ratio")},
CAST(coalesce(upper(category) = 'MULTI FAMILY' AND coalesce(beds, 0) <= 0 AND coalesce(baths, 0) <= 0 AND stories BETWEEN 2 AND 6 AND fl >= 2 AND abs(gap) <= 1 AND footprint >= 200 AND coalesce(q, 1e300) < 0.4, false) AS INT) + 0.0 AS area_conflict FROM d""".replace("+ 0.0 AS area_conflict", "+ 0.0E0 AS area_conflict")
)
def chr_structure(spark, sf_dir):
    rows = read(spark, sf_dir, "part").selectExpr(*[f"{e} AS {n}" for n, e in _PART.items()])
    return ch.structure(rows).select("id", "floors", "gross", "story_gap", "livable_ratio", "area_conflict")


@query(
    f"""WITH a AS (SELECT o_custkey AS id, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS f FROM orders GROUP BY ALL)
SELECT id, {r("1 - exp(-n / 3.0)", "activity")}, {r("1 - (1 - (1 - exp(-n / 3.0))) * (1 - CAST(f > 4 AS INT) * 0.5)", "transition")} FROM a"""
)
def chr_state_evidence(spark, sf_dir):
    a = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f"))
    a = a.withColumn("many", (F.col("f") > 4).cast("int"))
    return a.select("id", ch.saturating("n", 3.0).alias("activity"), ch.noisy_or(ch.saturating("n", 3.0), ch.presence("many") * 0.5).alias("transition"))
