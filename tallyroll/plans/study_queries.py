"""Small studies, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import digitize
from ..operators import equity, ratio, signals, study
from ..operators import events as ev
from ..sources import lake
from .adapters import EVENTS, SALES, events, read, sales
from .catalog import query, r
from .ratio_queries import CLEAN, FIT, LEVEL, _clean
from .screen_queries import FIN, V, _screen

S = f"s AS ({SALES})"
E = f"e AS ({EVENTS})"
POINTS = "pt AS (SELECT sale_id, parcel_id, ln(sale_price / area) AS log_ppsf, CAST(date_trunc('month', sale_date) AS DATE) AS month, x_m, y_m FROM s WHERE area BETWEEN 300 AND 10000 AND sale_price / area BETWEEN 10 AND 2000)"


@query(f"WITH {S}, {POINTS} SELECT sale_id, {r('log_ppsf', 'log_ppsf')}, CAST(month AS VARCHAR) AS month FROM pt")
def mkt_sale_points(spark, sf_dir):
    return study.sale_points(sales(spark, sf_dir)).select("sale_id", "log_ppsf", F.col("month").cast("string").alias("month"))


@query(f"WITH {S}, {POINTS}, c AS (SELECT month, median(log_ppsf) AS m FROM pt GROUP BY month) SELECT sale_id, {r('log_ppsf - m', 'level')} FROM pt JOIN c USING (month)")
def geo_detrend(spark, sf_dir):
    return study.detrended(study.sale_points(sales(spark, sf_dir))).select("sale_id", "level")


@query(f"WITH {S} SELECT sale_id, {r('ln(sale_price / area) + ln(area)', 'anchor')}, {r('CASE WHEN sale_id % 5 = 0 THEN ln(sale_price / area) - 5 ELSE 0 END', 'premium')} FROM s")
def mkt_price_anchor(spark, sf_dir):
    p = F.ln(F.col("sale_price") / F.col("area"))
    premium = F.when(F.col("sale_id") % 5 == 0, F.coalesce(p - 5, F.lit(0.0))).otherwise(0.0)
    return sales(spark, sf_dir).select("sale_id", (p + F.ln("area")).alias("anchor"), premium.alias("premium"))


@query(f"WITH {S} SELECT parcel_id, count(*) AS n FROM s WHERE sale_date < DATE '1997-01-01' GROUP BY parcel_id HAVING count(*) >= 2")
def mdl_repeat_parcel_index(spark, sf_dir):
    return study.repeat_parcels(sales(spark, sf_dir).where("sale_date < '1997-01-01'"))


@query(f"WITH {S} SELECT sale_id, {r('ln(sale_price) + 0.001 * month(sale_date)', 'target')} FROM s")
def mdl_target(spark, sf_dir):
    return sales(spark, sf_dir).select("sale_id", (F.ln("sale_price") + 0.001 * F.month("sale_date")).alias("target"))


@query(f"WITH {S} SELECT sale_id, {r('0.5 ** (date_diff(' + chr(39) + 'day' + chr(39) + ', sale_date, DATE ' + chr(39) + '2002-01-01' + chr(39) + ') / (365.25 * 3))', 'weight')} FROM s")
def mdl_recency_weight(spark, sf_dir):
    return sales(spark, sf_dir).withColumn("age", signals.days_since("2002-01-01", "sale_date")).select("sale_id", study.recency_half_life("age").alias("weight"))


@query(
    """WITH c AS (SELECT p_type AS t, row_number() OVER (ORDER BY p_type) - 1 AS code FROM (SELECT DISTINCT p_type FROM part WHERE p_size > 5 AND p_type <> 'PROMO'))
SELECT p_partkey AS id, CAST(code AS INT) AS t_code FROM part LEFT JOIN c ON t = p_type"""
)
def mdl_encode(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("t"), "p_size")
    return study.encode_levels(p.where("p_size > 5 and t <> 'PROMO'"), p, "t").select("id", "t_code")


@query(
    f"""WITH p AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice END AS v, p_size FROM part), m AS (SELECT median(v) AS m FROM p WHERE p_size > 5),
f AS (SELECT id, coalesce(v, m) AS x, CAST(v IS NULL AS INT) AS v_missing, p_size FROM p, m), st AS (SELECT avg(x) AS a, stddev_pop(x) AS s FROM f WHERE p_size > 5)
SELECT id, {r("(x - a) / s", "v_z")}, v_missing FROM f, st"""
)
def mdl_covariate_encoder(spark, sf_dir):
    p = read(spark, sf_dir, "part").selectExpr("p_partkey AS id", "CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice END AS v", "p_size")
    return study.standardise(p.where("p_size > 5"), p, ["v"]).select("id", "v_z", "v_missing")


@query(f"WITH {FIN} SELECT assessment_flag, CASE WHEN az > 1.645 THEN 'outside' ELSE 'inside' END AS other, count(*) AS n FROM scr GROUP BY ALL")
def mdl_flag_agreement(spark, sf_dir):
    s = _screen(spark, sf_dir).withColumn("other", F.when(F.col("screen_abs_z") > 1.645, "outside").otherwise("inside"))
    return study.flag_agreement(s, "assessment_flag", "other")


@query(
    f"""WITH {CLEAN} SELECT brand, count(*) AS n, {r("avg(CASE WHEN ln(sale) BETWEEN ln(est) - 0.5 AND ln(est) + 0.7 THEN 1.0 ELSE 0.0 END)", "coverage")}, {r("median((ln(est) + 0.7) - (ln(est) - 0.5))", "median_width")} FROM clean GROUP BY brand HAVING count(*) >= 100"""
)
def mdl_interval_eval(spark, sf_dir):
    df = _clean(spark, sf_dir).withColumns({"lo": F.ln("est") - 0.5, "hi": F.ln("est") + 0.7, "y": F.ln("sale")})
    return study.interval_eval(df, "lo", "hi", "y", "brand", 100)


@query(f"WITH {CLEAN}, {LEVEL} SELECT line, brand, {r('est / m', 'calibrated')} FROM clean JOIN lv USING (brand)")
def mdl_median_calibration(spark, sf_dir):
    rows = _clean(spark, sf_dir)
    level = rows.groupBy("brand").agg(F.median("r").alias("m"))
    return rows.join(level, "brand").select("line", "brand", (F.col("est") / F.col("m")).alias("calibrated"))


@query(
    """WITH a AS (SELECT s_suppkey AS ask_id, CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_suppkey * 7 AS VARCHAR) ELSE concat('#', lpad(CAST(s_suppkey * 3 AS VARCHAR), 9, '0')) END AS ask FROM supplier),
m AS (SELECT ask_id, c_custkey, row_number() OVER (PARTITION BY ask_id ORDER BY c_custkey) AS k FROM a JOIN customer ON CAST(c_custkey AS VARCHAR) = ask OR upper(right(c_name, 10)) = upper(ask)) SELECT ask_id, c_custkey AS parcel_id FROM m WHERE k = 1"""
)
def mdl_resolve_parcel(spark, sf_dir):
    """Each request, an account or an address's end, with the first parcel that it names."""
    asks = read(spark, sf_dir, "supplier").selectExpr("s_suppkey AS ask_id", "CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_suppkey * 7 AS STRING) ELSE concat('#', lpad(CAST(s_suppkey * 3 AS STRING), 9, '0')) END AS ask")
    names = F.explode(F.array(F.col("c_custkey").cast("string"), F.upper(F.right("c_name", F.lit(10)))))
    known_as = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("parcel_id"), names.alias("_name"))
    found = asks.withColumn("_name", F.upper("ask")).join(known_as, "_name")
    return found.groupBy("ask_id").agg(F.min("parcel_id").alias("parcel_id"))


@query("SELECT 'residential' AS family, c_custkey AS parcel_id, c_acctbal AS area, CAST(NULL AS INT) AS floor FROM customer WHERE c_nationkey % 5 > 0 UNION ALL SELECT 'condo', c_custkey, NULL, c_nationkey FROM customer WHERE c_nationkey % 5 = 0")
def scr_union_families(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    a = c.where("c_nationkey % 5 > 0").select(F.lit("residential").alias("family"), F.col("c_custkey").alias("parcel_id"), F.col("c_acctbal").alias("area"))
    b = c.where("c_nationkey % 5 = 0").select(F.lit("condo").alias("family"), F.col("c_custkey").alias("parcel_id"), F.col("c_nationkey").alias("floor"))
    return study.union_families(a, b)


@query(
    f"""WITH {FIN}, o AS (SELECT assessment_flag AS key, count(*) AS value FROM scr GROUP BY ALL), n AS (SELECT assessment_flag AS key, count(*) AS value FROM scr WHERE district <> 3 GROUP BY ALL)
SELECT coalesce(o.key, n.key) AS key, o.value AS old, n.value AS new FROM o FULL JOIN n ON o.key = n.key WHERE o.value IS DISTINCT FROM n.value"""
)
def scr_audit_delta(spark, sf_dir):
    count = lambda s: s.groupBy(F.col("assessment_flag").alias("key")).agg(F.count(F.lit(1)).alias("value"))
    s = _screen(spark, sf_dir)
    return study.audit_delta(count(s), count(s.where("district <> 3")))


@query(f"WITH {FIN}, k AS (SELECT parcel_id, concat_ws('|', district, segment) AS k FROM rows_ WHERE {V} > 0) SELECT b.parcel_id FROM k a JOIN k b USING (k) WHERE a.parcel_id = 12")
def scr_twin_members(spark, sf_dir):
    s = _screen(spark, sf_dir).where("opa_market_value > 0").withColumn("k", F.concat_ws("|", F.col("district").cast("string"), "segment"))
    return s.join(s.where("parcel_id = 12").select("k"), "k", "left_semi").select("parcel_id")


@query(f"WITH {FIN} SELECT parcel_id, assessment_flag, attention, round(CAST(model_median AS DOUBLE) / 7.0e0, 5) + 0.0 AS lon FROM scr WHERE assessment_flag IN ('over', 'under') OR attention IS NOT NULL")
def geo_flagged_overview(spark, sf_dir):
    s = _screen(spark, sf_dir).where("assessment_flag IN ('over', 'under') OR attention IS NOT NULL")
    return s.select("parcel_id", "assessment_flag", "attention", F.round(F.col("model_median") / 7.0, 4).alias("lon"))


@query(f"WITH {CLEAN} SELECT brand, count(*) AS n, {r('median(sale)', 'median', 2)} FROM clean GROUP BY brand HAVING count(*) >= 50")
def eq_neighbourhood_levels(spark, sf_dir):
    return study.levels(_clean(spark, sf_dir), "brand", "sale", 50).withColumn("median", F.round("median", 2))


@query(f"WITH {CLEAN} SELECT flag, {FIT} FROM clean GROUP BY flag HAVING count(*) >= 300")
def eq_by_group(spark, sf_dir):
    return ratio.fit_metrics(_clean(spark, sf_dir), ["flag"]).where("n >= 300")


@query(f"WITH {FIN} SELECT segment, count(display_ratio) AS n, {r('median(display_ratio)', 'median_ratio')}, {r('avg(CASE WHEN display_ratio > 1.1 THEN 1.0 WHEN display_ratio IS NOT NULL THEN 0.0 END)', 'share_over')} FROM scr GROUP BY segment")
def eq_full_roll(spark, sf_dir):
    s = _screen(spark, sf_dir)
    return s.groupBy("segment").agg(F.count("display_ratio").alias("n"), F.median("display_ratio").alias("median_ratio"), F.avg((F.col("display_ratio") > 1.1).cast("double")).alias("share_over"))


@query(
    f"""WITH {S}, p AS (SELECT *, CAST(floor((row_number() OVER (ORDER BY sale_date, sale_id) - 1) * 5 / count(*) OVER ()) AS INT) AS period, area * 150 / sale_price AS q FROM s)
SELECT period, count(*) AS n, {r("median(q)", "median_ratio")}, {r("avg(q) / (sum(area * 150) / sum(sale_price))", "prd")} FROM p GROUP BY period"""
)
def eq_regressivity_cv(spark, sf_dir):
    p = study.periods(sales(spark, sf_dir), "sale_date", "sale_id", 5).withColumns({"e": F.col("area") * 150, "q": F.col("area") * 150 / F.col("sale_price")})
    return p.groupBy("period").agg(F.count(F.lit(1)).alias("n"), F.median("q").alias("median_ratio"), (F.avg("q") / (F.sum("e") / F.sum("sale_price"))).alias("prd"))


@query(f"WITH {CLEAN} SELECT line, {r('1 / (1 + exp((ln(sale) - 10) / 0.8))', 'weight')} FROM clean")
def eq_low_value_router(spark, sf_dir):
    return _clean(spark, sf_dir).select("line", equity.router_weight(F.ln("sale"), 10.0, 0.8).alias("weight"))


@query(f"WITH {CLEAN} SELECT flag, {r('median(r)', 'sale')}, {r('median(r * 0.85)', 'retail')} FROM clean GROUP BY flag")
def eq_group_conventions(spark, sf_dir):
    return _clean(spark, sf_dir).groupBy("flag").agg(F.median("r").alias("sale"), F.median(F.col("r") * 0.85).alias("retail"))


@query(f"WITH {CLEAN}, c AS (SELECT *, unnest(['all', CASE WHEN line % 3 = 0 THEN 'clean' ELSE 'conflict' END]) AS cohort FROM clean) SELECT cohort, {FIT} FROM c GROUP BY cohort")
def eq_quality_segments(spark, sf_dir):
    cohort = F.explode(F.array(F.lit("all"), F.when(F.col("line") % 3 == 0, "clean").otherwise("conflict")))
    return ratio.fit_metrics(_clean(spark, sf_dir).withColumn("cohort", cohort), ["cohort"])


@query(f"WITH {CLEAN}, b AS (SELECT sale >= 10000 AS a, sale >= 30000 AS b, sale >= 60000 AS c, line, flag FROM clean) SELECT CAST(a AS INT) + CAST(b AS INT) + CAST(c AS INT) AS bin, flag, count(*) AS n, {r('avg(CASE WHEN line % 7 = 0 THEN 1.0 ELSE 0.0 END)', 'warning_share')} FROM b GROUP BY ALL")
def eq_warning_by_value(spark, sf_dir):
    rows = _clean(spark, sf_dir).withColumn("bin", digitize("sale", [10_000.0, 30_000.0, 60_000.0]))
    return rows.groupBy("bin", "flag").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("line") % 7 == 0).cast("double")).alias("warning_share"))


@query(f"WITH {CLEAN}, k AS (SELECT sum(est) / sum(sale) AS k FROM clean) SELECT brand, count(*) AS n, {r('sum((est - sale * k) * 0.013998)', 'net', 1)} FROM clean, k GROUP BY brand")
def eq_redistribution_race(spark, sf_dir):
    return study.redistribution_by_group(_clean(spark, sf_dir), "est", "sale", "brand", 0.013998).withColumn("net", F.round("net", 1))


@query(
    f"""WITH {CLEAN}, b AS (SELECT CAST(est >= 15000 AS INT) + CAST(est >= 30000 AS INT) AS bin, flag = 'A' AS g, ln(sale) - ln(est) AS e FROM clean)
SELECT bin, count(*) AS n, {r("(median(e) FILTER (g) - median(e) FILTER (NOT g)) * count(*) / (count(*) + 500)", "gap")} FROM b GROUP BY bin"""
)
def eq_channel_gap(spark, sf_dir):
    df = _clean(spark, sf_dir).withColumns({"g": F.col("flag") == "A", "e": F.ln("sale") - F.ln("est")})
    return study.residual_bands(df, "g", "est", [15_000.0, 30_000.0], "e")


@query(
    f"""WITH {CLEAN} SELECT brand, count(*) AS n, {r("avg(CASE WHEN abs(r - 1) <= 0.1 THEN 1.0 ELSE 0.0 END)", "share_near")}, {r("avg(CASE WHEN abs(r - 1) > 0.1 AND abs(r - 1) <= 0.2 THEN 1.0 ELSE 0.0 END)", "share_beside")},
avg(CASE WHEN abs(r - 1) <= 0.1 THEN 1.0 ELSE 0.0 END) > 2 * avg(CASE WHEN abs(r - 1) > 0.1 AND abs(r - 1) <= 0.2 THEN 1.0 ELSE 0.0 END) AS suspicious FROM clean GROUP BY brand"""
)
def met_sales_chased(spark, sf_dir):
    return study.sales_chased(_clean(spark, sf_dir), ["brand"], 0.1)


@query(f"WITH {E} SELECT event_id, contains(upper(concat_ws(' ', kind, CASE WHEN event_id % 4 = 0 THEN 'change of occupancy' END)), 'CHANGE OF OCCUPANCY') AS hit, CAST(least(closed, issued + 30) AS VARCHAR) AS done FROM e")
def evt_change_occupancy(spark, sf_dir):
    e = events(spark, sf_dir).withColumns({"extra": F.when(F.col("event_id") % 4 == 0, "change of occupancy"), "cert": F.date_add("issued", 30)})
    return e.select("event_id", ev.is_change_of_occupancy("kind", "extra").alias("hit"), ev.completion_date("closed", "cert").cast("string").alias("done"))


@query(f"WITH {E} SELECT parcel_id, count(*) AS n FROM e WHERE kind = 'Change of Use' AND state = 'O' AND issued < DATE '2001-01-01' AND date_diff('day', issued, DATE '2001-01-01') <= 730 GROUP BY parcel_id")
def evt_open_change_permits(spark, sf_dir):
    age = F.datediff(F.lit("2001-01-01").cast("date"), "issued")
    return events(spark, sf_dir).where((F.col("kind") == "Change of Use") & (F.col("state") == "O") & (age > 0) & (age <= 730)).groupBy("parcel_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {S}, {E} SELECT s.sale_id, coalesce(bool_or(issued > sale_date), false) AS after FROM s LEFT JOIN e ON s.parcel_id = e.parcel_id GROUP BY s.sale_id")
def evt_post_sale_permit(spark, sf_dir):
    last = events(spark, sf_dir).groupBy("parcel_id").agg(F.max("issued").alias("last"))
    return sales(spark, sf_dir).join(last, "parcel_id", "left").select("sale_id", F.coalesce(F.col("last") > F.col("sale_date"), F.lit(False)).alias("after"))


@query(f"WITH {S}, {E}, f AS (SELECT sale_id, count(*) AS n FROM s JOIN e ON s.parcel_id = e.parcel_id WHERE issued < sale_date AND lower(kind) LIKE '%use%' GROUP BY sale_id) SELECT s.sale_id, coalesce(n, 0) AS granted FROM s LEFT JOIN f USING (sale_id)")
def evt_appeals_granted(spark, sf_dir):
    return ev.before_anchor(sales(spark, sf_dir), events(spark, sf_dir), "issued", {"granted": F.lower("kind").contains("use")}, days=1_000_000)


@query(f"WITH {S}, {E}, f AS (SELECT sale_id, count(*) AS n, count(*) FILTER (severe) AS p FROM s JOIN e ON s.parcel_id = e.parcel_id WHERE issued < sale_date AND date_diff('day', issued, sale_date) <= 1825 GROUP BY sale_id) SELECT s.sale_id, coalesce(n, 0) AS n_cases, coalesce(p, 0) AS n_court FROM s LEFT JOIN f USING (sale_id)")
def evt_investigations(spark, sf_dir):
    return ev.before_anchor(sales(spark, sf_dir), events(spark, sf_dir), "issued", {"n_cases": None, "n_court": F.col("severe")})


@query("WITH d AS (SELECT o_custkey AS k, CAST(max(o_orderkey) % 2 AS BIGINT) AS actionable FROM orders WHERE o_orderdate > DATE '2001-05-01' GROUP BY ALL) SELECT c_custkey AS parcel_id, coalesce(actionable, 0) AS actionable FROM customer LEFT JOIN d ON k = c_custkey")
def evt_delinquency_join(spark, sf_dir):
    d = read(spark, sf_dir, "orders").where("o_orderdate > '2001-05-01'").groupBy(F.col("o_custkey").alias("parcel_id")).agg((F.max("o_orderkey") % 2).alias("actionable"))
    return study.join_current(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("parcel_id")), d, "parcel_id", ["actionable"])


_ENT = "SELECT o_custkey AS id, count(*) AS accounts, CAST(count(DISTINCT o_orderpriority) AS BIGINT) AS buildings, max(o_totalprice) AS area, CAST(min(o_orderkey) % 2 AS BIGINT) AS units FROM orders GROUP BY ALL"


@query(f"WITH a AS ({_ENT}) SELECT id, {r('area / greatest(accounts, 1)', 'area_per_account')}, {r('accounts / greatest(buildings, 1)', 'accounts_per_building')}, CAST(units <= 0 AND accounts > 1 AS INT) AS unit_conflict FROM a")
def chr_entity_ratios(spark, sf_dir):
    o = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(
        F.count(F.lit(1)).alias("accounts"), F.count_distinct("o_orderpriority").alias("buildings"), F.max("o_totalprice").alias("area"), (F.min("o_orderkey") % 2).alias("units")
    )
    return study.entity_ratios(o).select("id", "area_per_account", "accounts_per_building", "unit_conflict")


@query(
    """WITH a AS (SELECT p_partkey AS id, p_partkey % 9 AS ac, p_retailprice - 905 AS l, CASE WHEN p_partkey % 4 <> 0 THEN 1900 END AS y, p_partkey % 3 AS oc, p_size % 5 AS sg FROM part)
SELECT id, ac > 7 OR l <= 0 AS record_quality_low, ac > 7 OR l <= 0 OR y IS NULL OR oc > 1 OR sg > 2 AS record_quality_warning FROM a"""
)
def chr_record_quality(spark, sf_dir):
    p = read(spark, sf_dir, "part").selectExpr("p_partkey AS id", "CASE WHEN p_partkey % 9 > 7 THEN 1 ELSE 0 END AS area_conflict", "p_retailprice - 905 AS livable", "CASE WHEN p_partkey % 4 <> 0 THEN 1900 END AS year", "CASE WHEN p_partkey % 3 > 1 THEN 1 ELSE 0 END AS open_changes", "p_size % 5 AS story_gap")
    return study.record_quality(p).select("id", "record_quality_low", "record_quality_warning")


@query("SELECT c_custkey AS id, n_name AS code_label FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey % 2 = 0")
def chr_decode_codes(spark, sf_dir):
    codes = read(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("label"))
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("code"))
    return study.decode(c, "code", codes).select("id", "code_label")


@query("SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 5000 GROUP BY ALL")
def src_read_parquet(spark, sf_dir):
    return read(spark, sf_dir, "customer").where("c_acctbal > 5000").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'customers' AS dataset, count(*) AS rows_ FROM customer")
def sink_snapshot(spark, sf_dir):
    base = lake.scratch(spark, "snapshots")
    path = lake.write_snapshot(read(spark, sf_dir, "customer"), base, "city", "customers", "20240101T000000Z")
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows_")).select(F.lit("customers").alias("dataset"), "rows_")
