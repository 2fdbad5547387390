"""Marts, the whole screen and scores; their SQL joins the SQL of the parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import crossfit, folds, intervals, marts, models, ranks, risk, scoring
from ..operators import ratio_studies as rs
from ..sources import lake
from .adapters import SALES, events, read, sales
from .catalog import SQL, query, r
from .crossfit_queries import EPISODE_INPUTS, episodes
from .feature_queries import _ADJ, _CONDO_SALES, _UNITS, _split, _units, fact_tables
from .model_queries import CATEGORICAL, NUMERIC, _sample
from .ratio_study_queries import FEATURES, PLACES, D, _ols
from .ratio_study_queries import _sales as _study_sales
from .screen_queries import FIN, SCREEN_COLUMNS
from .signal_queries import _reach

DAY = "1999-01-01"


def _part(name: str, tag: str) -> str:
    return f"LEFT JOIN ({SQL[name]}) {tag} USING ({{key}})"


_SALE_PARTS = {
    "blk": ("mkt_block_roll", ("block_price", "block_ppsf", "block_n")),
    "own": ("mkt_parcel_prior", ("prior_n", "prior_days", "prior_price")),
    "asmt": ("mkt_join_assessment_year", ("value_now", "value_before", "value_change")),
    "permit": ("evt_permits", ("n_all", "n_reno", "since_any")),
    "case_": ("evt_violations", ("n_open", "n_open_severe")),
    "episode": ("evt_episode_labels", ("held", "eligible", "n_permits", "recovery_log", "high_recovery", "permit_confirmed")),
    "tenure": ("evt_distress_tenure", ("n_complaints", "n_exterior", "days_since_complaint", "n_open_cases", "n_open_court", "rented", "rental_units", "n_granted", "is_homestead")),
    "place": ("geo_join_proximity", ("prox_station", "prox_park", "street_class")),
    "shape": ("chr_shapes_join", ("shp_area", "shp_vertices")),
    "record": ("chr_quality_join", ("quality_outlier", "quality_score")),
}
_SHOWN = ", ".join(f"{t}.{c} AS {t.rstrip('_')}_{c}" for t, (_, cs) in _SALE_PARTS.items() for c in cs)
_NEAR = "near.knn_value AS near_knn_value, near.knn_n AS near_knn_n, near.knn_distance AS near_knn_distance"


@query(
    f"""SELECT s.sale_id, s.parcel_id, s.sale_date, {r('s.sale_price', 'sale_price', 2)}, {_SHOWN}, {_NEAR} FROM ({SALES}) s {' '.join(_part(n, t).format(key='sale_id') for t, (n, _) in _SALE_PARTS.items())}
LEFT JOIN ({SQL['mkt_knn_asof']}) near ON near.target_id = s.sale_id"""
)
def asm_sale_features(spark, sf_dir):
    values = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("parcel_id"), F.year("o_orderdate").alias("year")).agg(F.max("o_totalprice").alias("value"))
    facts = {name: (table, columns) for name, (table, _, columns) in fact_tables(spark, sf_dir).items()}
    issued, severe = F.col("issued"), F.col("severe")
    tenure = {
        "complaints": {"day": issued, "exterior": severe},
        "investigations": {"opened": issued, "closed": F.col("closed"), "court": severe},
        "licenses": {"is_one": F.col("kind") == "Sign", "start": issued, "stop": F.col("closed"), "units": F.col("event_id") % 10},
        "appeals": {"day": issued, "granted": F.col("event_id") % 4 == 0},
    }
    out = marts.sale_features(sales(spark, sf_dir).selectExpr("*", _ADJ), events(spark, sf_dir), values, _reach(spark, sf_dir) / 2, tenure=tenure, facts=facts)
    return out.withColumns({"sale_price": F.round("sale_price", 2), "blk_block_price": F.round("blk_block_price", 2)})


_PARCEL_PARTS = {
    "blk": ("mkt_block_roll_at_date", ("block_price", "block_n")),
    "own": ("mkt_parcel_prior_at_date", ("prior_n", "prior_days", "prior_price")),
    "vacant": ("geo_vacant_distance", ("distance",)),
}
_EPISODE_AT = SQL["evt_episode_current"].replace("max(sale_date) AS bought FROM s GROUP BY", f"max(sale_date) AS bought FROM s WHERE sale_date < DATE '{DAY}' GROUP BY")
_EPISODE_COLUMNS = ("held", "eligible", "n_permits", "n_reno", "n_kinds")


@query(
    f"""SELECT c_custkey AS parcel_id, {', '.join(f'{t}.{c} AS {t}_{c}' for t, (_, cs) in _PARCEL_PARTS.items() for c in cs)}, {_NEAR}, {', '.join(f'ep.{c} AS episode_{c}' for c in _EPISODE_COLUMNS)} FROM customer
{' '.join(f"LEFT JOIN ({SQL[n]}) {t} ON {t}.parcel_id = c_custkey" for t, (n, _) in _PARCEL_PARTS.items())} LEFT JOIN ({SQL['mkt_knn_at_date']}) near ON near.target_id = c_custkey LEFT JOIN ({_EPISODE_AT}) ep ON ep.parcel_id = c_custkey"""
)
def asm_assessment_features(spark, sf_dir):
    parcels = read(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS parcel_id", "floor(c_custkey / 8) AS block", "c_mktsegment = 'MACHINERY' AND c_custkey % 3 = 0 AS vacant",
        "CAST((c_custkey * 7919) % 10007 AS DOUBLE) AS x_m", "CAST((c_custkey * 104729) % 10009 AS DOUBLE) AS y_m",
    )
    out = marts.assessment_features(parcels, sales(spark, sf_dir), events(spark, sf_dir), DAY, _reach(spark, sf_dir) / 2)
    return out.withColumn("blk_block_price", F.round("blk_block_price", 2))


_W = "(1.0 / (1.0 + exp({0} / 365.25 - 3.0)))"
_UNIT_FACTS = "building_id, floor, building_units"


@query(
    f"""WITH {_UNITS}, cs AS ({_CONDO_SALES.format('VARCHAR')}), b AS (SELECT cs.*, building_id, floor, building_units, area_share, unit_area FROM cs JOIN units USING (parcel_id)),
n AS (SELECT a.sale_id, date_diff('day', p.sale_date, a.sale_date) AS age, p.sale_price AS price, CASE WHEN p.unit_area BETWEEN 150 AND 6000 THEN p.sale_price / p.unit_area END AS ppsf
  FROM b a JOIN b p ON a.building_id = p.building_id AND a.parcel_id <> p.parcel_id AND p.sale_date < a.sale_date AND date_diff('day', p.sale_date, a.sale_date) <= 1825),
m AS (SELECT sale_id, sum({_W.format('age')} * price) / sum({_W.format('age')}) AS p, sum({_W.format('age')} * ppsf) / sum({_W.format('age')}) FILTER (ppsf IS NOT NULL) AS q, count(*) AS n FROM n GROUP BY sale_id),
o AS (SELECT a.sale_id, count(p.sale_id) AS n, any_value(date_diff('day', p2.d, a.sale_date)) AS days FROM b a LEFT JOIN b p ON a.parcel_id = p.parcel_id AND p.sale_date < a.sale_date
  LEFT JOIN LATERAL (SELECT max(sale_date) AS d FROM b z WHERE z.parcel_id = a.parcel_id AND z.sale_date < a.sale_date) p2 ON true GROUP BY a.sale_id)
SELECT b.sale_id, b.parcel_id, b.sale_date, {_UNIT_FACTS}, {r('area_share', 'area_share')}, {r('m.p', 'bldg_roll_price', 2)}, {r('m.q', 'bldg_roll_ppsf')}, coalesce(m.n, 0) AS bldg_roll_n, o.n AS own_prior_n, o.days AS own_prior_days
FROM b LEFT JOIN m USING (sale_id) LEFT JOIN o USING (sale_id)"""
)
def asm_condo_sale_features(spark, sf_dir):
    out = marts.condo_sale_features(_units(spark, sf_dir), _condo_sales(spark, sf_dir))
    out = out.withColumns({"bldg_roll_price": F.round("bldg_roll_price", 2), "bldg_roll_n": F.coalesce("bldg_roll_n", F.lit(0))})
    return out.drop("sale_price", "own_prior_price")


def _condo_sales(spark, sf_dir):
    return read(spark, sf_dir, "orders").selectExpr(*[c.strip() for c in _split(_CONDO_SALES.format("STRING").removeprefix("SELECT ").removesuffix(" FROM orders"))])


@query(
    f"""WITH {_UNITS}, cs AS ({_CONDO_SALES.format('VARCHAR')}), b AS (SELECT cs.*, building_id, date_diff('day', sale_date, DATE '{DAY}') AS age FROM cs JOIN units USING (parcel_id) WHERE sale_date < DATE '{DAY}'),
m AS (SELECT u.parcel_id, sum({_W.format('age')} * sale_price) / sum({_W.format('age')}) AS p, count(b.sale_id) AS n FROM units u LEFT JOIN b ON u.building_id = b.building_id AND b.parcel_id <> u.parcel_id AND age <= 1825 GROUP BY u.parcel_id),
o AS (SELECT parcel_id, count(*) AS n, min(age) AS d FROM b GROUP BY parcel_id)
SELECT parcel_id, {_UNIT_FACTS}, {r('area_share', 'area_share')}, {r('m.p', 'bldg_price', 2)}, m.n AS bldg_n, o.n AS own_prior_n, o.d AS own_prior_days FROM units LEFT JOIN m USING (parcel_id) LEFT JOIN o USING (parcel_id)"""
)
def asm_condo_assessment_features(spark, sf_dir):
    out = marts.condo_assessment_features(_units(spark, sf_dir), _condo_sales(spark, sf_dir), DAY)
    return out.withColumns({"bldg_price": F.round("bldg_price", 2), "bldg_n": F.greatest(F.col("bldg_n"), F.lit(0))}).drop("own_prior_price")


def _rows(spark, sf_dir):
    return read(spark, sf_dir, "customer").selectExpr(*[f"{e} AS {n}" for n, e in SCREEN_COLUMNS.items()], "c_custkey % 9 AS twin_key")


_TWINS = "twin_n, opa_vs_twin_median"
_BUILT = f"""fin AS ({SQL['scr_finalize']}), k AS (SELECT parcel_id, opa_market_value AS v, concat_ws('|', district, segment, parcel_id % 9) AS k FROM ({'SELECT ' + ', '.join(f'{e} AS {n}' for n, e in SCREEN_COLUMNS.items()) + ' FROM customer'}) WHERE opa_market_value > 0),
tw AS (SELECT parcel_id, n AS twin_n, {r('v / m', 'opa_vs_twin_median')} FROM k JOIN (SELECT k, count(*) AS n, median(v) AS m FROM k GROUP BY k HAVING count(*) >= 5) USING (k)), eqc AS ({SQL['scr_equity_context']}),
built AS (SELECT fin.*, twin_n, opa_vs_twin_median, n_peers, peer_median, share_below, verdict FROM fin LEFT JOIN tw USING (parcel_id) LEFT JOIN eqc USING (parcel_id))"""
_BUILT_COLUMNS = ("parcel_id", "assessment_flag", "attention", "new_build", "display_median", "display_pi_low_90", "display_pi_high_90", "screen_z", "display_ratio", "twin_n", "opa_vs_twin_median", "n_peers", "peer_median", "share_below", "verdict")


def _built(spark, sf_dir):
    return marts.build_screen(_rows(spark, sf_dir), "district", ["district", "segment", "twin_key"])


@query(f"WITH {_BUILT} SELECT * FROM built")
def scr_build(spark, sf_dir):
    return _built(spark, sf_dir).select(*_BUILT_COLUMNS)


_REASONS = """array_to_string(list_filter([CASE WHEN coalesce(char_livable_area, 0) <= 0 THEN 'no_livable_area' END, CASE WHEN coalesce(record_quality_low, false) THEN 'record_conflict' END,
CASE WHEN NOT coalesce(opa_market_value > 0, false) THEN 'no_published_value' END, CASE WHEN pred_point_calibrated IS NULL THEN 'no_point_estimate' END, CASE WHEN hi / lo > 3 THEN 'wide_band' END, CASE WHEN new_build THEN 'new_building' END], lambda x: x IS NOT NULL), ',')"""


@query(f"WITH {FIN} SELECT parcel_id, assessment_flag, {r('display_median', 'display_median')}, {_REASONS} AS reasons FROM scr")
def scr_property_core(spark, sf_dir):
    from ..operators.screen import finalize

    core = marts.property_core(finalize(_rows(spark, sf_dir)))
    return core.select("parcel_id", "assessment_flag", "display_median", F.array_join("quality_reasons", ",").alias("reasons"))


@query(
    f"""WITH {_BUILT}, s AS ({SALES}), l AS (SELECT parcel_id, count(*) AS n, max(sale_date) AS d FROM (SELECT *, row_number() OVER (PARTITION BY parcel_id ORDER BY sale_date DESC, sale_id DESC) AS k FROM s) WHERE k <= 10 GROUP BY parcel_id)
SELECT parcel_id, assessment_flag, twin_n, n_peers, verdict, coalesce(l.n, 0) AS n_sales, l.d AS last_sale FROM built LEFT JOIN l USING (parcel_id)"""
)
def scr_property_packet(spark, sf_dir):
    p = marts.property_packet(_built(spark, sf_dir), sales(spark, sf_dir))
    n = F.coalesce(F.size("sales"), F.lit(0))
    return p.select("parcel_id", "screen.assessment_flag", "twins.twin_n", "peers.n_peers", "peers.verdict", F.when(F.col("sales").isNull(), 0).otherwise(n).cast("long").alias("n_sales"), F.get("sales", F.lit(0))["sale_date"].alias("last_sale"))


_ARMS = "ln(model) AS a, ln(assessed) AS b"
_FIT = f"""{D.replace('d AS', 'd0 AS', 1)}, ua AS (SELECT *, 1 AS k, period < 4 AS learns FROM d0), {_ols('ua', 'k', [*FEATURES, *PLACES], 'a')}, {_ols('ua', 'k', FEATURES, 'b')},
d AS (SELECT d0.*, fita.predicted AS pa, fitb.predicted AS pb FROM d0 JOIN fita USING (sale_id) JOIN fitb USING (sale_id))"""
_STACK = f"""{_FIT}, w0 AS (SELECT least(1, greatest(0, coalesce(sum((pa - pb) * (log_price - pb)) / nullif(sum((pa - pb) ** 2), 0), 0.5))) AS w FROM d WHERE period = 4), v AS (SELECT w * pa + (1 - w) * pb AS p, log_price AS y FROM d, w0 WHERE period = 4),
q AS (SELECT quantile_cont(p, [0.2, 0.4, 0.6, 0.8]) AS e FROM v), k0 AS (SELECT segment, median(p) AS center, median(y - p) AS c FROM (SELECT len(list_filter(e, lambda z: z <= p)) AS segment, p, y FROM v, q) GROUP BY segment), k AS (SELECT center, max(center + c) OVER (ORDER BY segment) - center AS correction FROM k0)"""


@query(
    f"""WITH {_STACK}, t AS (SELECT sale_id, w * pa + (1 - w) * pb AS p, coalesce(time_adj_log, 0) AS adj FROM d, w0 WHERE period > 4),
j AS (SELECT sale_id, p, adj, arg_max(center, center) FILTER (center < p) AS a, arg_max(correction, center) FILTER (center < p) AS ca, arg_min(center, center) FILTER (center >= p) AS b, arg_min(correction, center) FILTER (center >= p) AS cb FROM t, k GROUP BY ALL)
SELECT sale_id, {r("exp(p + CASE WHEN a IS NULL THEN cb WHEN b IS NULL THEN ca ELSE ca + (cb - ca) * (p - a) / (b - a) END - adj)", "score", 2)} FROM j""",
    digits=2,
)
def mdl_point_score(spark, sf_dir):
    """Two arms fitted to the first periods, blended and calibrated on the next, scoring the later ones."""
    arms = {"a": [*FEATURES, *PLACES], "b": FEATURES}
    told = folds.arms_by_features(_study_sales(spark, sf_dir), arms, "period < 4", "period >= 4")
    names = ["sale_id", "period", "log_price", "time_adj_log"]
    d = told.groupBy(*names).agg(*[F.max(F.when(F.col("arm") == x, F.col("predicted"))).alias(x) for x in arms])
    w = intervals.stack_weight(d.where("period = 4"), "a", "b", "log_price", []).first()["weight"]
    validation = d.where("period = 4").withColumn("p", w * F.col("a") + (1 - w) * F.col("b"))
    knots = rs.segment_knots(validation, "p", "log_price")
    return scoring.point_score(d.where("period > 4"), "a", "b", w, knots, "time_adj_log").select("sale_id", "score")


_SIGMA = {
    "sale_id": "o_orderkey", "knn_distance": "CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(o_orderkey % 900 AS DOUBLE) END", "roll_price": "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END",
    "style": "CASE o_orderkey % 5 WHEN 0 THEN 'twin' WHEN 1 THEN 'detached' WHEN 2 THEN NULL WHEN 3 THEN 'other' ELSE 'row' END", "new_build": "o_orderkey % 2", "newbuild_n": "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey % 6 END",
    "days_since_reno": "CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 2500 END", "area_conflict": "CASE WHEN o_orderkey % 8 = 0 THEN 1 END", "characteristic_outlier": "CASE WHEN o_orderkey % 9 = 0 THEN 1 ELSE 0 END",
}
_SIGMA_COLUMNS = [f"{e} AS {c}" for c, e in _SIGMA.items()]


@query(
    f"""WITH x AS (SELECT {', '.join(_SIGMA_COLUMNS)} FROM orders), y AS (SELECT *, coalesce(knn_distance, 500) AS d FROM x)
SELECT sale_id, {r('CAST(roll_price IS NULL AS INT) * least(1, d / 300)', 's_missing')}, {r('CAST(d >= 100 AND d < 300 AS INT)', 's_near')}, {r('CAST(d >= 300 AND d < 600 AS INT)', 's_far')}, {r('CAST(d >= 600 AS INT)', 's_remote')},
{r("CAST(coalesce(style, '') = 'twin' AS INT)", 's_twin')}, {r("CAST(coalesce(style, '') = 'detached' AS INT)", 's_detached')}, {r("CAST(coalesce(style, 'unknown') IN ('other', 'unknown') AS INT)", 's_other')},
{r('CAST(new_build > 0 AND coalesce(newbuild_n, 0) < 3 AS INT)', 's_thin_new')}, {r('CAST(coalesce(days_since_reno <= 3 * 365.25, false) AS INT)', 's_recent_reno')}, {r('coalesce(area_conflict, 0)', 's_area_conflict')}, {r('coalesce(characteristic_outlier, 0)', 's_outlier')} FROM y"""
)
def mdl_sigma_design(spark, sf_dir):
    out = scoring.sigma_design(read(spark, sf_dir, "orders").selectExpr(*_SIGMA_COLUMNS))
    return out.select("sale_id", *[c for c in out.columns if c.startswith("s_")])


_CAL = "o_orderkey AS cal_id, CAST((o_custkey * 7919) % 10007 AS DOUBLE) AS x_m, CAST((o_custkey * 104729) % 10009 AS DOUBLE) AS y_m, (o_orderkey * 37 % 1009) / 1009.0E0 - 0.5E0 AS residual"


@query(
    f"""WITH t AS (SELECT c_custkey AS target_id, CASE WHEN c_custkey % 10 <> 0 THEN CAST((c_custkey * 7919) % 10007 AS DOUBLE) + 3 END AS x, CAST((c_custkey * 104729) % 10009 AS DOUBLE) AS y FROM customer), c AS (SELECT {_CAL} FROM orders),
m AS (SELECT target_id, list_max(min((x - x_m) ** 2 + (y - y_m) ** 2, CAST(least(500, (SELECT count(*) FROM c)) AS BIGINT))) AS far FROM t, c WHERE x IS NOT NULL GROUP BY target_id), k AS (SELECT target_id, residual AS v, sqrt((x - x_m) ** 2 + (y - y_m) ** 2) AS d, row_number() OVER (PARTITION BY target_id ORDER BY (x - x_m) ** 2 + (y - y_m) ** 2, cal_id) AS n FROM t JOIN m USING (target_id), c WHERE (x - x_m) ** 2 + (y - y_m) ** 2 <= far),
w AS (SELECT target_id, v, sum(1 / (d + 250)) OVER (PARTITION BY target_id) AS s, sum(1 / (d + 250)) OVER (PARTITION BY target_id ORDER BY v, d ROWS UNBOUNDED PRECEDING) AS u, sum(1 / (d + 250)) OVER (PARTITION BY target_id ORDER BY v DESC, d ROWS UNBOUNDED PRECEDING) AS e FROM k WHERE n <= 500),
lv AS (SELECT least(1, 0.95 * (k + 1) / k) - 1e-12 AS l FROM (SELECT least(500, count(*)) AS k FROM c)), o AS (SELECT target_id, coalesce(max(v) FILTER (e / s >= l), min(v)) AS lo, coalesce(min(v) FILTER (u / s >= l), max(v)) AS hi FROM w, lv GROUP BY target_id)
SELECT target_id, {r('coalesce(lo, (SELECT quantile_cont(residual, 0.05) FROM c))', 'lo')}, {r('coalesce(hi, (SELECT quantile_cont(residual, 0.95) FROM c))', 'hi')} FROM t LEFT JOIN o USING (target_id)"""
)
def mdl_conformal_knn(spark, sf_dir):
    t = read(spark, sf_dir, "customer").selectExpr("c_custkey AS target_id", "CASE WHEN c_custkey % 10 <> 0 THEN CAST((c_custkey * 7919) % 10007 AS DOUBLE) + 3 END AS x_m", "CAST((c_custkey * 104729) % 10009 AS DOUBLE) AS y_m")
    cal = read(spark, sf_dir, "orders").selectExpr(*_split(_CAL))
    return scoring.conformal_knn(t, cal)


@query(
    f"""WITH {D}, k AS (SELECT *, row_number() OVER (ORDER BY sale_date, sale_id) - 1 AS k, count(*) OVER () AS n, {_ARMS} FROM d), w AS (SELECT least(1, greatest(0, sum((a - b) * (log_price - b)) / sum((a - b) ** 2))) AS w FROM k WHERE k < n // 2)
SELECT count(*) AS n, {r('max(w)', 'weight')}, {r('sqrt(avg((a - log_price) ** 2))', 'rmse_a')}, {r('sqrt(avg((b - log_price) ** 2))', 'rmse_b')}, {r('sqrt(avg((w * a + (1 - w) * b - log_price) ** 2))', 'rmse_blend')} FROM k, w WHERE k >= n // 2"""
)
def mdl_ensemble_check(spark, sf_dir):
    d = _study_sales(spark, sf_dir).selectExpr("sale_id", "sale_date", "log_price", *_split(_ARMS))
    return scoring.ensemble_check(d, "a", "b", "log_price", "sale_date", "sale_id")


_FEATURES = ("livable_area", "beds", "fireplaces", "view", "year_built")
_DRIVERS = " UNION ALL ".join(f"SELECT c_custkey AS parcel_id, '{f}' AS feature, {v} AS value, (c_custkey * {7 + i}) % 1001 - 500.0E0 AS effect FROM customer" for i, (f, v) in enumerate(zip(_FEATURES, ("c_custkey * 31 % 20000 + 0.0E0", "c_custkey % 15 + 0.0E0", "c_custkey % 3 + 0.0E0", "1.0E0", "1800 + c_custkey % 240 + 0.0E0"))))


@query(
    f"""WITH x AS ({_DRIVERS}), y AS (SELECT *, CASE feature WHEN 'livable_area' THEN value NOT BETWEEN 500 AND 15000 WHEN 'beds' THEN value NOT BETWEEN 1 AND 12 WHEN 'year_built' THEN value NOT BETWEEN 1820 AND 2026 ELSE false END AS implausible FROM x WHERE feature <> 'view')
SELECT parcel_id, CAST(row_number() OVER (PARTITION BY parcel_id ORDER BY implausible DESC, abs(effect) DESC, feature) AS INT) AS rank, feature, {r('value', 'value')}, {r('effect', 'effect')}, implausible FROM y"""
)
def mdl_appeal_points(spark, sf_dir):
    read(spark, sf_dir, "customer").createOrReplaceTempView("_appeal_customer")
    return scoring.appeal_points(spark.sql(_DRIVERS.replace("FROM customer", "FROM _appeal_customer")))


@query(f"SELECT o_orderkey AS sale_id, {r('CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 100 / 100.0 ELSE o_custkey % 10 / 10.0 END', 'probability')} FROM orders")
def mdl_transition_reuse(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    stored = o.where("o_orderkey % 3 = 0").selectExpr("o_orderkey AS sale_id", "o_orderkey % 100 / 100.0E0 AS probability")
    return scoring.reuse_probability(o.selectExpr("o_orderkey AS sale_id", "o_custkey % 10 / 10.0E0 AS now"), stored, "now").select("sale_id", "probability")


@query()
def mdl_transition_rescore(spark, sf_dir):
    """Sales of an earlier run keep the score that no model of their own time gave; the others get the full model's, null where too few are labelled to fit one."""
    rows = episodes(spark, sf_dir)
    before = rows.where("sale_date < DATE '1997-01-01'")
    stored = lake.kept(crossfit.crossfit_transition(before, EPISODE_INPUTS)[0].where("probability IS NOT NULL").select("sale_id", "probability"), "transition-stored")
    labelled = ranks.running(before.where("label IS NOT NULL"), [], ["sale_date", "sale_id"], "_nth")
    model = crossfit.fit_transition(labelled, EPISODE_INPUTS)
    now = model.score(rows) if model else rows.withColumn("probability", F.lit(None).cast("double"))
    return scoring.reuse_probability(now.withColumnRenamed("probability", "now"), stored, "now").select("sale_id", "probability")


@query()
def mdl_rbf_basis(spark, sf_dir):
    p = sales(spark, sf_dir)
    centres, bandwidth = scoring.rbf_centres(p)
    return scoring.rbf_basis(p, centres, bandwidth).select("sale_id", F.posexplode("basis").alias("centre", "value"))


@query()
def mdl_importance(spark, sf_dir):
    rows = _sample(spark, sf_dir)
    model = models.fit_arm(rows.where("split = 'fit'"), "gbt", NUMERIC, CATEGORICAL, "label")
    return scoring.importance(spark, model, [*NUMERIC, *CATEGORICAL])


def condo_scores(spark, sf_dir):
    """Validation and test sales of units under both arms, their blend and its band."""
    units = _units(spark, sf_dir).select("parcel_id", F.col("floor").cast("double").alias("floor"), F.col("building_units").cast("double").alias("building_units"), "area_share", "unit_area")
    rows = _condo_sales(spark, sf_dir).join(units, "parcel_id").withColumn("label", F.ln("sale_price"))
    rows = intervals.time_split(rows, "sale_date", "sale_id", 0.15, 0.15)
    fit, names = rows.where("split = 'fit'"), ["floor", "building_units", "area_share", "unit_area"]
    arms = [models.fit_arm(fit, kind, names, [], "label") for kind in ("gbt", "forest")]
    scored = arms[1].transform(arms[0].transform(rows.where("split <> 'fit'")).select(*rows.columns, "gbt")).select(*rows.columns, "gbt", "forest")
    return scoring.blended(lake.kept(scored, "condo-arms"), "gbt", "forest", "label")


@query()
def mdl_condo(spark, sf_dir):
    """Two arms blended, calibrated and given a band on the validation sales, judged on the test sales by size of the building."""
    band = F.when(F.col("building_units") < 5, "small").when(F.col("building_units") < 20, "medium").otherwise("large")
    scored = condo_scores(spark, sf_dir).where("split = 'test'").withColumn("band", band)
    root = lambda c: F.sqrt(F.avg(F.pow(F.col(c) - F.col("label"), 2)))
    inside = F.col("label").between(F.col("low"), F.col("high")).cast("double")
    return scored.groupBy("band").agg(F.count(F.lit(1)).alias("n"), *[root(c).alias(f"rmse_{c}") for c in ("gbt", "forest", "calibrated")], F.avg(inside).alias("coverage"), F.avg(F.col("high") - F.col("low")).alias("width"))


RISK_INPUTS = ["width", "disagreement", "neighbours", "conflict", "age"]


def risk_inputs(spark, sf_dir):
    """Validation and test sales with two arms' disagreement, the forest's own width, evidence, and the mean's absolute log error."""
    rows = _sample(spark, sf_dir).withColumns({"neighbours": (F.col("parcel_id") % 13).cast("double"), "conflict": (F.col("parcel_id") % 7 == 0).cast("double"), "age": (F.col("sale_id") % 90).cast("double")})
    fit = rows.where("split = 'fit'")
    names = [*rows.columns, "gbt", "forest"]
    gbt = models.fit_arm(fit, "gbt", NUMERIC, CATEGORICAL, "label")
    forest = models.fit_arm(fit, "forest", NUMERIC, CATEGORICAL, "label")
    both = lambda df: forest.transform(gbt.transform(df).select(*rows.columns, "gbt")).select(*names, "leaves")
    later = lake.kept(both(rows.where("split <> 'fit'")), "risk-arms")  # of the fit rows only leaves are asked for
    out = models.with_forest_quantiles(forest.transform(fit), later, "label").drop("leaves")
    point = (F.col("gbt") + F.col("forest")) / 2
    out = lake.kept(out.withColumns({"width": F.greatest(F.col("q_high") - F.col("q_low"), F.lit(0.0)), "disagreement": F.abs(F.col("gbt") - F.col("forest")), "error": F.abs(F.col("label") - point)}), "risk-inputs")
    return out.where("split = 'validation'"), out.where("split = 'test'")


@query()
def mdl_risk(spark, sf_dir):
    """The risk of every test sale; all are standard unless the model is admitted."""
    validation, test = risk_inputs(spark, sf_dir)
    fitted = risk.fit_risk(validation, test, RISK_INPUTS, "error", ["sale_date", "sale_id"])
    return fitted.score(test.fillna(0.0, RISK_INPUTS)).select("sale_id", "risk_score", "risk_tier", "error", F.lit(fitted.rejected is None).alias("promoted"))


_RISK = "floor((o_custkey * 37) % 50 / 5) / 10.0E0 AS s, ((o_custkey * 37) % 50) / 100.0E0 * (0.5E0 + (o_orderkey % 17) / 10.0E0) AS e"


@query(
    f"""WITH x AS (SELECT {_RISK} FROM orders), n AS (SELECT count(*) AS n FROM x), k AS (SELECT s, e, row_number() OVER (ORDER BY s, e) AS k, CASE WHEN s >= 0.9 THEN 'high' WHEN s >= 0.7 THEN 'elevated' ELSE 'standard' END AS tier FROM x),
a AS (SELECT 'tier' AS view_, tier AS segment, s, e FROM k UNION ALL SELECT 'risk_coverage', 'retain_' || f, s, e FROM k, n, (VALUES ('0.25', 0.25), ('0.50', 0.5), ('0.75', 0.75), ('0.90', 0.9), ('1.00', 1.0)) v(f, v) WHERE k <= greatest(1, ceil(n * v))),
g AS (SELECT view_, segment, count(*) AS n, avg(s) AS ms, avg(e) AS me, sqrt(avg(e * e)) AS rm FROM a GROUP BY ALL), r AS (SELECT (rank() OVER (ORDER BY s) + count(*) OVER (PARTITION BY s) / 2.0) AS ra, (rank() OVER (ORDER BY e) + count(*) OVER (PARTITION BY e) / 2.0) AS rb FROM x), c AS (SELECT corr(ra, rb) AS c FROM r),
t AS (SELECT max(me) FILTER (segment = 'standard') AS a, max(me) FILTER (segment = 'elevated') AS b, max(me) FILTER (segment = 'high') AS d, max(rm) FILTER (segment = 'standard') AS ra, max(rm) FILTER (segment = 'high') AS rd FROM g WHERE view_ = 'tier')
SELECT view_ AS view, segment, g.n, {r('g.n / n.n', 'share')}, {r('ms', 'mean_score')}, {r('me', 'mean_error')}, {r('rm', 'rmse')}, {r('c', 'spearman')}, coalesce(c >= 0.1 AND t.a < t.b AND t.b < t.d AND t.rd >= 1.2 * t.ra, false) AS promoted FROM g, n, c, t"""
)
def mdl_risk_rule(spark, sf_dir):
    """The rule by itself, on a score and an error with ties."""
    rows = read(spark, sf_dir, "orders").selectExpr(*_split(_RISK))
    told = risk.evaluate(rows, "s", "e", 0.7, 0.9)
    found = risk.spearman(rows, "s", "e")
    return told.withColumns({"spearman": F.lit(found).cast("double"), "promoted": F.lit(risk.promotion(told, found) is None)})
