"""The screen of published values, intervals and equity studies, over customers, orders and pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import equity, intervals, ratio, screen
from .adapters import PAIRS, SALES, pairs, read, sales
from .catalog import query, r
from .ratio_queries import CLEAN, _clean

SCREEN_COLUMNS = {
    "parcel_id": "c_custkey", "district": "c_nationkey", "segment": "c_mktsegment",
    "opa_market_value": "CASE WHEN c_custkey % 29 = 0 THEN NULL ELSE 100000.0E0 + c_acctbal * 20 END",
    "model_median": "90000.0E0 + (c_custkey * 7919) % 60000", "model_pi_low_90": "60000.0E0 + (c_custkey * 7919) % 60000", "model_pi_high_90": "130000.0E0 + (c_custkey * 7919) % 90000",
    "pred_point_calibrated": "CASE WHEN c_custkey % 6 <> 0 THEN 95000.0E0 + (c_custkey * 7919) % 60000 END",
    "conformal_pi_low_90": "CASE WHEN c_custkey % 6 <> 0 THEN 70000.0E0 + (c_custkey * 7919) % 60000 END",
    "conformal_pi_high_90": "CASE WHEN c_custkey % 6 <> 0 THEN 120000.0E0 + (c_custkey * 7919) % 90000 END",
    "char_livable_area": "CASE WHEN c_custkey % 31 = 0 THEN 0.0E0 ELSE 1000.0E0 END", "char_year_built": "1900 + c_custkey % 126", "valuation_year": "2026", "record_quality_low": "c_custkey % 37 = 0",
}
ROWS = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in SCREEN_COLUMNS.items()) + " FROM customer"
V = "opa_market_value"
FIN = f"""rows_ AS ({ROWS}), st AS (SELECT *, coalesce({V} > 0 AND model_median > 0, false) AS has, coalesce(char_livable_area, 0) <= 0 OR coalesce(record_quality_low, false) AS insuf,
  coalesce(char_year_built >= valuation_year - 2, false) AS new_build, coalesce(pred_point_calibrated, model_median) AS display_median FROM rows_),
fl AS (SELECT *, CASE WHEN insuf THEN 'insufficient_data' WHEN NOT has THEN 'no_assessment'
    WHEN {V} > model_pi_high_90 AND (conformal_pi_high_90 IS NULL OR {V} > conformal_pi_high_90) THEN CASE WHEN new_build THEN 'within_range' ELSE 'over' END
    WHEN {V} < model_pi_low_90 AND (conformal_pi_low_90 IS NULL OR {V} < conformal_pi_low_90) THEN 'under' ELSE 'within_range' END AS assessment_flag,
  CASE WHEN has AND NOT insuf THEN (ln({V}) - ln(model_median)) / (ln(model_pi_high_90 / model_pi_low_90) / 3.29) END AS screen_z,
  least(coalesce(conformal_pi_low_90, model_pi_low_90), display_median * 0.9) AS lo, greatest(coalesce(conformal_pi_high_90, model_pi_high_90), display_median * 1.1) AS hi,
  CASE WHEN NOT insuf THEN {V} / display_median END AS display_ratio FROM st),
scr AS (SELECT *, abs(screen_z) AS az, CASE WHEN assessment_flag = 'within_range' AND {V} > display_median AND ({V} - lo) / (hi - lo) >= 0.9 THEN 'high'
  WHEN assessment_flag = 'within_range' AND {V} < display_median AND ({V} - lo) / (hi - lo) <= 0.1 THEN 'low' END AS attention FROM fl)"""


def _screen(spark, sf_dir):
    return screen.finalize(read(spark, sf_dir, "customer").selectExpr(*[f"{e} AS {n}" for n, e in SCREEN_COLUMNS.items()]))


@query(
    f"""WITH {FIN} SELECT parcel_id, assessment_flag, attention, new_build, {r("display_median", "display_median")}, {r("lo", "display_pi_low_90")}, {r("hi", "display_pi_high_90")},
{r("screen_z", "screen_z")}, {r("display_ratio", "display_ratio")} FROM scr"""
)
def scr_finalize(spark, sf_dir):
    return _screen(spark, sf_dir).select("parcel_id", "assessment_flag", "attention", "new_build", "display_median", "display_pi_low_90", "display_pi_high_90", "screen_z", "display_ratio")


@query(
    f"""WITH {FIN}, k AS (SELECT parcel_id, {V} AS v, concat_ws('|', district, segment, CAST(char_year_built % 3 AS VARCHAR)) AS k FROM rows_ WHERE {V} > 0),
s AS (SELECT k, count(*) AS twin_n, median(v) AS m FROM k GROUP BY k HAVING count(*) >= 5) SELECT parcel_id, twin_n, {r("v / m", "opa_vs_twin_median")} FROM k JOIN s USING (k)"""
)
def scr_twins(spark, sf_dir):
    return screen.twins(_screen(spark, sf_dir).withColumn("y", F.col("char_year_built") % 3), ["district", "segment", "y"])


@query(
    f"""WITH {FIN} SELECT count(*) FILTER ((assessment_flag = 'over' AND {V} <= conformal_pi_high_90) OR (assessment_flag = 'under' AND {V} >= conformal_pi_low_90)) AS disputed_flags,
count(*) FILTER (display_median < lo OR display_median > hi) AS median_outside_band, count(*) FILTER (display_median <= lo * 1.005 OR display_median >= hi * 0.995) AS median_on_edge,
count(*) FILTER ((attention = 'high' AND {V} <= display_median) OR (attention = 'low' AND {V} >= display_median)) AS tier_against_side FROM scr"""
)
def scr_invariants(spark, sf_dir):
    return screen.invariants(_screen(spark, sf_dir))


_FLAGS = ("over", "under", "within_range", "insufficient_data", "no_assessment")


@query(
    f"""WITH {FIN} SELECT segment, count(*) AS n, {", ".join(f"count(*) FILTER (assessment_flag = '{f}') AS n_{f}" for f in _FLAGS)}, count(attention) AS n_watch,
{r("median(hi / lo)", "median_width")}, {r("max(hi / lo)", "max_width")} FROM scr GROUP BY segment"""
)
def scr_audit(spark, sf_dir):
    return screen.audit(_screen(spark, sf_dir), "segment")


@query(
    f"""WITH {FIN} SELECT parcel_id, assessment_flag, {r(V, V)}, {r("screen_z", "screen_z")} FROM scr WHERE assessment_flag = 'over' AND {V} > 30000 AND hi / lo <= 10 ORDER BY az DESC, parcel_id LIMIT 25"""
)
def scr_leaderboards(spark, sf_dir):
    return screen.leaderboard(_screen(spark, sf_dir), "over", 25)


@query(
    f"""WITH {FIN}, a AS (SELECT *, concat_ws('/', district, ntile(5) OVER (PARTITION BY district ORDER BY {V} NULLS FIRST, parcel_id)) AS stratum,
  round(coalesce(az, 0) * (1 + CASE WHEN attention IS NOT NULL THEN 0.5 ELSE 0 END) + 0.2 * coalesce(abs(ln(display_ratio)), 0), 6) AS priority,
  array_to_string(list_filter([CASE WHEN assessment_flag IN ('over', 'under') THEN 'outside_interval' END, CASE WHEN attention IS NOT NULL THEN 'edge_of_band' END, CASE WHEN abs(ln(display_ratio)) > 0.5 THEN 'large_gap' END], lambda x: x IS NOT NULL), ',') AS reasons FROM scr),
b AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY priority DESC, parcel_id) AS k FROM a)
SELECT parcel_id, stratum, {r("priority", "priority")}, CAST(k AS INT) AS rank_in_stratum, reasons FROM b ORDER BY k, b.priority DESC, parcel_id LIMIT 100"""
)
def scr_review_queue(spark, sf_dir):
    return screen.review_queue(_screen(spark, sf_dir), "district", 100)


@query(
    f"""WITH {FIN}, p AS (SELECT parcel_id, district AS a, display_median AS m, {V} / display_median AS q FROM scr WHERE display_median > 0 AND {V} > 0),
f AS (SELECT x.parcel_id, count(*) AS n, median(y.q) AS m, avg(CAST(y.q < x.q AS INT)) AS sb FROM p x JOIN p y ON x.a = y.a AND x.parcel_id <> y.parcel_id AND y.m <= x.m * 1.5 AND y.m >= x.m / 1.5 GROUP BY x.parcel_id),
g AS (SELECT x.parcel_id, count(*) AS n, median(y.q) AS m, avg(CAST(y.q < x.q AS INT)) AS sb FROM p x JOIN p y ON x.a = y.a AND x.parcel_id <> y.parcel_id WHERE x.parcel_id NOT IN (SELECT parcel_id FROM f WHERE n >= 40) GROUP BY x.parcel_id),
h AS (SELECT p.parcel_id, p.q AS own, CASE WHEN f.n >= 40 THEN f.n WHEN g.n >= 40 THEN g.n ELSE coalesce(f.n, 0) END AS n_peers, CASE WHEN f.n >= 40 THEN f.m WHEN g.n >= 40 THEN g.m END AS pm, CASE WHEN f.n >= 40 THEN f.sb WHEN g.n >= 40 THEN g.sb END AS sb
  FROM p LEFT JOIN f USING (parcel_id) LEFT JOIN g USING (parcel_id))
SELECT parcel_id, n_peers, {r("pm", "peer_median")}, {r("sb", "share_below")}, CASE WHEN pm IS NOT NULL THEN CASE WHEN own / pm - 1 > 0.05 THEN 'above_peers' WHEN own / pm - 1 < -0.05 THEN 'below_peers' ELSE 'in_line' END END AS verdict FROM h"""
)
def scr_equity_context(spark, sf_dir):
    return screen.equity_context(_screen(spark, sf_dir), "district")


@query(f"WITH {FIN} SELECT segment, CAST(least(floor((display_ratio - 0.4) / ((1.6 - 0.4) / 24)), 23) AS INT) AS bin, count(*) AS n FROM scr WHERE display_ratio BETWEEN 0.4 AND 1.6 GROUP BY ALL")
def scr_peer_histogram(spark, sf_dir):
    return screen.histogram(_screen(spark, sf_dir), "display_ratio", 0.4, 1.6, 24, ["segment"])


@query(f"WITH {FIN} SELECT assessment_flag, count(*) AS n, count(attention) AS watch, {r('median(display_ratio)', 'median_ratio')} FROM scr GROUP BY ALL")
def scr_stats(spark, sf_dir):
    return _screen(spark, sf_dir).groupBy("assessment_flag").agg(F.count(F.lit(1)).alias("n"), F.count("attention").alias("watch"), F.median("display_ratio").alias("median_ratio"))


@query("SELECT c_custkey AS parcel_id, c_name AS address FROM customer WHERE CAST(c_custkey AS VARCHAR) = '12' OR upper(c_name) LIKE '%12%' ORDER BY CASE WHEN upper(c_name) LIKE '12%' THEN 0 ELSE 1 END, c_name, c_custkey LIMIT 10")
def scr_search(spark, sf_dir):
    return screen.search(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("parcel_id"), F.col("c_name").alias("address")), "12")


@query(
    f"""WITH s AS ({SALES}), k AS (SELECT *, row_number() OVER (PARTITION BY parcel_id ORDER BY sale_date DESC, sale_id DESC) AS k FROM s)
SELECT parcel_id, count(*) AS n, string_agg(CAST(sale_date AS VARCHAR), ',' ORDER BY k) AS dates FROM k WHERE k <= 10 GROUP BY parcel_id"""
)
def scr_histories(spark, sf_dir):
    h = screen.histories(sales(spark, sf_dir))
    return h.select("parcel_id", F.size("sales").cast("long").alias("n"), F.array_join(F.transform("sales", lambda x: x["sale_date"].cast("string")), ",").alias("dates"))


@query(
    f"""WITH s AS ({SALES}), n AS (SELECT count(*) AS n FROM s), k AS (SELECT sale_id, row_number() OVER (ORDER BY sale_date, sale_id) AS k FROM s), t AS (SELECT n, greatest(1, CAST(floor(n * 0.1) AS BIGINT)) AS nt FROM n),
u AS (SELECT *, greatest(1, CAST(floor((n - nt) * 0.1) AS BIGINT)) AS nv FROM t)
SELECT sale_id, CASE WHEN k > n - nt THEN 'test' WHEN k > n - nt - nv THEN 'validation' ELSE 'fit' END AS split FROM k, u"""
)
def mdl_time_split(spark, sf_dir):
    return intervals.time_split(sales(spark, sf_dir), "sale_date", "sale_id").select("sale_id", "split")


_RES = f"res AS (SELECT brand, flag, line, ln(sale) - ln(est) AS e, ln(est) AS a, ln(sale) AS y FROM clean)"


def _residuals(spark, sf_dir):
    return _clean(spark, sf_dir).withColumns({"e": F.ln("sale") - F.ln("est"), "a": F.ln("est"), "y": F.ln("sale")})


@query(
    f"""WITH {CLEAN}, {_RES}, w AS (SELECT brand, sum((a - 10) * (y - 10)) / nullif(sum((a - 10) ** 2), 0) AS w FROM res GROUP BY brand)
SELECT brand, {r("coalesce(least(greatest(w, 0), 1), 0.5)", "weight")} FROM w"""
)
def mdl_stack(spark, sf_dir):
    return intervals.stack_weight(_residuals(spark, sf_dir).withColumn("b", F.lit(10.0)), "a", "b", "y", ["brand"])


_Q = """k AS (SELECT {0}, e, row_number() OVER (PARTITION BY {0} ORDER BY e) AS k, count(*) OVER (PARTITION BY {0}) AS n FROM res),
q AS (SELECT {0}, max(n) AS n, max(e) FILTER (k = n + 1 - ceil((n + 1) * 0.95)) AS lo, max(e) FILTER (k = ceil((n + 1) * 0.95)) AS hi FROM k GROUP BY {0})"""


@query(f"WITH {CLEAN}, {_RES}, {_Q.format('flag')} SELECT flag, n, {r('lo', 'lo')}, {r('hi', 'hi')} FROM q")
def mdl_conformal_global(spark, sf_dir):
    return intervals.split_quantiles(_residuals(spark, sf_dir), "e", ["flag"])


@query(
    f"""WITH {CLEAN}, {_RES}, {_Q.format("brand")}, g AS (SELECT e, row_number() OVER (ORDER BY e) AS k, count(*) OVER () AS n FROM res),
t AS (SELECT max(e) FILTER (k = n + 1 - ceil((n + 1) * 0.95)) AS lo, max(e) FILTER (k = ceil((n + 1) * 0.95)) AS hi FROM g)
SELECT brand, n, {r("CASE WHEN n >= 200 THEN q.lo ELSE t.lo END", "lo")}, {r("CASE WHEN n >= 200 THEN q.hi ELSE t.hi END", "hi")}, n >= 200 AS own FROM q, t"""
)
def mdl_conformal_district(spark, sf_dir):
    return intervals.district_offsets(_residuals(spark, sf_dir), "e", "brand")


@query(
    f"""WITH {CLEAN}, {_RES}, s AS (SELECT brand, greatest((a - 0.5) - y, y - (a + 0.5)) AS c FROM res), k AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY c) AS k, count(*) OVER (PARTITION BY brand) AS n FROM s)
SELECT brand, max(n) AS n, {r("max(c) FILTER (k = least(ceil((n + 1) * 0.9), n))", "correction")} FROM k GROUP BY brand"""
)
def mdl_cqr(spark, sf_dir):
    df = _residuals(spark, sf_dir).withColumns({"lo": F.col("a") - 0.5, "hi": F.col("a") + 0.5})
    return intervals.cqr_correction(df, "y", "lo", "hi", ["brand"])


@query(
    f"""WITH {CLEAN}, {_RES}, k AS (SELECT flag, e, row_number() OVER (PARTITION BY flag ORDER BY abs(a - 9), e) AS k, count(*) OVER (PARTITION BY flag) AS n FROM res)
SELECT flag, share, count(*) AS n, {r("sqrt(avg(e ** 2))", "rmse")} FROM k, (SELECT unnest([0.25, 0.5, 0.75, 0.9, 1.0])::DOUBLE AS share) WHERE k <= ceil(n * share) GROUP BY ALL"""
)
def mdl_risk_coverage(spark, sf_dir):
    return intervals.risk_coverage(_residuals(spark, sf_dir).withColumn("score", F.abs(F.col("a") - 9)), "score", "e", ["flag"])


@query(
    """WITH n AS (SELECT p_type AS fine, p_brand AS coarse, count(*) AS n FROM part GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY fine ORDER BY n DESC, coarse) AS k FROM n)
SELECT fine, coarse FROM k WHERE k = 1"""
)
def mdl_geo_index(spark, sf_dir):
    return intervals.modal_parent(read(spark, sf_dir, "part").select(F.col("p_type").alias("fine"), F.col("p_brand").alias("coarse")), "fine", "coarse")


@query(
    f"""WITH {CLEAN}, {_RES}, c AS (SELECT *, 'all' AS city FROM res), m0 AS (SELECT city, sum(e) / (count(*) + 20) AS m FROM c GROUP BY city), l0 AS (SELECT c.*, m AS f0, e - m AS r0 FROM c JOIN m0 USING (city)),
m1 AS (SELECT flag, sum(r0) / (count(*) + 20) AS m FROM l0 GROUP BY flag), l1 AS (SELECT l0.*, m AS f1, r0 - m AS r1 FROM l0 JOIN m1 USING (flag)), m2 AS (SELECT brand, sum(r1) / (count(*) + 20) AS m FROM l1 GROUP BY brand)
SELECT city, flag, brand, count(*) AS n, {r("max(f0 + f1 + m2.m)", "effect")} FROM l1 JOIN m2 USING (brand) GROUP BY ALL"""
)
def mdl_hierarchical(spark, sf_dir):
    return intervals.partial_pooling(_residuals(spark, sf_dir).withColumn("city", F.lit("all")), "e", ["city", "flag", "brand"])


_ROLL = """rolls AS (SELECT o_custkey AS parcel_id, year(o_orderdate) AS y, max(o_totalprice) AS v FROM orders WHERE year(o_orderdate) IN (1997, 1998) GROUP BY ALL),
mt AS (SELECT parcel_id, a.v AS vo, b.v AS vn, b.v / a.v - 1 AS ch FROM (SELECT * FROM rolls WHERE y = 1997) a JOIN (SELECT * FROM rolls WHERE y = 1998) b USING (parcel_id))"""


@query(
    f"""WITH {_ROLL}, f AS (SELECT *, CAST(floor((row_number() OVER (ORDER BY vo, parcel_id) - 1) * 5 / count(*) OVER ()) + 1 AS INT) AS fifth FROM mt)
SELECT fifth, count(*) AS n, count(*) FILTER (ch > 0.02) AS n_up, count(*) FILTER (ch < -0.02) AS n_down, {r("median(ch)", "median_change")}, {r("quantile_cont(ch, 0.25)", "q25")},
{r("quantile_cont(ch, 0.75)", "q75")}, {r("sum(vn) / sum(vo)", "total_ratio")} FROM f GROUP BY fifth"""
)
def eq_annual_roll(spark, sf_dir):
    o = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("parcel_id"), F.year("o_orderdate").alias("year")).agg(F.max("o_totalprice").alias("value"))
    return equity.roll_summary(equity.annual_roll(o, 1997, 1998))


_E = [10_000.0, 30_000.0, 60_000.0]
_BIN = " + ".join(f"CAST({{0}} >= {e} AS INT)" for e in _E)


@query(
    f"""WITH {CLEAN}, b AS (SELECT *, {_BIN.format("sale")} AS bin FROM clean), c AS (SELECT bin, flag, count(*) AS n, ln(median(r)) AS level FROM b GROUP BY ALL HAVING count(*) >= 100),
g AS (SELECT bin FROM c GROUP BY bin HAVING count(DISTINCT flag) = (SELECT count(DISTINCT flag) FROM clean)) SELECT flag, count(*) AS bins, {r("avg(level)", "level")} FROM c JOIN g USING (bin) GROUP BY flag"""
)
def eq_value_standardised(spark, sf_dir):
    return equity.value_standardised(_clean(spark, sf_dir), "flag", _E, 100)


@query(
    f"""WITH {CLEAN}, k AS (SELECT sum(est) / sum(sale) AS k FROM clean), o AS (SELECT {_BIN.format("sale")} AS bin, (est - sale * k) * 0.013998 AS over_ FROM clean, k)
SELECT bin, count(*) AS n, {r("sum(over_)", "shift", 1)}, {r("avg(over_)", "per_row")} FROM o GROUP BY bin"""
)
def eq_tax_shift(spark, sf_dir):
    return equity.tax_shift(_clean(spark, sf_dir), "est", "sale", _E, 0.013998).withColumn("shift", F.round("shift", 1))


@query(
    f"""WITH {CLEAN}, w AS (SELECT r, sale, est, unnest(CASE WHEN flag = 'A' THEN ['all', 'subset'] ELSE ['all'] END) AS which FROM clean), l AS (SELECT which, r, 'sale' AS "by", sale AS x FROM w UNION ALL SELECT which, r, 'est', est FROM w),
c AS (SELECT which, "by", quantile_cont(x, 0.2) AS lo, quantile_cont(x, 0.8) AS hi FROM l GROUP BY ALL)
SELECT which, "by", {r("median(r) FILTER (x <= lo)", "q1_median")}, {r("median(r) FILTER (x >= hi)", "q5_median")} FROM l JOIN c USING (which, "by") GROUP BY ALL"""
)
def eq_robustness_grid(spark, sf_dir):
    return equity.robustness_grid(_clean(spark, sf_dir).withColumn("s", F.col("flag") == "A"), "s", ["sale", "est"])


@query(
    f"""WITH {CLEAN}, s AS (SELECT unnest(['overall', flag]) AS seg, ln(est) - ln(sale) AS x, ln(est * 1.1) - ln(sale) AS z FROM clean), m AS (SELECT seg, sqrt(avg(z ** 2)) - sqrt(avg(x ** 2)) AS d FROM s GROUP BY seg)
SELECT count(*) AS segments, {r("max(d)", "worst")}, max(d) FILTER (seg = 'overall') < 0 AND bool_and(d <= 0.01) AS promote FROM m"""
)
def eq_promotion_gate(spark, sf_dir):
    seg = lambda df: df.withColumn("segment", F.explode(F.array(F.lit("overall"), F.col("flag"))))
    a = ratio.fit_metrics(seg(_clean(spark, sf_dir)), ["segment"])
    b = ratio.fit_metrics(seg(_clean(spark, sf_dir).withColumn("est", F.col("est") * 1.1)), ["segment"])
    return equity.promotion_gate(b, a, "segment", "rmse_log", 0.01)


_D = [-0.2, -0.15, -0.1, -0.05]


@query(
    f"""WITH p AS (SELECT line, price, [{", ".join(map(str, _D))}][1 + {_BIN.format("price")}] AS d FROM ({PAIRS})) SELECT line, {r("price", "price")}, {r("price * (1 + d)", "cash")}, {r("price / (1 + d)", "retail")} FROM p"""
)
def eq_cash_value(spark, sf_dir):
    cash, retail = equity.cash_value("price", _E, _D)
    return pairs(spark, sf_dir).select("line", "price", cash.alias("cash"), retail.alias("retail"))


@query(
    f"""WITH {CLEAN}, p AS (SELECT brand, 1 / (1 + exp((ln(sale) - 10) / 0.8)) AS w, CAST(r > 1 AS INT) AS y FROM clean), k AS (SELECT *, rank() OVER (PARTITION BY brand ORDER BY w) + (count(*) OVER (PARTITION BY brand, w) - 1) / 2 AS k FROM p)
SELECT brand, count(*) AS n, {r("avg((w - y) ** 2)", "brier")}, {r("(sum(k) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / nullif(sum(y) * (count(*) - sum(y)), 0)", "auc")} FROM k GROUP BY brand"""
)
def eq_classifier_calibration(spark, sf_dir):
    df = _clean(spark, sf_dir).withColumns({"w": equity.router_weight(F.ln("sale"), 10.0, 0.8), "y": (F.col("r") > 1).cast("int")})
    return equity.classifier_calibration(df, "w", "y", ["brand"])


@query()
def eq_event_sample(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("parcel_id"), "o_orderdate", "o_orderpriority")
    touched = [o.where("o_orderdate >= '2001-06-01'"), o.where("o_orderpriority = '1-URGENT' and o_orderdate >= '2001-01-01'")]
    population = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("parcel_id"), "c_mktsegment")
    return equity.event_sample(population, touched, 200, 7)
