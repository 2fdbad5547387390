"""Ratio studies over orders as sales: conventions, certification windows, redistribution, folds and arms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import channel, folds
from ..operators import ratio_studies as rs
from ..operators.ratio import clean_pairs, evaluate, ratio_metrics
from .adapters import EVENTS, events, read
from .catalog import query, r
from .crossfit_queries import CHANNEL_INPUTS, CHANNEL_SALE, channel_sales, staged_parts
from .ratio_queries import FIT

# Sales with an estimate, a roll value, a style, a district and how they were paid.
_SALE = {
    "sale_id": "o_orderkey",
    "parcel_id": "o_custkey",
    "sale_date": "CAST(o_orderdate AS DATE)",
    "sale_price": "o_totalprice",
    "time_adj_log": "CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE (o_orderkey % 20) / 100.0E0 END",
    "style": "CASE o_custkey % 5 WHEN 0 THEN 'row' WHEN 1 THEN 'twin' WHEN 2 THEN 'detached' WHEN 3 THEN NULL ELSE 'row' END",
    "district": "o_custkey % 6",
    "cash": "o_orderkey % 4 = 0",
    "model": "o_totalprice * (0.7E0 + (o_orderkey % 61) / 100.0E0)",
    "assessed": "o_totalprice * (0.5E0 + (o_custkey % 97) / 100.0E0)",
    "log_price": "ln(o_totalprice)",
    "log_area": "ln(300.0E0 + (o_custkey * 37) % 2500)",
    "beds": "1.0E0 + o_custkey % 5",
    "age": "(o_custkey * 13 + o_orderkey) % 120 / 10.0E0",
    "is_twin": "CASE WHEN o_custkey % 5 = 1 THEN 1.0E0 ELSE 0.0E0 END",
    "is_detached": "CASE WHEN o_custkey % 5 = 2 THEN 1.0E0 ELSE 0.0E0 END",
    **{f"in_{k}": f"CASE WHEN o_custkey % 6 = {k} THEN 1.0E0 ELSE 0.0E0 END" for k in range(1, 6)},
    "context": "(o_custkey % 11) / 10.0E0",
    "minority": "o_custkey % 7 = 0",
    "period": "year(o_orderdate) - 1992",
}
_COLUMNS = [f"{e} AS {c}" for c, e in _SALE.items()]
D = f"d AS (SELECT {', '.join(_COLUMNS)} FROM orders)"
NOW = "sale_price * exp(coalesce(time_adj_log, 0))"


def _sales(spark, sf_dir):
    return read(spark, sf_dir, "orders").selectExpr(*_COLUMNS)


def _metrics(src: str, keys: str, tag: str = "") -> str:
    """CTEs lv, rk and met (with ``tag``) over ``src`` (est, sale, r and the keys)."""
    return f"""lv{tag} AS (SELECT {keys}, median(r) AS m FROM {src} GROUP BY {keys}), rk{tag} AS (SELECT {src}.*, m, row_number() OVER (PARTITION BY {keys} ORDER BY sale, est) AS k FROM {src} JOIN lv{tag} USING ({keys})),
met{tag} AS (SELECT {keys}, count(*) AS n, CASE WHEN count(*) >= 3 THEN max(m) END AS median_ratio, CASE WHEN count(*) >= 3 THEN 100 * avg(abs(r - m)) / max(m) END AS cod, CASE WHEN count(*) >= 3 THEN avg(r) / (sum(est) / sum(sale)) END AS prd,
  CASE WHEN count(*) >= 3 THEN regr_slope((r - m) / m, ln((sale + est / m) / 2) / ln(2)) END AS prb,
  CASE WHEN count(*) >= 3 THEN (2 * sum(k * est) / (count(*) * sum(est)) - (count(*) + 1) / count(*)) / (2 * sum(k * sale) / (count(*) * sum(sale)) - (count(*) + 1) / count(*)) END AS mki FROM rk{tag} GROUP BY {keys})"""


def _trim(src: str, keys: str, out: str) -> str:
    return f"""q_{out} AS (SELECT {keys}, quantile_cont(r, 0.25) AS q1, quantile_cont(r, 0.75) AS q3 FROM {src} GROUP BY {keys}),
{out} AS (SELECT {src}.*, r < q1 - 3 * (q3 - q1) OR r > q3 + 3 * (q3 - q1) AS outlier FROM {src} JOIN q_{out} USING ({keys}))"""


_SHOW = ", ".join(r(c, c) for c in ("median_ratio", "cod", "prd", "prb", "mki"))
_ROLLS = "SELECT c_custkey AS parcel_id, y AS roll_year, 50000.0E0 + c_custkey % 97 * 1000 AS roll_value FROM customer, (SELECT unnest([1996, 1998]) AS y)"


@query(
    f"""WITH {D}, rolls AS ({_ROLLS}), j AS (SELECT d.*, roll_year, roll_value, CASE WHEN year(sale_date) = roll_year - 2 THEN 'before_certification' WHEN sale_date BETWEEN make_date(roll_year - 1, 7, 1) AND make_date(roll_year, 6, 30) THEN 'after_certification' END AS window_ FROM d JOIN rolls USING (parcel_id)),
raw AS (SELECT roll_year, window_, avg(CAST(abs(roll_value / sale_price - 1) <= 0.02 AS INT)) AS w FROM j WHERE window_ IS NOT NULL GROUP BY ALL HAVING count(*) >= 200),
p AS (SELECT roll_year, window_, roll_value AS est, {NOW} AS sale, roll_value / ({NOW}) AS r FROM j WHERE window_ IS NOT NULL), {_trim('p', 'roll_year, window_', 't')}, k AS (SELECT * FROM t WHERE NOT outlier), {_metrics('k', 'roll_year, window_')}
SELECT CAST(roll_year AS INT) AS roll_year, window_ AS "window", n, {r('median_ratio', 'median_ratio')}, {r('cod', 'cod')}, {r('prd', 'prd')}, {r('prb', 'prb')}, {r('w', 'within_2pct')} FROM met JOIN raw USING (roll_year, window_)"""
)
def eq_sale_chasing(spark, sf_dir):
    rolls = read(spark, sf_dir, "customer").selectExpr("c_custkey AS parcel_id", "explode(array(1996, 1998)) AS roll_year", "50000.0E0 + c_custkey % 97 * 1000 AS roll_value")
    return rs.sale_chasing(_sales(spark, sf_dir), rolls)


@query(
    f"""WITH {D}, y AS (SELECT *, CAST(year(sale_date) AS INT) AS year, unnest(CASE WHEN cash THEN ['raw_sale'] ELSE ['raw_sale', 'financed'] END) AS benchmark FROM d), p AS (SELECT year, benchmark, assessed AS est, sale_price AS sale, assessed / sale_price AS r FROM y),
t AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY year, benchmark ORDER BY sale, est) - 1) * 5 / count(*) OVER (PARTITION BY year, benchmark)) + 1 AS INT) AS tier FROM p),
g AS (SELECT year, benchmark, tier, count(*) AS n, sum(est) AS a, sum(sale) AS v FROM t GROUP BY ALL), o AS (SELECT *, a / sum(a) OVER w - v / sum(v) OVER w AS os FROM g WINDOW w AS (PARTITION BY year, benchmark)),
b AS (SELECT year, benchmark, sum(n) AS n_sales, sum(os) FILTER (tier <= 2) AS bottom40 FROM o GROUP BY ALL HAVING sum(n) >= 500), q AS (SELECT year, benchmark, median(r) AS m, quantile_cont(sale, 0.2) AS lo, quantile_cont(sale, 0.8) AS hi FROM p GROUP BY ALL),
e AS (SELECT year, benchmark, median(r) FILTER (sale <= lo) AS a, median(r) FILTER (sale >= hi) AS b FROM p JOIN q USING (year, benchmark) GROUP BY ALL), l AS (SELECT CAST(year(o_orderdate) AS INT) AS year, sum(o_totalprice) * 0.013998 AS levy FROM orders GROUP BY ALL),
z AS (SELECT max(sale_date) AS d FROM d)
SELECT year, benchmark, CASE WHEN month(z.d) < 12 THEN year = year(z.d) ELSE false END AS partial_year, CAST(n_sales AS BIGINT) AS n_sales, {r('m', 'median_ratio')}, {r('a / e.b', 'q1_q5_ratio')}, {r('bottom40', 'bottom40')}, {r('bottom40 * coalesce(levy, 0)', 'shifted', 2)}, {r('bottom40 * coalesce(levy, 0) / 1000', 'per_resident', 3)}
FROM b JOIN q USING (year, benchmark) JOIN e USING (year, benchmark) LEFT JOIN l USING (year), z""",
)
def eq_redistribution(spark, sf_dir):
    levies = read(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year")).agg((F.sum("o_totalprice") * 0.013998).alias("levy"))
    out = rs.redistribution(_sales(spark, sf_dir), levies, 1000)
    return out.withColumns({"shifted": F.round("shifted", 2), "per_resident": F.round("per_resident", 3)})


@query(
    f"""WITH {D}, p AS (SELECT 'full' AS card, assessed AS est, sale_price AS sale, assessed / sale_price AS r, district, cash FROM d), f AS (SELECT 'financed' AS card, assessed AS est, {NOW} AS sale, assessed / ({NOW}) AS r FROM d WHERE NOT cash),
{_trim('f', 'card', 't')}, m AS (SELECT card, est, sale, r FROM t WHERE NOT outlier), u AS (SELECT card, est, sale, r FROM p UNION ALL SELECT * FROM m), {_metrics('u', 'card')},
c AS (SELECT quantile_cont(sale, [0.2, 0.4, 0.6, 0.8]) AS c FROM m), v AS (SELECT CAST(len(list_filter(c, lambda z: z <= sale)) + 1 AS VARCHAR) AS part, r FROM m, c),
b AS (SELECT CAST(district AS VARCHAR) AS part, count(*) AS n, avg(CAST(cash AS INT)) AS s, count(*) FILTER (cash) AS nc, count(*) FILTER (NOT cash) AS nf, median(r) FILTER (cash) - median(r) FILTER (NOT cash) AS gap FROM p GROUP BY district),
a AS (SELECT card, unnest(['median_ratio', 'cod', 'prd']) AS part, n, unnest([median_ratio, cod, prd]) AS value FROM met UNION ALL SELECT 'tier', part, count(*), median(r) FROM v GROUP BY part UNION ALL SELECT 'cash_share', part, n, s FROM b UNION ALL SELECT 'cash_gap', part, n, gap FROM b WHERE nc >= 50 AND nf >= 50)
SELECT card, part, n, {r('value', 'value')} FROM a"""
)
def eq_site_cards(spark, sf_dir):
    return rs.site_cards(_sales(spark, sf_dir))


@query(
    f"""WITH {D}, e AS ({EVENTS}), l AS (SELECT parcel_id, max(issued) AS last FROM e GROUP BY parcel_id), x AS (SELECT d.*, coalesce(last > sale_date, false) AS exposed FROM d LEFT JOIN l USING (parcel_id)),
y AS (SELECT *, unnest(['overall', CASE WHEN exposed THEN 'exposed' ELSE 'safe' END]) AS subset FROM x), a AS (SELECT subset, model AS est, sale_price AS sale, model / sale_price AS r FROM y), b AS (SELECT subset, assessed AS est, sale_price AS sale, assessed / sale_price AS r FROM y),
{_metrics('a', 'subset', '1')}, {_metrics('b', 'subset', '2')}
SELECT subset, met1.n, {r('met1.n / (SELECT count(*) FROM d)', 'share')}, {r('met1.cod', 'model_cod')}, {r('met1.median_ratio', 'model_ratio')}, {r('met2.cod', 'roll_cod')}, {r('met2.median_ratio', 'roll_ratio')}, {r('met2.cod - met1.cod', 'edge')} FROM met1 JOIN met2 USING (subset)"""
)
def eq_char_leakage(spark, sf_dir):
    p = _sales(spark, sf_dir).withColumn("roll", F.col("assessed"))
    return rs.leakage_split(p.select("sale_id", "parcel_id", "sale_date", "sale_price", "model", "roll"), events(spark, sf_dir).select("parcel_id", "issued"))


_KNOTS = f"""{D}, v AS (SELECT ln(model) AS p, log_price AS y FROM d WHERE NOT cash), q AS (SELECT quantile_cont(p, [0.2, 0.4, 0.6, 0.8]) AS e FROM v), s AS (SELECT CAST(len(list_filter(e, lambda z: z <= p)) + 1 AS INT) AS segment, p, y FROM v, q),
k0 AS (SELECT segment, count(*) AS n, median(p) AS center, median(y - p) AS c FROM s GROUP BY segment), k AS (SELECT segment, n, center, max(center + c) OVER (ORDER BY segment) - center AS correction FROM k0)"""


@query(
    f"""WITH {_KNOTS}, t AS (SELECT sale_id, ln(model) AS p FROM d WHERE cash),
j AS (SELECT sale_id, p, arg_max(center, center) FILTER (center < p) AS a, arg_max(correction, center) FILTER (center < p) AS ca, arg_min(center, center) FILTER (center >= p) AS b, arg_min(correction, center) FILTER (center >= p) AS cb FROM t, k GROUP BY sale_id, p)
SELECT sale_id, {r("p + CASE WHEN a IS NULL THEN cb WHEN b IS NULL THEN ca ELSE ca + (cb - ca) * (p - a) / (b - a) END", "calibrated")} FROM j"""
)
def eq_segment_calibration(spark, sf_dir):
    d = _sales(spark, sf_dir).withColumn("p", F.ln("model"))
    knots = rs.segment_knots(d.where("NOT cash"), "p", "log_price")
    return rs.apply_knots(d.where("cash"), knots, "p").select("sale_id", "calibrated")


_SCORES = "SELECT c_custkey AS parcel_id, CASE WHEN c_custkey % 3 = 0 THEN 'control' ELSE 'screened' END AS role, CASE WHEN c_custkey % 8 <> 0 THEN c_acctbal / 1000 END AS score FROM customer"


@query(f"WITH s AS ({_SCORES}), t AS (SELECT quantile_cont(score, 0.9) AS t FROM s WHERE role = 'control') SELECT parcel_id, {r('score', 'score', 6)}, score > t AS flag FROM s, t WHERE role = 'screened' AND score IS NOT NULL", digits=6)
def eq_control_threshold(spark, sf_dir):
    s = read(spark, sf_dir, "customer").selectExpr("c_custkey AS parcel_id", "CASE WHEN c_custkey % 3 = 0 THEN 'control' ELSE 'screened' END AS role", "CASE WHEN c_custkey % 8 <> 0 THEN c_acctbal / 1000 END AS score")
    return rs.control_threshold(s)


FEATURES = ["log_area", "beds", "age", "is_twin", "is_detached"]
PLACES = [f"in_{k}" for k in range(1, 6)]


def _ols(source: str, key: str, columns: list[str], tag: str = "") -> str:
    """CTEs ending in ``fit{tag}``: ``source`` (key, learns, columns, log_price) with ``predicted`` by least squares.

    Every column is freed of those before it, from the constant on, with factors of the rows that learn; what is then
    left of the price is the error of the prediction.
    """
    left = ["one", *columns, "left_y"]
    parts = [f"z{tag}0 AS (SELECT *, 1.0 AS one, log_price AS left_y FROM {source})"]
    for i, v in enumerate(left[:-1]):
        others = left[i + 1 :]
        free = ", ".join(f"{o} - {v} * coalesce(sum({o} * {v}) FILTER (learns) OVER g / nullif(sum({v} * {v}) FILTER (learns) OVER g, 0), 0) AS {o}" for o in others)
        parts.append(f"z{tag}{i + 1} AS (SELECT * REPLACE ({free}) FROM z{tag}{i} WINDOW g AS (PARTITION BY {key}))")
    return ",\n".join([*parts, f"fit{tag} AS (SELECT *, log_price - left_y AS predicted FROM z{tag}{len(left) - 1})"])


_ROLL = f"""{D}, f AS (SELECT fold FROM (SELECT unnest(range(0, 4)) AS fold) WHERE fold + 3 > (SELECT min(period) FROM d)), u AS (SELECT d.*, fold, period < fold + 3 AS learns FROM d JOIN f ON period <= fold + 3),
{_ols("u", "fold", FEATURES)}, te AS (SELECT * FROM fit WHERE NOT learns)"""
_SUMMARY = f"SELECT count(*) AS folds, {r('avg(cod)', 'mean', 3)}, {r('stddev_pop(cod)', 'sd', 3)}, {r('min(cod)', 'min', 3)}, {r('max(cod)', 'max', 3)} FROM met"


@query(f"WITH {_ROLL}, p AS (SELECT fold, exp(predicted) AS est, sale_price AS sale, exp(predicted) / sale_price AS r FROM te), {_metrics('p', 'fold')} {_SUMMARY}", digits=3)
def eq_temporal_cv(spark, sf_dir):
    return rs.fold_summary(folds.rolling_folds(_sales(spark, sf_dir), "period", 3, 4, FEATURES), "fold").select("folds", "mean", "sd", "min", "max")


@query(
    f"""WITH {D}, g AS (SELECT district AS fold FROM d GROUP BY district HAVING count(*) >= 500), u AS (SELECT d.*, fold, district <> fold AS learns FROM d, g), {_ols("u", "fold", FEATURES)},
p AS (SELECT fold, exp(predicted) AS est, sale_price AS sale, exp(predicted) / sale_price AS r FROM fit WHERE NOT learns), {_metrics('p', 'fold')} {_SUMMARY}""",
    digits=3,
)
def eq_spatial_cv(spark, sf_dir):
    return rs.fold_summary(folds.left_out_folds(_sales(spark, sf_dir), "district", 500, FEATURES), "fold").select("folds", "mean", "sd", "min", "max")


_GAP = f"count(*) FILTER (minority) AS n_group, count(*) FILTER (NOT minority) AS n_rest, {r('median(predicted - log_price) FILTER (minority) - median(predicted - log_price) FILTER (NOT minority)', 'gap')}"


@query(f"WITH {_ROLL} SELECT CAST(fold AS INT) AS fold, {_GAP} FROM te GROUP BY fold")
def eq_gap_cv(spark, sf_dir):
    return rs.group_gap(folds.rolling_folds(_sales(spark, sf_dir), "period", 3, 4, FEATURES), ["fold"], "minority")


_MODELS = {"coarse": FEATURES, "rich": [*FEATURES, *PLACES, "context"]}


@query(
    f"WITH {D}, u AS (SELECT *, 1 AS k, period < 5 AS learns FROM d), {_ols('u', 'k', _MODELS['coarse'], 'a')}, {_ols('u', 'k', _MODELS['rich'], 'b')}, "
    + "x AS (SELECT 'coarse' AS model_, minority, predicted, log_price FROM fita WHERE NOT learns UNION ALL SELECT 'rich', minority, predicted, log_price FROM fitb WHERE NOT learns) "
    + f"SELECT model_ AS model, {_GAP} FROM x GROUP BY model_"
)
def eq_mechanism(spark, sf_dir):
    tested = folds.arms_by_features(_sales(spark, sf_dir).drop("model"), _MODELS, "period < 5", "period >= 5")
    return rs.group_gap(tested.withColumnRenamed("arm", "model"), ["model"], "minority")


_ARMS = {"retail": "NOT cash AND period < 5", "blend": "period < 5"}


# The sales of this study as those of the channel study, at the same prices.
_CHANNEL = {**CHANNEL_SALE, "sale_price": "o_totalprice"}
_FIFTH = "'q' || CAST(len(list_filter(c, lambda z: z <= sale_price)) + 1 AS VARCHAR)"


@query(
    f"WITH {D}, c AS (SELECT quantile_cont(sale_price, [0.2, 0.4, 0.6, 0.8]) AS c FROM d WHERE period >= 5), " + ", ".join(f"u_{a} AS (SELECT *, 1 AS k, {w} AS learns FROM d), {_ols(f'u_{a}', 'k', FEATURES, a)}" for a, w in _ARMS.items()) + ", te AS ("
    + " UNION ALL ".join(f"SELECT '{a}' AS arm, unnest(['overall', CASE WHEN coalesce(cash, true) THEN 'cash' ELSE 'financed' END, {_FIFTH}]) AS segment, exp(predicted) AS est, sale_price AS sale FROM fit{a}, c WHERE period >= 5" for a in _ARMS)
    + f"), p AS (SELECT *, est / sale AS r FROM te), {_metrics('p', 'arm, segment')}, f AS (SELECT arm, segment, {FIT} FROM p GROUP BY arm, segment), "
    + f"off AS (WITH {', '.join(staged_parts(_CHANNEL))} SELECT segment, exp(sum(c * y) / sum(c * c)) - 1 AS off FROM w7 GROUP BY segment), v AS (SELECT {_FIFTH} AS segment, coalesce(cash, true) AS cash, assessed, sale_price FROM d, c WHERE period >= 5), "
    + "o AS (SELECT segment, count(*) AS n, avg(CAST(cash AS INT)) AS s, median(assessed / sale_price) AS a, median(assessed / CASE WHEN cash THEN sale_price / (1 + coalesce(off, 0)) ELSE sale_price END) AS b FROM v LEFT JOIN off USING (segment) GROUP BY segment), "
    + f"z AS (SELECT unnest([{{arm: 'roll', m: a}}, {{arm: 'roll_retail', m: b}}]) AS u, segment, n, s FROM o) SELECT arm, segment, met.n, rmse_log, mape, r2_log, {_SHOW}, CAST(NULL AS DOUBLE) AS cash_share FROM met JOIN f USING (arm, segment) "
    + f"UNION ALL SELECT u.arm, segment, n, NULL, NULL, NULL, {r('u.m', 'median_ratio')}, NULL, NULL, NULL, NULL, {r('s', 'cash_share')} FROM z"
)
def eq_retail_vs_blend(spark, sf_dir):
    """Both arms by channel and price fifth; the roll by price fifth under both conventions."""
    d = _sales(spark, sf_dir)
    test = d.where("period >= 5")
    fifth = rs.price_fifth(test)
    tested = folds.arms_by_training(d, _ARMS, "period >= 5", FEATURES)
    channels = F.when(F.coalesce("cash", F.lit(True)), "cash").otherwise("financed")
    rows = tested.withColumns({"_e": F.exp("predicted"), "segment": F.explode(F.array(F.lit("overall"), channels, fifth))})
    arms = evaluate(clean_pairs(rows, "_e", "sale_price"), ["arm", "segment"])
    stages = channel.decompose(channel_sales(spark, sf_dir, _CHANNEL), *CHANNEL_INPUTS, draws=0)[0]
    discounts = {row["segment"]: row["cash_discount_pct"] for row in stages.where("stage = 'distress'").collect()}
    return arms.unionByName(rs.value_conventions(test.withColumn("segment", fifth), "assessed", discounts), allowMissingColumns=True)


_WITH = {"baseline": FEATURES, "with_context": [*FEATURES, "context"]}


@query(
    f"WITH {D}, u AS (SELECT *, 1 AS k, period < 5 AS learns FROM d), " + ", ".join(_ols("u", "k", c, a) for a, c in _WITH.items()) + ", te AS ("
    + " UNION ALL ".join(f"SELECT '{a}' AS arm, minority, exp(predicted) AS est, sale_price AS sale FROM fit{a} WHERE NOT learns" for a in _WITH)
    + f"), p AS (SELECT *, est / sale AS r FROM te), {_metrics('p', 'arm, minority')} SELECT arm, minority, n, {_SHOW} FROM met"
)
def eq_acs_sensitivity(spark, sf_dir):
    tested = folds.arms_by_features(_sales(spark, sf_dir), _WITH, "period < 5", "period >= 5").withColumn("_e", F.exp("predicted"))
    return ratio_metrics(clean_pairs(tested, "_e", "sale_price"), ["arm", "minority"])


@query(f"WITH {D}, u AS (SELECT *, 1 AS k, NOT cash AND period < 5 AS learns FROM d), {_ols('u', 'k', [*FEATURES, *PLACES])} SELECT sale_id, cash, {r('exp(predicted)', 'retail', 2)} FROM fit WHERE period >= 5", digits=2)
def mdl_retail(spark, sf_dir):
    """Every later sale at the level of the financed ones: the arm learns from these only."""
    tested = folds.arms_by_training(_sales(spark, sf_dir), {"retail": "NOT cash AND period < 5"}, "period >= 5", [*FEATURES, *PLACES])
    return tested.select("sale_id", "cash", F.exp("predicted").alias("retail"))


_NEWEST = "SELECT c_custkey AS parcel_id, y AS roll_year, 60000.0E0 + c_custkey % 89 * 1500 + y AS roll_value FROM customer, (SELECT unnest([1997, 1999]) AS y) WHERE c_custkey % 12 > 0"
_STEP = {
    "roll": (("assessed", "sale_price", 0), ("assessed", NOW, 1), ("fresh", NOW, 2), ("fresh", NOW, 4)),
    "model": (("exp(before - coalesce(time_adj_log, 0))", "sale_price", 0), ("exp(before)", NOW, 1), ("exp(within)", NOW, 3), ("exp(within)", NOW, 4)),
}
_CASES = " UNION ALL ".join(f"SELECT '{e}' AS estimator, '{rs.BRIDGE[k]}' AS step, {v} AS est, {p} AS sale, style, {k == 4} AS trim FROM w" for e, steps in _STEP.items() for v, p, k in steps)


@query(
    f"""WITH {D}, h AS (SELECT * REPLACE (log_price + coalesce(time_adj_log, 0) AS log_price) FROM d), ua AS (SELECT *, 1 AS k, period < 5 AS learns FROM h), {_ols('ua', 'k', [*FEATURES, *PLACES], 'a')}, ub AS (SELECT *, 1 AS k, true AS learns FROM h), {_ols('ub', 'k', [*FEATURES, *PLACES], 'b')},
w AS (SELECT fita.*, fita.predicted AS before, fitb.predicted AS within, roll_value AS fresh FROM fita JOIN fitb USING (sale_id) LEFT JOIN (SELECT * FROM ({_NEWEST}) WHERE roll_year = 1999) n ON n.parcel_id = fita.parcel_id WHERE fita.period >= 5),
c AS ({_CASES}), p AS (SELECT *, est / sale AS r FROM c WHERE est > 0 AND sale > 0), {_trim('p', 'estimator, step', 't')},
g AS (SELECT estimator, step, count(*) FILTER (trim AND outlier) AS n_trimmed FROM t GROUP BY ALL), x AS (SELECT *, unnest(list_filter(['overall', CASE WHEN trim THEN style END], lambda z: z IS NOT NULL)) AS segment FROM t WHERE NOT (trim AND outlier)),
{_metrics('x', 'estimator, step, segment')} SELECT estimator, step, segment, n, {_SHOW}, n_trimmed FROM met JOIN g USING (estimator, step) WHERE segment = 'overall' OR n >= 50"""
)
def eq_iaao_bridge(spark, sf_dir):
    d = _sales(spark, sf_dir).withColumn("log_price", F.col("log_price") + F.coalesce("time_adj_log", F.lit(0.0)))
    arms = folds.arms_by_training(d, {"before": "period < 5", "within": "true"}, "period >= 5", [*FEATURES, *PLACES])
    names = ["sale_id", "parcel_id", "sale_price", "time_adj_log", "style"]
    test = arms.groupBy(*names, F.col("assessed").alias("roll")).agg(*[F.max(F.when(F.col("arm") == a, F.col("predicted"))).alias(a) for a in ("before", "within")])
    c = read(spark, sf_dir, "customer").where("c_custkey % 12 > 0")
    rolls = c.selectExpr("c_custkey AS parcel_id", "explode(array(1997, 1999)) AS roll_year", "c_custkey % 89 AS m").selectExpr("parcel_id", "roll_year", "60000.0E0 + m * 1500 + roll_year AS roll_value")
    return rs.convention_ladder(rs.bridge_cases(test, rolls))
