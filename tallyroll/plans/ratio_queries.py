"""Ratio-study statistics over (assessed, sale) pairs by brand or return flag."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ratio
from .adapters import PAIRS, pairs
from .catalog import query, r

EDGES = [5_000.0, 20_000.0, 40_000.0, 70_000.0]
CLEAN = f"clean AS (SELECT brand, flag, line, est, price AS sale, est / price AS r FROM ({PAIRS}) WHERE est > 0 AND price > 0)"
LEVEL = "lv AS (SELECT brand, median(r) AS m, count(*) AS n FROM clean GROUP BY brand)"


def _clean(spark, sf_dir):
    return ratio.clean_pairs(pairs(spark, sf_dir), "est", "price").select("brand", "flag", "line", "est", "sale", "r")


FIT = f"""count(*) AS n, {r("sqrt(avg((ln(est) - ln(sale)) ** 2))", "rmse_log")}, {r("avg(abs(est - sale) / sale)", "mape")},
  {r("1 - sum((ln(est) - ln(sale)) ** 2) / nullif(var_pop(ln(sale)) * count(*), 0)", "r2_log")}"""


@query(f"WITH {CLEAN} SELECT brand, {FIT} FROM clean GROUP BY brand")
def met_fit(spark, sf_dir):
    return ratio.fit_metrics(_clean(spark, sf_dir), ["brand"])


RATIO = f"""{CLEAN}, {LEVEL},
ranked AS (SELECT clean.*, m, row_number() OVER (PARTITION BY brand ORDER BY sale, est) AS k FROM clean JOIN lv USING (brand)),
met AS (SELECT brand, count(*) AS n, max(m) AS median_ratio, 100 * avg(abs(r - m)) / max(m) AS cod, avg(r) / (sum(est) / sum(sale)) AS prd,
  regr_slope((r - m) / m, ln((sale + est / m) / 2) / ln(2)) AS prb,
  (2 * sum(k * est) / (count(*) * sum(est)) - (count(*) + 1) / count(*)) / (2 * sum(k * sale) / (count(*) * sum(sale)) - (count(*) + 1) / count(*)) AS mki
  FROM ranked GROUP BY brand)"""


@query(f"WITH {RATIO} SELECT brand, n, {r('median_ratio', 'median_ratio')}, {r('cod', 'cod')}, {r('prd', 'prd')}, {r('prb', 'prb')}, {r('mki', 'mki')} FROM met")
def met_ratio(spark, sf_dir):
    return ratio.ratio_metrics(_clean(spark, sf_dir), ["brand"])


VEI = f"""WITH {CLEAN}, {LEVEL},
a AS (SELECT clean.*, m, n, CASE WHEN n < 20 THEN 0 WHEN n <= 50 THEN 2 WHEN n <= 500 THEN 4 ELSE 10 END AS gn, 0.5 * sale + 0.5 * (est / m) AS proxy FROM clean JOIN lv USING (brand)),
b AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY brand ORDER BY proxy, est, sale) - 1) * gn / n) AS INT) AS g FROM a WHERE gn > 0),
c AS (SELECT *, row_number() OVER (PARTITION BY brand, g ORDER BY r) - 1 AS k, count(*) OVER (PARTITION BY brand, g) AS s FROM b),
d AS (SELECT *, ceil(1.64 * sqrt(s) / 2 + CASE WHEN s % 2 = 0 THEN 0.5 ELSE 0 END) AS o, floor(s / 2) AS h FROM c),
e AS (SELECT brand, g, max(m) AS m, max(n) AS n, max(gn) AS gn, median(r) AS med, min(r) FILTER (k = greatest(0, h - o)) AS lo,
  min(r) FILTER (k = least(s - 1, CASE WHEN s % 2 = 1 THEN h + o ELSE h - 1 + o END)) AS hi FROM d GROUP BY brand, g),
f AS (SELECT brand, max(m) AS m, max(gn) AS n_groups, max(med) FILTER (g = 0) AS m0, max(lo) FILTER (g = 0) AS l0, max(hi) FILTER (g = 0) AS h0,
  max(med) FILTER (g = gn - 1) AS m1, max(lo) FILTER (g = gn - 1) AS l1, max(hi) FILTER (g = gn - 1) AS h1 FROM e GROUP BY brand),
v AS (SELECT *, 100 * (m1 - m0) / m AS vei, 100 * (CASE WHEN m1 >= m0 THEN l1 - h0 ELSE l0 - h1 END) / m AS gap FROM f),
w AS (SELECT *, CASE WHEN abs(vei) > 10 AND gap > 0 THEN gap END AS significance FROM v)
SELECT lv.brand, lv.n, coalesce(n_groups, 0) AS n_groups, {r("vei", "vei")}, {r("significance", "significance")},
  CASE WHEN w.brand IS NULL THEN 'insufficient_sample' WHEN significance > 10 THEN 'unacceptable' ELSE 'acceptable' END AS verdict
FROM lv LEFT JOIN w USING (brand)"""


@query(VEI)
def met_vei(spark, sf_dir):
    return ratio.vertical_equity(_clean(spark, sf_dir), ["brand"])


@query(
    f"""WITH {CLEAN}, q AS (SELECT brand, quantile_cont(r, 0.25) AS q1, quantile_cont(r, 0.75) AS q3 FROM clean GROUP BY brand)
SELECT brand, count(*) AS n, count(*) FILTER (r < q1 - 0.5 * (q3 - q1) OR r > q3 + 0.5 * (q3 - q1)) AS outliers FROM clean JOIN q USING (brand) GROUP BY brand"""
)
def met_iqr_trim(spark, sf_dir):
    trimmed = ratio.iqr_trim(_clean(spark, sf_dir), ["brand"], 0.5)
    return trimmed.groupBy("brand").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_outlier").alias("outliers"))


@query(
    f"""WITH {CLEAN}, s AS (SELECT *, unnest(['overall', 'category:' || flag, 'fifth:' || CAST(1 + {" + ".join(f"CAST(sale >= {e} AS INT)" for e in EDGES)} AS VARCHAR)]) AS segment FROM clean)
SELECT segment, {FIT} FROM s GROUP BY segment"""
)
def met_segments(spark, sf_dir):
    return ratio.fit_metrics(ratio.segments(_clean(spark, sf_dir), "flag", EDGES), ["segment"])


@query(
    f"""WITH {CLEAN}, q AS (SELECT brand, quantile_cont(sale, 0.2) AS lo, quantile_cont(sale, 0.8) AS hi FROM clean GROUP BY brand)
SELECT brand, {r("median(r) FILTER (sale <= lo)", "q1_median")}, {r("median(r) FILTER (sale >= hi)", "q5_median")} FROM clean JOIN q USING (brand) GROUP BY brand"""
)
def met_q1q5(spark, sf_dir):
    return ratio.ends_by(_clean(spark, sf_dir), "sale", ["brand"])


@query(
    f"""WITH {CLEAN}, t AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY brand ORDER BY sale, est) - 1) * 5 / count(*) OVER (PARTITION BY brand)) + 1 AS INT) AS tier FROM clean),
g AS (SELECT brand, tier, count(*) AS n, sum(est) AS a, sum(sale) AS v FROM t GROUP BY brand, tier),
o AS (SELECT *, a / sum(a) OVER (PARTITION BY brand) - v / sum(v) OVER (PARTITION BY brand) AS over_share FROM g)
SELECT brand, tier, n, {r("over_share", "over_share")}, {r("sum(over_share) FILTER (tier <= 2) OVER (PARTITION BY brand)", "bottom40_over_share")} FROM o"""
)
def met_tier_redistribution(spark, sf_dir):
    return ratio.tier_redistribution(_clean(spark, sf_dir), "est", "sale", ["brand"])


@query(
    f"""WITH {CLEAN} SELECT brand, count(*) AS n, {r("avg(CASE WHEN sale BETWEEN est * 0.8 AND est * 1.25 THEN 1.0 ELSE 0.0 END)", "coverage")},
{r("median(est * 1.25 / (est * 0.8))", "median_spread")}, {r("avg((est * 1.25 - est * 0.8) / sale)", "mean_width")} FROM clean GROUP BY brand"""
)
def met_interval_row(spark, sf_dir):
    df = _clean(spark, sf_dir).withColumns({"lo": F.col("est") * 0.8, "hi": F.col("est") * 1.25})
    return ratio.interval_row(df, "lo", "hi", "sale", ["brand"])


_DIRECTION = {"median_ratio": 1, "cod": 0, "prd": 1, "prb": 0, "mki": 1}
_NEAR = {c: f"coalesce(abs(a.{c} - {v}) < abs(b.{c} - {v}), false)" for c, v in _DIRECTION.items()}


@query(
    f"""WITH {RATIO.replace("WHERE est > 0", "WHERE flag = 'A' AND est > 0")}, a AS (SELECT * FROM met),
{RATIO.replace("WHERE est > 0", "WHERE flag = 'R' AND est > 0").replace("clean", "clean2").replace("lv", "lv2").replace("ranked", "ranked2").replace("met AS", "met2 AS")}, b AS (SELECT * FROM met2)
SELECT a.brand, {", ".join(f"{x} AS {c}_a_nearer" for c, x in _NEAR.items())},
CASE {" + ".join(f"CAST({x} AS INT)" for x in _NEAR.values())} WHEN 5 THEN 'a' WHEN 0 THEN 'b' ELSE 'mixed' END AS verdict FROM a JOIN b USING (brand)"""
)
def met_benchmark_direction(spark, sf_dir):
    rows = _clean(spark, sf_dir)
    arms = [ratio.ratio_metrics(rows.where(F.col("flag") == f), ["brand"]) for f in "AR"]
    return ratio.benchmark_direction(*arms, ["brand"])
