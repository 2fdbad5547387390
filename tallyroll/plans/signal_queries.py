"""Signals from earlier transfers, event windows and price indexes, over orders and their lines."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.columns import block_id, project_x, project_y, quarter_number, recency_weight
from ..operators import events as ev
from ..operators import price_index, signals
from .adapters import EVENTS, SALES, _eq, events, read, sales
from .catalog import query, r

S = f"s AS ({SALES})"
E = f"e AS ({EVENTS})"
ASOF = "1999-01-01"
W = "(1.0 / (1.0 + exp({0} / 365.25 - 3.0)))"
NEAR = f"""near AS (SELECT a.sale_id, date_diff('day', b.sale_date, a.sale_date) AS age, b.sale_price AS price,
  CASE WHEN b.area BETWEEN 300 AND 10000 THEN b.sale_price / b.area END AS ppsf
  FROM s a JOIN s b ON a.block = b.block AND a.parcel_id <> b.parcel_id AND b.sale_date < a.sale_date AND date_diff('day', b.sale_date, a.sale_date) <= 1825)"""


@query(f"SELECT o_orderkey AS sale_id, concat(CAST(o_custkey % 90 AS VARCHAR), '_', CAST(CAST(floor(o_orderkey % 700 / 100) * 100 AS BIGINT) AS VARCHAR)) AS block FROM orders")
def mkt_block_id(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("sale_id"), block_id(F.col("o_custkey") % 90, F.col("o_orderkey") % 700).alias("block"))


@query(f"WITH {S} SELECT sale_id, {r(W.format('date_diff(' + chr(39) + 'day' + chr(39) + ', sale_date, DATE ' + chr(39) + '2002-01-01' + chr(39) + ')'), 'weight')} FROM s")
def mkt_recency_weight(spark, sf_dir):
    return sales(spark, sf_dir).select("sale_id", recency_weight(signals.days_since("2002-01-01", "sale_date")).alias("weight"))


@query(
    f"""SELECT c_custkey AS parcel_id, {r("((-75.3e0 + c_custkey % 500 / 1000.0e0) - -75.16e0) * (111320.0e0 * cos(radians(39.95e0)))", "x_m", 2)},
{r("((39.8e0 + c_custkey % 300 / 1000.0e0) - 39.95e0) * 110540.0e0", "y_m", 2)} FROM customer"""
)
def mkt_project_xy(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    lon, lat = -75.3 + F.col("c_custkey") % 500 / F.lit(1000.0), 39.8 + F.col("c_custkey") % 300 / F.lit(1000.0)
    return c.select(F.col("c_custkey").alias("parcel_id"), F.round(project_x(lon), 2).alias("x_m"), F.round(project_y(lat), 2).alias("y_m"))


@query(
    f"""WITH {S}, {NEAR}, m AS (SELECT sale_id, sum({W.format("age")} * price) / sum({W.format("age")}) AS p,
  sum({W.format("age")} * ppsf) / sum({W.format("age")}) FILTER (ppsf IS NOT NULL) AS q, count(*) AS n FROM near GROUP BY sale_id)
SELECT s.sale_id, {r("p", "block_price", 2)}, {r("q", "block_ppsf")}, coalesce(n, 0) AS block_n FROM s LEFT JOIN m USING (sale_id)"""
)
def mkt_block_roll(spark, sf_dir):
    return signals.block_roll(sales(spark, sf_dir)).withColumn("block_price", F.round("block_price", 2))


@query(
    f"""WITH {S}, {NEAR.replace("a.block = b.block", "floor(a.block / 4) = floor(b.block / 4)").replace("300 AND 10000", "150 AND 6000")}, m AS (SELECT sale_id, sum({W.format("age")} * price) / sum({W.format("age")}) AS p,
  sum({W.format("age")} * ppsf) / sum({W.format("age")}) FILTER (ppsf IS NOT NULL) AS q, count(*) AS n FROM near GROUP BY sale_id)
SELECT s.sale_id, {r("p", "bldg_price", 2)}, {r("q", "bldg_ppsf")}, coalesce(n, 0) AS bldg_n FROM s LEFT JOIN m USING (sale_id)"""
)
def mkt_bldg_roll(spark, sf_dir):
    rows = sales(spark, sf_dir).withColumn("building", F.floor(F.col("block") / 4))
    return signals.block_roll(rows, "building", "bldg", (150.0, 6_000.0)).withColumn("bldg_price", F.round("bldg_price", 2))


_AT = f"""seen AS (SELECT *, date_diff('day', sale_date, DATE '{ASOF}') AS age FROM s WHERE sale_date < DATE '{ASOF}' AND date_diff('day', sale_date, DATE '{ASOF}') <= 1825),
m AS (SELECT c.c_custkey AS parcel_id, sum({W.format("age")} * sale_price) / sum({W.format("age")}) AS p, count(sale_id) AS n
  FROM customer c LEFT JOIN seen ON floor(c.c_custkey / {{0}}) = floor(seen.parcel_id / {{0}}) AND seen.parcel_id <> c.c_custkey GROUP BY c.c_custkey)"""


@query(f"WITH {S}, {_AT.format(8)} SELECT parcel_id, {r('p', 'block_price', 2)}, n AS block_n FROM m")
def mkt_block_roll_at_date(spark, sf_dir):
    parcels = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("parcel_id"), F.floor(F.col("c_custkey") / 8).alias("block"))
    return signals.block_roll_at(sales(spark, sf_dir), parcels, ASOF).withColumn("block_price", F.round("block_price", 2))


@query(f"WITH {S}, {_AT.format(32)} SELECT parcel_id, {r('p', 'block_price', 2)}, n AS block_n FROM m")
def mkt_bldg_roll_at_date(spark, sf_dir):
    parcels = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("parcel_id"), F.floor(F.col("c_custkey") / 32).alias("building"))
    rows = sales(spark, sf_dir).withColumn("building", F.floor(F.col("block") / 4))
    return signals.block_roll_at(rows, parcels, ASOF, "building").withColumn("block_price", F.round("block_price", 2))


@query(
    f"""WITH {S}, p AS (SELECT a.sale_id, count(b.sale_id) AS n, max(b.sale_date) AS d, arg_max(b.sale_price, (b.sale_date, b.sale_id)) AS v, any_value(a.sale_date) AS d0
  FROM s a LEFT JOIN s b ON a.parcel_id = b.parcel_id AND b.sale_date < a.sale_date GROUP BY a.sale_id)
SELECT sale_id, n AS prior_n, date_diff('day', d, d0) AS prior_days, {r("v", "prior_price")} FROM p"""
)
def mkt_parcel_prior(spark, sf_dir):
    return signals.parcel_prior(sales(spark, sf_dir))


@query(
    f"""WITH {S} SELECT parcel_id, count(*) AS prior_n, date_diff('day', max(sale_date), DATE '{ASOF}') AS prior_days,
{r("arg_max(sale_price, (sale_date, sale_id))", "prior_price")} FROM s WHERE sale_date < DATE '{ASOF}' GROUP BY parcel_id"""
)
def mkt_parcel_prior_at_date(spark, sf_dir):
    return signals.parcel_prior_at(sales(spark, sf_dir), ASOF)


def _points(spark, sf_dir):
    return sales(spark, sf_dir).withColumns({"target_id": F.col("sale_id"), "evidence_id": F.col("sale_id"), "q": quarter_number("sale_date").cast("long"), "v": F.ln(F.col("sale_price") / F.col("area"))})


#: How far neighbours are sought first: some 120 points on average.  Targets short of neighbours look farther.
REACH_POINTS = 4.0e9


def _reach(spark, sf_dir) -> float:
    return float(math.ceil(math.sqrt(REACH_POINTS / max(1, read(spark, sf_dir, "orders").count()))))


# The k nearest at any distance: first how far the k-th is, then which they are, ties by id.
_D = "sqrt((a.x_m - b.x_m) ** 2 + (a.y_m - b.y_m) ** 2)"
_KNN = f"""m AS (SELECT a.sale_id AS target_id, list_max(min({_D}, {{1}})) AS far FROM p a JOIN p b ON a.parcel_id <> b.parcel_id AND {{0}} GROUP BY a.sale_id),
c AS (SELECT a.sale_id AS target_id, b.v, {_D} AS d, b.sale_id AS o FROM p a JOIN m ON m.target_id = a.sale_id JOIN p b ON a.parcel_id <> b.parcel_id AND {{0}} AND {_D} <= far),
k AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY d, o) AS n FROM c)"""
_FOUND = "SELECT target_id, sum(v / (d + 100)) / sum(1 / (d + 100)) AS val, count(*) AS cnt, avg(d) AS dist FROM k WHERE n <= {0} GROUP BY target_id"
_P = f"{S}, p AS (SELECT *, (year(sale_date) - 1997) * 4 + quarter(sale_date) - 1 AS q, ln(sale_price / area) AS v FROM s)"
_OUT = f"{r('val', 'knn_value')}, coalesce(cnt, 0) AS knn_n, {r('dist', 'knn_distance')}"


@query(f"WITH {_P}, {_KNN.format('b.q < a.q', 15)}, f AS ({_FOUND.format(15)}) SELECT sale_id AS target_id, {_OUT} FROM p LEFT JOIN f ON sale_id = target_id")
def mkt_knn_asof(spark, sf_dir):
    p = _points(spark, sf_dir)
    return signals.knn(p.select("target_id", "parcel_id", "x_m", "y_m", "q"), p, 15, _reach(spark, sf_dir) / 2, 2, "v", "q", widen=True)


@query(
    f"""WITH {_P}, {_KNN.format("b.area >= 1500 AND b.q < a.q", 10)}, f AS ({_FOUND.format(10)}) SELECT sale_id AS target_id, {_OUT} FROM p LEFT JOIN f ON sale_id = target_id"""
)
def mkt_newbuild_knn(spark, sf_dir):
    p = _points(spark, sf_dir)
    return signals.knn(p.select("target_id", "parcel_id", "x_m", "y_m", "q"), p.where("area >= 1500"), 10, _reach(spark, sf_dir) / 2, 2, "v", "q", widen=True)


@query(
    f"""WITH {_P}, c AS (SELECT t.c_custkey AS target_id, v, sqrt((CAST((c_custkey * 7919) % 10007 AS DOUBLE) - x_m) ** 2 + (CAST((c_custkey * 104729) % 10009 AS DOUBLE) - y_m) ** 2) AS d, sale_id AS o
  FROM customer t JOIN p ON parcel_id <> c_custkey AND sale_date < DATE '{ASOF}' AND date_diff('day', sale_date, DATE '{ASOF}') <= 1825),
k AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY d, o) AS n FROM c), f AS ({_FOUND.format(15)})
SELECT c_custkey AS target_id, {_OUT} FROM customer LEFT JOIN f ON c_custkey = target_id"""
)
def mkt_knn_at_date(spark, sf_dir):
    p = _points(spark, sf_dir)
    age = signals.days_since(ASOF, "sale_date")
    t = read(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS target_id", "c_custkey AS parcel_id", "CAST((c_custkey * 7919) % 10007 AS DOUBLE) AS x_m", "CAST((c_custkey * 104729) % 10009 AS DOUBLE) AS y_m"
    )
    return signals.knn(t, p.where((age > 0) & (age <= signals.WINDOW_DAYS)), 15, _reach(spark, sf_dir) / 2, 2, "v", widen=True)


_VALUES = "SELECT o_custkey AS parcel_id, CAST(year(o_orderdate) AS INT) AS year, max(o_totalprice) AS value FROM orders GROUP BY ALL"


@query(
    f"""WITH {S}, v AS ({_VALUES}), j AS (SELECT sale_id, a.value AS value_now, b.value AS value_before FROM s LEFT JOIN v a ON a.parcel_id = s.parcel_id AND a.year = year(sale_date)
  LEFT JOIN v b ON b.parcel_id = s.parcel_id AND b.year = year(sale_date) - 1)
SELECT sale_id, {r("value_now", "value_now")}, {r("value_before", "value_before")}, {r("CASE WHEN value_before > 0 THEN value_now / value_before - 1 END", "value_change")} FROM j"""
)
def mkt_join_assessment_year(spark, sf_dir):
    o = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("parcel_id"), F.year("o_orderdate").alias("year")).agg(F.max("o_totalprice").alias("value"))
    return signals.join_year(sales(spark, sf_dir), o).select("sale_id", "value_now", "value_before", "value_change")


@query(
    """WITH p AS (SELECT c_custkey AS id, CAST((c_custkey * 7919) % 10007 AS DOUBLE) AS x, CAST((c_custkey * 104729) % 10009 AS DOUBLE) AS y FROM customer)
SELECT a.id AS parcel_id, count(b.id) AS n FROM p a LEFT JOIN p b ON a.id <> b.id AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 160000 GROUP BY a.id"""
)
def geo_radius_count(spark, sf_dir):
    p = read(spark, sf_dir, "customer").selectExpr("c_custkey AS parcel_id", "CAST((c_custkey * 7919) % 10007 AS DOUBLE) AS x_m", "CAST((c_custkey * 104729) % 10009 AS DOUBLE) AS y_m")
    return signals.radius_count(p, 400.0)


RENO = "(lower(kind) LIKE '%alter%' OR lower(kind) = 'major' OR lower(kind) LIKE '%change of use%')"
BOTH = f"both_ AS (SELECT s.sale_id, s.sale_date, e.*, date_diff('day', issued, sale_date) AS age FROM s JOIN e ON s.parcel_id = e.parcel_id)"


@query(f"WITH {E} SELECT event_id, {RENO} AS is_reno FROM e")
def evt_reno_predicate(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", ev.is_renovation("kind").alias("is_reno"))


@query(
    f"""WITH {S}, {E}, {BOTH}, f AS (SELECT sale_id, count(*) FILTER (age <= 1825) AS n_all, count(*) FILTER (age <= 1825 AND {RENO}) AS n_reno,
  count(*) FILTER (age <= 1825 AND closed IS NOT NULL AND closed < sale_date) AS n_completed, min(age) AS since_any, min(age) FILTER ({RENO}) AS since_reno FROM both_ WHERE age > 0 GROUP BY sale_id)
SELECT s.sale_id, coalesce(n_all, 0) AS n_all, coalesce(n_reno, 0) AS n_reno, coalesce(n_completed, 0) AS n_completed, since_any, since_reno FROM s LEFT JOIN f USING (sale_id)"""
)
def evt_permits(spark, sf_dir):
    reno = ev.is_renovation("kind")
    flags = {"n_all": None, "n_reno": reno, "n_completed": F.col("closed") < F.col("sale_date")}
    return ev.before_anchor(sales(spark, sf_dir), events(spark, sf_dir), "issued", flags, {"since_any": None, "since_reno": reno})


@query(
    f"""WITH {S}, {E}, {BOTH}, f AS (SELECT sale_id, count(*) AS n_open, count(*) FILTER (severe) AS n_open_severe FROM both_ WHERE issued <= sale_date AND (closed IS NULL OR closed > sale_date) GROUP BY sale_id)
SELECT s.sale_id, coalesce(n_open, 0) AS n_open, coalesce(n_open_severe, 0) AS n_open_severe FROM s LEFT JOIN f USING (sale_id)"""
)
def evt_violations(spark, sf_dir):
    return ev.open_at_anchor(sales(spark, sf_dir), events(spark, sf_dir), "issued", "closed", {"n_open": None, "n_open_severe": F.col("severe")})


@query(
    f"""WITH {S}, {E}, {BOTH}, f AS (SELECT sale_id, count(*) AS n, min(age) AS d FROM both_ WHERE kind = 'Sign' AND age > 0 GROUP BY sale_id)
SELECT s.sale_id, coalesce(n, 0) AS n_before, d AS days_since FROM s LEFT JOIN f USING (sale_id)"""
)
def evt_demolitions(spark, sf_dir):
    signs = events(spark, sf_dir).where("kind = 'Sign'")
    return ev.before_anchor(sales(spark, sf_dir), signs, "issued", {"n_before": None}, {"days_since": None}, days=1_000_000)


@query(
    """WITH a AS (SELECT user_id * 100 + d AS sale_id, user_id, DATE '2024-01-05' + CAST(d AS INT) AS day FROM (SELECT DISTINCT user_id FROM events), (SELECT unnest(range(0, 25, 8)) AS d)),
b AS (SELECT sale_id, event_type, date_diff('day', CAST(ts AS DATE), day) AS age FROM a JOIN events USING (user_id)),
f AS (SELECT sale_id, count(*) FILTER (age <= 10) AS n_all, count(*) FILTER (age <= 10 AND event_type IN ('error', 'signup')) AS n_exterior, min(age) FILTER (event_type = 'error') AS since_error FROM b WHERE age > 0 GROUP BY sale_id)
SELECT a.sale_id, coalesce(n_all, 0) AS n_all, coalesce(n_exterior, 0) AS n_exterior, since_error FROM a LEFT JOIN f USING (sale_id)"""
)
def evt_complaints(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("parcel_id"), F.to_date("ts").alias("day"), "event_type")
    users = e.select("parcel_id").distinct().withColumn("d", F.explode(F.array(*[F.lit(x) for x in range(0, 25, 8)])))
    anchors = users.select((F.col("parcel_id") * 100 + F.col("d")).alias("sale_id"), "parcel_id", F.date_add(F.lit("2024-01-05").cast("date"), F.col("d")).alias("sale_date"))
    flags = {"n_all": None, "n_exterior": F.col("event_type").isin("error", "signup")}
    return ev.before_anchor(anchors, e, "day", flags, {"since_error": F.col("event_type") == "error"}, days=10)


SPANS = """spans AS (SELECT o_custkey AS parcel_id, CAST(o_orderdate AS DATE) AS start, CASE WHEN o_orderkey % 9 <> 0 THEN max(CAST(l_shipdate AS DATE)) END AS stop,
  o_orderkey % 3 = 0 AS owner_occupied, count(*) AS units FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey, o_orderdate)"""


@query(
    f"""WITH {S}, {SPANS}, f AS (SELECT sale_id, bool_or(owner_occupied) AS o, max(units) AS u, count(*) AS n FROM s JOIN spans USING (parcel_id) WHERE start <= sale_date AND (stop IS NULL OR stop > sale_date) GROUP BY sale_id)
SELECT s.sale_id, coalesce(o, false) AS any_owner, u AS units, coalesce(n, 0) AS spans FROM s LEFT JOIN f USING (sale_id)"""
)
def evt_rental_tenure(spark, sf_dir):
    both = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "lineitem"), _eq("o_orderkey", "l_orderkey"))
    spans = both.groupBy("o_orderkey", "o_custkey", "o_orderdate").agg(F.max(F.to_date("l_shipdate")).alias("last"), F.count(F.lit(1)).alias("units"))
    spans = spans.select(
        F.col("o_custkey").alias("parcel_id"), F.to_date("o_orderdate").alias("start"), F.when(F.col("o_orderkey") % 9 != 0, F.col("last")).alias("stop"),
        (F.col("o_orderkey") % 3 == 0).alias("owner_occupied"), "units",
    )
    return ev.covering_spans(sales(spark, sf_dir), spans)


@query(
    """WITH a AS (SELECT l_orderkey * 10 + l_linenumber AS parcel_id, year(l_shipdate) AS year, l_quantity AS amount FROM lineitem),
c AS (SELECT year, amount, count(*) AS n FROM a WHERE amount > 0 GROUP BY ALL), m AS (SELECT year, arg_max(amount, (n, amount)) AS mode_amount FROM c GROUP BY year)
SELECT year, mode_amount, count(*) AS n, count(*) FILTER (amount > 0 AND amount <= mode_amount) AS homesteads FROM a JOIN m USING (year) GROUP BY ALL"""
)
def evt_homestead_history(spark, sf_dir):
    a = read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("parcel_id"), F.year("l_shipdate").cast("long").alias("year"), F.col("l_quantity").alias("amount"))
    h = ev.homestead_history(a)
    return h.groupBy("year", "mode_amount").agg(F.count(F.lit(1)).alias("n"), F.count_if("homestead").alias("homesteads"))


@query(
    f"""WITH {S}, l AS (SELECT l_orderkey * 10 + l_linenumber AS loan_id, o_custkey AS parcel_id, CAST(l_shipdate AS DATE) AS loan_date FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
p AS (SELECT DISTINCT loan_id FROM l JOIN s ON l.parcel_id = s.parcel_id AND abs(date_diff('day', sale_date, loan_date)) <= 75)
SELECT year(loan_date) AS year, count(*) AS n, count(p.loan_id) AS purchases FROM (SELECT DISTINCT * FROM l) l LEFT JOIN p USING (loan_id) GROUP BY ALL"""
)
def evt_financing(spark, sf_dir):
    loans = events(spark, sf_dir).select(F.col("event_id").alias("loan_id"), "parcel_id", F.col("issued").alias("loan_date")).distinct()
    found = ev.financing(loans, sales(spark, sf_dir))
    return found.groupBy(F.year("loan_date").cast("long").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.count_if("is_purchase").alias("purchases"))


CHAIN = "chain AS (SELECT *, lag(sale_date) OVER w AS bought, lag(sale_price) OVER w AS paid, lead(sale_date) OVER w AS next_date, lead(sale_price) OVER w AS next_price FROM s WINDOW w AS (PARTITION BY parcel_id ORDER BY sale_date, sale_id))"


@query(
    f"""WITH {S}, {E}, {CHAIN}, h AS (SELECT *, date_diff('day', bought, sale_date) AS held FROM chain WHERE date_diff('day', bought, sale_date) BETWEEN 120 AND 1095),
f AS (SELECT sale_id, count(*) AS n, count(*) FILTER ({RENO}) AS nr, min(date_diff('day', bought, issued)) AS d1, min(date_diff('day', issued, sale_date)) AS d2, count(DISTINCT kind) AS k
  FROM h JOIN e ON h.parcel_id = e.parcel_id AND issued > bought AND issued < sale_date GROUP BY sale_id)
SELECT h.sale_id, held, {r("ln(sale_price) - ln(paid)", "log_gain")}, coalesce(n, 0) AS n_events, coalesce(nr, 0) AS n_reno, d1 AS days_to_first, d2 AS days_since_last, coalesce(k, 0) AS n_kinds,
coalesce(n, 0) >= 3 AS is_bundle FROM h LEFT JOIN f USING (sale_id)"""
)
def evt_episode_features(spark, sf_dir):
    return ev.episodes(sales(spark, sf_dir), events(spark, sf_dir), "kind")


@query(
    f"""WITH {S}, {CHAIN}, g AS (SELECT sale_id, ln(next_price) - ln(sale_price) AS log_gain FROM chain WHERE next_date < DATE '2000-06-01')
SELECT sale_id, {r("log_gain", "log_gain")}, CAST(log_gain >= ln(1.6) AS INT) AS label FROM g WHERE log_gain >= ln(1.6) OR abs(log_gain) <= ln(1.2)"""
)
def evt_recovery_labels(spark, sf_dir):
    return ev.recovery_labels(sales(spark, sf_dir), "2000-06-01")


@query(f"WITH {S} SELECT (year(sale_date) - 1997) * 4 + quarter(sale_date) - 1 AS q, count(*) AS n FROM s GROUP BY ALL")
def idx_quarter(spark, sf_dir):
    return sales(spark, sf_dir).groupBy(quarter_number("sale_date").cast("long").alias("q")).agg(F.count(F.lit(1)).alias("n"))


PAIR = f"""{CHAIN}, pr AS (SELECT *, date_diff('day', bought, sale_date) / 365.25 AS held, ln(sale_price) - ln(paid) AS dlog FROM chain WHERE bought IS NOT NULL),
pairs AS (SELECT * FROM pr WHERE held >= 0.49 AND abs(dlog / held) <= 0.35 AND bought >= DATE '1997-01-01')"""
CHEAP = S.replace("FROM orders", "FROM orders WHERE o_totalprice > 10000")


@query(
    f"""WITH {CHEAP}, {PAIR} SELECT sale_id, {r("held", "held")}, {r("dlog", "dlog")}, CAST((year(bought) - 1997) * 4 + quarter(bought) - 1 AS INT) AS q1,
CAST((year(sale_date) - 1997) * 4 + quarter(sale_date) - 1 AS INT) AS q2 FROM pairs"""
)
def idx_repeat_pairs(spark, sf_dir):
    return price_index.repeat_pairs(sales(spark, sf_dir)).select("sale_id", "held", "dlog", "q1", "q2")


def _nations(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("parcel_id"), "c_nationkey")
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("area"), F.col("n_regionkey").cast("string").alias("district"))
    return sales(spark, sf_dir).drop("area").join(c, "parcel_id").join(n, "c_nationkey").withColumn("v", F.ln("sale_price"))


@query()
def idx_bmn_curve(spark, sf_dir):
    pairs = price_index.repeat_pairs(_nations(spark, sf_dir))
    return price_index.repeat_curve(pairs, "district")


@query()
def idx_hierarchy(spark, sf_dir):
    return price_index.hierarchy(price_index.repeat_pairs(_nations(spark, sf_dir)), "area", "district", min_pairs=20)


GEO = "SELECT s.*, n_name AS nation, CAST(n_regionkey AS VARCHAR) AS district, ln(sale_price) AS v FROM s JOIN customer ON c_custkey = parcel_id JOIN nation ON n_nationkey = c_nationkey"
MED = f"""rows_ AS (SELECT district AS geo, CAST(date_trunc('month', sale_date) AS DATE) AS month, v FROM g),
city AS (SELECT month, median(v) AS c FROM rows_ GROUP BY month), cells AS (SELECT geo, month, median(v) AS o, count(*) AS n FROM rows_ GROUP BY ALL),
idx AS (SELECT geo, month, (coalesce(n, 0) * coalesce(o, 0) + 15 * c) / (coalesce(n, 0) + 15) AS log_index, coalesce(n, 0) AS n_sales
  FROM (SELECT DISTINCT geo FROM rows_) CROSS JOIN city LEFT JOIN cells USING (geo, month))"""
SMOOTH = "sm AS (SELECT geo, month, avg(log_index) OVER (PARTITION BY geo ORDER BY month ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS log_index, n_sales FROM idx)"
REF = """k AS (SELECT *, row_number() OVER (PARTITION BY geo ORDER BY month DESC) AS k FROM sm),
ref AS (SELECT geo, month, log_index - avg(log_index) FILTER (k <= 12) OVER (PARTITION BY geo) AS log_index, n_sales, max(month) OVER (PARTITION BY geo) AS ref_month FROM k)"""
BASE = f"WITH {S}, g AS ({GEO}), {MED}, {SMOOTH}, {REF}"
MONTH = "CAST(month AS VARCHAR) AS month"


def _index(spark, sf_dir, geo="district"):
    return price_index.median_index(_nations(spark, sf_dir), geo, "v")


@query(f"{BASE} SELECT geo, {MONTH}, {r('log_index', 'log_index')}, n_sales FROM idx")
def idx_median_fallback(spark, sf_dir):
    return _index(spark, sf_dir).withColumn("month", F.col("month").cast("string"))


@query(f"{BASE} SELECT geo, {MONTH}, {r('log_index', 'log_index')}, n_sales FROM sm")
def idx_smooth(spark, sf_dir):
    return price_index.smooth(_index(spark, sf_dir)).withColumn("month", F.col("month").cast("string"))


@query(f"{BASE} SELECT geo, {MONTH}, {r('log_index', 'log_index')}, n_sales, CAST(ref_month AS VARCHAR) AS ref_month FROM ref")
def idx_reference(spark, sf_dir):
    out = price_index.reference(price_index.smooth(_index(spark, sf_dir)))
    return out.withColumns({c: F.col(c).cast("string") for c in ("month", "ref_month")})


@query(f"WITH {S}, g AS ({GEO}) SELECT nation AS geo, count(*) AS n_sales FROM g GROUP BY ALL UNION ALL SELECT district, count(*) FROM g GROUP BY ALL")
def idx_support(spark, sf_dir):
    g = _nations(spark, sf_dir)
    return g.groupBy(F.col("area").alias("geo")).agg(F.count(F.lit(1)).alias("n_sales")).unionByName(g.groupBy(F.col("district").alias("geo")).agg(F.count(F.lit(1)).alias("n_sales")))


_BY_AREA = MED.replace("SELECT district AS geo", "SELECT nation AS geo")
_TWO = f"""WITH {S}, g AS ({GEO}), {MED.replace("idx AS", "di AS")}, {_BY_AREA.replace("rows_", "rows2").replace("city", "city2").replace("cells", "cells2").replace("idx AS", "ai AS")},
two AS (SELECT geo, month, log_index FROM di UNION ALL SELECT geo, month, log_index FROM ai)"""


@query(
    f"""{_TWO}, e AS (SELECT max(month) AS m FROM two), link AS (SELECT n_name AS geo, CAST(n_regionkey AS VARCHAR) AS d FROM nation)
SELECT two.geo, CAST(two.month AS VARCHAR) AS month, {r("CASE WHEN two.month >= (SELECT m - INTERVAL 11 MONTH FROM e) AND b.log_index IS NOT NULL THEN b.log_index ELSE two.log_index END", "log_index")}
FROM two LEFT JOIN link USING (geo) LEFT JOIN two b ON b.geo = link.d AND b.month = two.month"""
)
def idx_snap_tail(spark, sf_dir):
    both = _index(spark, sf_dir).unionByName(_index(spark, sf_dir, "area")).select("geo", "month", "log_index")
    link = read(spark, sf_dir, "nation").select(F.col("n_name").alias("area"), F.col("n_regionkey").cast("string").alias("district"))
    return price_index.snap_tail(both, link).withColumn("month", F.col("month").cast("string"))


@query(
    f"""{_TWO}, t AS (SELECT sale_id, least(greatest(CAST(date_trunc('month', sale_date) AS DATE), (SELECT min(month) FROM two)), (SELECT max(month) FROM two)) AS m, nation, district FROM g)
SELECT sale_id, {r("-coalesce(a.log_index, b.log_index, 0)", "time_adj_log")} FROM t LEFT JOIN ai a ON a.geo = nation AND a.month = m AND nation <> 'NATION_3' LEFT JOIN di b ON b.geo = district AND b.month = m"""
)
def idx_time_adjust(spark, sf_dir):
    index = _index(spark, sf_dir).unionByName(_index(spark, sf_dir, "area").where("geo <> 'NATION_3'"))
    return price_index.time_adjust(_nations(spark, sf_dir), index, ["area", "district"]).select("sale_id", "time_adj_log")
