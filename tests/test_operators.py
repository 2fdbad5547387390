"""Operators on small hand-made rows: nulls, ties, edges, leakage."""

import datetime as dt
import math

from pyspark.sql import functions as F

from tallyroll.functions import characteristics as ch
from tallyroll.functions.columns import block_id, entity_flag, related_parties
from tallyroll.operators import events, intervals, price_index, ratio, screen, signals, staging, validity

D = dt.date
SALE = "sale_id long, parcel_id long, block string, sale_date date, sale_price double, area double, x_m double, y_m double"


def test_resale_flags_follow_the_chain(spark):
    rows = [
        (1, "p", True, D(2020, 1, 1), 100.0), (2, "p", True, D(2020, 6, 1), 100.0), (3, "p", True, D(2020, 9, 1), 250.0),
        (4, "p", True, None, 90.0), (5, "p", True, D(2020, 10, 1), 1.0), (6, None, False, D(2020, 1, 1), 50.0), (7, "q", True, D(2021, 1, 1), None),
    ]
    df = spark.createDataFrame(rows, "record_id long, opa_account_num string, has_opa_link boolean, sale_date date, sale_price double")
    got = {r["record_id"]: (r["days_since_prev"], r["dup_price_within_year"], r["rapid_price_swing"]) for r in validity.resale_flags(df).collect()}
    assert got[1] == (None, False, False) and got[2] == (152, True, False) and got[3] == (92, False, True)
    assert all(got[i] == (None, False, False) for i in (4, 5, 6, 7))


def test_parties(spark):
    rows = [("SMITH JOHN", "Jane Smith", True), ("ACME HOLDINGS LLC", "BETA HOLDINGS LLC", False), (None, "x", False), ("Li Wu", "Li Wu", False)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    assert all(r[0] == r[1] for r in df.select(related_parties("a", "b"), "want").collect())
    assert [r[0] for r in df.select(entity_flag("a")).collect()] == [False, True, False, False]


def test_block_id_is_null_safe(spark):
    df = spark.createDataFrame([("12345", 187), (None, 1), ("9", None)], "s string, h int")
    assert [r[0] for r in df.select(block_id("s", "h")).collect()] == ["12345_100", None, None]


def test_block_roll_never_looks_ahead(spark):
    rows = [
        (1, 1, "b", D(2020, 1, 1), 100.0, 1000.0, 0.0, 0.0), (2, 2, "b", D(2020, 1, 1), 300.0, 1000.0, 0.0, 0.0),
        (3, 1, "b", D(2021, 1, 1), 500.0, 1000.0, 0.0, 0.0), (4, 3, None, D(2021, 1, 1), 1.0, 1.0, 0.0, 0.0), (5, 4, "b", D(2030, 1, 1), 9.0, 50.0, 0.0, 0.0),
    ]
    got = {r["sale_id"]: (r["block_n"], r["block_price"]) for r in signals.block_roll(spark.createDataFrame(rows, SALE)).collect()}
    assert got[1] == got[2] == (0, None) and got[3] == (1, 300.0) and got[4] == (0, None) and got[5] == (0, None)


def test_block_roll_at_a_date_is_the_self_join(spark):
    rows = [(i, i % 5, f"b{i % 2}", D(2019, 1 + i % 12, 1), 100.0 + i, 1000.0, 0.0, 0.0) for i in range(40)]
    sales = spark.createDataFrame(rows, SALE)
    day = D(2020, 6, 1)
    parcels = spark.createDataFrame([(p, b) for p in range(6) for b in ("b0", "b1")], "parcel_id long, block string").where("parcel_id % 2 = cast(substring(block, 2, 1) as int)")
    got = {r["parcel_id"]: (r["block_n"], r["block_price"]) for r in signals.block_roll_at(sales.withColumn("block", F.concat(F.lit("b"), (F.col("parcel_id") % 2).cast("string"))), parcels, "2020-06-01").collect()}
    for p in range(5):
        peers = [(r[4], (day - r[3]).days) for r in rows if r[1] % 2 == p % 2 and r[1] != p]
        w = [1 / (1 + math.exp(d / 365.25 - 3)) for _, d in peers]
        assert got[p][0] == len(peers) and abs(got[p][1] - sum(a * b for (a, _), b in zip(peers, w)) / sum(w)) < 1e-6


def test_events_on_the_anchor_day_do_not_count(spark):
    anchors = spark.createDataFrame([(1, 7, D(2020, 1, 10)), (2, 8, D(2020, 1, 10))], "sale_id long, parcel_id long, sale_date date")
    e = spark.createDataFrame([(7, D(2020, 1, 10), None), (7, D(2020, 1, 9), D(2020, 1, 10)), (7, D(2014, 1, 1), D(2014, 2, 1)), (7, D(2021, 1, 1), None)], "parcel_id long, issued date, closed date")
    got = {r["sale_id"]: (r["n"], r["since"]) for r in events.before_anchor(anchors, e, "issued", {"n": None}, {"since": None}).collect()}
    assert got == {1: (1, 1), 2: (0, None)}
    got = {r["sale_id"]: r["n"] for r in events.open_at_anchor(anchors, e, "issued", "closed", {"n": None}).collect()}
    assert got == {1: 1, 2: 0}


def test_knn_leaves_out_the_own_parcel_and_the_future(spark):
    t = spark.createDataFrame([(1, 1, 0.0, 0.0, 5), (2, 2, 5000.0, 0.0, 5)], "target_id long, parcel_id long, x_m double, y_m double, q int")
    e = spark.createDataFrame([(10, 1, 1.0, 0.0, 1, 9.0), (11, 3, 50.0, 0.0, 4, 2.0), (12, 3, 60.0, 0.0, 5, 7.0), (13, 4, 150.0, 0.0, 2, 4.0)], "evidence_id long, parcel_id long, x_m double, y_m double, q int, v double")
    got = {r["target_id"]: r for r in signals.knn(t, e, 2, 100.0, 2, "v", "q").collect()}
    want = (2.0 / 150 + 4.0 / 250) / (1 / 150 + 1 / 250)
    assert got[1]["knn_n"] == 2 and abs(got[1]["knn_value"] - want) < 1e-12 and got[2]["knn_n"] == 0


def test_repeat_sales_recover_a_planted_drift(spark):
    rows, i = [], 0
    for p in range(300):
        for k, year in enumerate((1998 + p % 7, 2005 + p % 6)):
            day = D(year, 1 + 3 * ((p // 5 if k else p // 7) % 4), 15)
            q = (day.year - 1997) * 4 + (day.month - 1) // 3
            rows.append((i, p, "b", day, 100_000 * (1 + p % 7) * math.exp(0.01 * q), 1.0, 0.0, 0.0))
            i += 1
    pairs = price_index.repeat_pairs(spark.createDataFrame(rows, SALE))
    curve = {r["quarter"]: r["log_index"] for r in price_index.repeat_curve(pairs.withColumn("g", F.lit("all")), "g").collect()}
    assert abs(curve[47] - curve[15] - 0.32) < 1e-6
    deep = price_index.hierarchy(pairs.withColumns({"a": (F.col("parcel_id") % 2).cast("string"), "d": F.lit("d")}), "a", "d", 100)
    assert {r["geo"] for r in deep.select("geo").distinct().collect()} == {"__city__", "d", "0", "1"}


def test_ratio_metrics_of_equal_ratios(spark):
    df = spark.createDataFrame([("a", 90.0 * k, 100.0 * k) for k in range(1, 31)] + [("b", 1.0, 2.0), ("b", float("nan"), 1.0), ("b", -1.0, 1.0), ("b", None, 1.0)], "g string, e double, s double")
    pairs = ratio.clean_pairs(df, "e", "s")
    got = {r["g"]: r for r in ratio.ratio_metrics(pairs, ["g"]).collect()}
    assert abs(got["a"]["median_ratio"] - 0.9) < 1e-12 and abs(got["a"]["cod"]) < 1e-9 and abs(got["a"]["prd"] - 1) < 1e-12 and abs(got["a"]["mki"] - 1) < 1e-12
    assert got["b"]["n"] == 1 and got["b"]["cod"] is None
    vei = {r["g"]: r for r in ratio.vertical_equity(pairs, ["g"]).collect()}
    assert vei["a"]["verdict"] == "acceptable" and vei["a"]["n_groups"] == 2 and vei["b"]["verdict"] == "insufficient_sample"


def test_vertical_equity_finds_regressivity(spark):
    df = spark.createDataFrame([("a", 130.0 + 60 * k, 100.0 * k) for k in range(1, 61)], "g string, e double, s double")
    r = ratio.vertical_equity(ratio.clean_pairs(df, "e", "s"), ["g"]).first()
    assert r["vei"] < -10 and r["n_groups"] == 4


def test_timestamps_and_years(spark):
    rows = [(1, "2023-05-01T00:00:00Z", "1750"), (2, None, "0"), (3, "garbage", None), (4, "206-04-22T04:56:02Z", "196Y"), (5, "2023-05-01T00:00:00Z", "2028")]
    df = spark.createDataFrame(rows, "i int, t string, y string")
    assert [r["t_status"] for r in staging.parsed_timestamp(df, "t").orderBy("i").collect()] == ["ok", "missing", "invalid", "implausible", "ok"]
    assert [r["y_status"] for r in staging.parsed_year(df, "y").orderBy("i").collect()] == ["ok", "implausible", "missing", "invalid", "ok"]


def test_snapshot_diff(spark):
    old = spark.createDataFrame([("1", 10.0, "x"), ("2", None, "x"), ("3", 5.0, None), (None, 1.0, "x"), ("4", 1.0, "x")], "k string, v double, s string")
    new = spark.createDataFrame([("1", 12.0, "x"), ("2", 7.0, "x"), ("3", 5.0, None), ("5", 1.0, "x")], "k string, v double, s string")
    got = {r["column"]: r for r in staging.diff_snapshot(old, new, ["k"], ["v", "s"]).collect()}
    assert got["v"]["n_changed"] == 2 and got["v"]["median_delta"] == 2.0 and got["s"]["n_changed"] == 0
    assert (got["v"]["n_added"], got["v"]["n_removed"], got["v"]["n_changed_rows"]) == (1, 1, 2)


def test_conformal_offsets(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(39)] + [("b", 1.0)], "g string, e double")
    got = {r["g"]: r for r in intervals.split_quantiles(df, "e", ["g"]).collect()}
    assert (got["a"]["lo"], got["a"]["hi"]) == (1.0, 37.0) and got["b"]["lo"] == -math.inf and got["b"]["hi"] == math.inf


def test_time_split_sizes(spark):
    df = spark.createDataFrame([(i, D(2020, 1, 1 + i // 10)) for i in range(200)], "k long, d date")
    n = {r["split"]: r["count"] for r in intervals.time_split(df, "d", "k").groupBy("split").count().collect()}
    assert n == {"test": 20, "validation": 18, "fit": 162}


def test_style_era_and_evidence(spark):
    df = spark.createDataFrame([("ROW X", 1899, 0), (None, None, None), ("SEMI", 1999, 3), ("CAPE", 2010, -1), ("LOFT", 1900, 1)], "t string, y int, n int")
    assert [r[0] for r in df.select(ch.style("t")).collect()] == ["row", "unknown", "twin", "detached", "other"]
    assert [r[0] for r in df.select(ch.era("y")).collect()] == ["pre1900", "unknown", "1980s_90s", "2010plus", "1900s"]
    got = [r[0] for r in df.select(ch.noisy_or(ch.saturating("n"), ch.presence("n") * 0.5)).collect()]
    assert got[0] == got[1] == got[3] == 0 and abs(got[4] - (1 - math.exp(-1) * 0.5)) < 1e-12


def test_screen_flags(spark):
    cols = "parcel_id string, opa_market_value double, pred_point_calibrated double, model_median double, model_pi_low_90 double, model_pi_high_90 double, conformal_pi_low_90 double, conformal_pi_high_90 double, char_livable_area double, char_year_built int, valuation_year int, record_quality_low boolean"
    row = lambda i, v, **k: tuple({"i": i, "v": v, "p": 100.0, "m": 100.0, "lo": 70.0, "hi": 140.0, "cl": 75.0, "ch": 150.0, "a": 1000.0, "y": 1950, "t": 2026, "q": False, **k}.values())
    rows = [row("over", 160.0), row("disputed", 145.0), row("new", 160.0, y=2025), row("under", 60.0), row("none", None), row("noarea", 160.0, a=0.0), row("noconf", 145.0, cl=None, ch=None)]
    got = {r["parcel_id"]: r for r in screen.finalize(spark.createDataFrame(rows, cols)).collect()}
    assert {k: r["assessment_flag"] for k, r in got.items()} == {
        "over": "over", "disputed": "within_range", "new": "within_range", "under": "under", "none": "no_assessment", "noarea": "insufficient_data", "noconf": "over",
    }
    assert got["new"]["attention"] == "high" and got["noarea"]["display_ratio"] is None


def test_histogram_bins_are_as_wide_as_the_decimals_say(spark):
    edges = [0.45, 0.65, 0.7, 0.8, 0.9, 1.0, 1.6]  # (x - 0.4) / (1.2 / 24) is whole or more, (x - 0.4) / ((1.6 - 0.4) / 24) less
    at = lambda width: [min(math.floor((x - 0.4) / width), 23) for x in edges]
    got = screen.histogram(spark.createDataFrame([(x,) for x in edges], "x double"), "x", 0.4, 1.6, 24, ["x"]).collect()
    assert [r["bin"] for r in sorted(got)] == at(1.2 / 24) != at((1.6 - 0.4) / 24)
