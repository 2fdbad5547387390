"""Scores and ranks that SQL does not say, against numpy; the published example of vertical equity; keys of any name."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyroll.operators import crossfit, intervals, ranks, ratio, scoring
from tallyroll.plans import all_queries, crossfit_queries, mart_queries

SF = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"
# The 54 sales of the standard's worked example, (assessed, sale price) in thousands.
EXAMPLE = [
    (240, 690), (144, 296.25), (392, 787.5), (199.2, 372), (340.8, 574.5), (472, 795), (336, 559.5), (284.8, 465), (436, 693.6),
    (191.2, 298.5), (225, 350), (194, 295), (481.6, 732), (338.4, 495), (164.8, 237), (252.8, 352.5), (945, 1289), (280, 379),
    (407, 540), (423, 560), (306.8, 390), (236.8, 300), (361, 450), (290.4, 345), (235.2, 277.5), (415, 485), (381, 442),
    (380, 435), (875, 998), (680, 772.5), (329, 365), (457, 487), (516, 547.5), (295.2, 300), (580, 580), (840, 840),
    (640, 622.5), (660, 637.5), (354, 340), (800, 750), (390, 352.5), (800, 705), (469, 410), (1000, 859.5), (920, 787.5),
    (527, 440), (800, 648), (786, 630), (496, 388.5), (1000, 765), (320, 243.75), (960, 720), (952, 705), (327.2, 240),
]


@pytest.mark.parametrize("key", ["g", "m", "n", "k", "rank", "proxy", "size", "g_n", "a", "v", "r1"])
def test_keys_of_any_name(spark, key):
    rows = [("x", float(a), float(s)) for a, s in EXAMPLE] + [(None, 10.0 + i, 10.0) for i in range(5)]
    pairs = ratio.clean_pairs(spark.createDataFrame(rows, f"{key} string, av double, price double"), "av", "price")
    if key != "n":  # the result's own names are taken
        met = {r[key]: r for r in ratio.ratio_metrics(pairs, [key]).collect()}
        assert met["x"]["n"] == 54 and met[None]["n"] == 5
        vei = {r[key]: r for r in ratio.vertical_equity(pairs, [key]).collect()}
        assert vei["x"]["vei"] == pytest.approx(50.12, abs=0.25) and vei["x"]["significance"] == pytest.approx(17.51, abs=0.25)
        assert vei["x"]["verdict"] == "unacceptable" and vei[None]["verdict"] == "insufficient_sample"
        assert ratio.tier_redistribution(pairs, "av", "price", [key]).count() == 10


def test_ratio_metrics_of_all_rows(spark):
    pairs = ratio.clean_pairs(spark.createDataFrame([(float(a), float(s)) for a, s in EXAMPLE], "av double, price double"), "av", "price")
    assert ratio.ratio_metrics(pairs, []).first()["n"] == 54
    assert ratio.vertical_equity(pairs, []).first()["verdict"] == "unacceptable"


@pytest.mark.parametrize("few", [ranks.FEW, 3])
def test_kth_is_the_sorted_one(spark, monkeypatch, few):
    monkeypatch.setattr(ranks, "FEW", few)
    rng = np.random.default_rng(0)
    x = np.concatenate((rng.normal(size=60) ** 3, np.zeros(40), [1e9, -1e9]))
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
    want = np.sort(x)
    for k in (1, 2, 50, 51, 60, len(x)):
        assert ranks.kth(df, "x", k) == want[k - 1]
    assert ranks.kth(df, "x", 0) is None and ranks.kth(df, "x", len(x) + 1) is None
    assert ranks.median(df, "x") == np.median(x) and ranks.median(df.limit(0), "x") is None


def test_offsets_of_all_rows_are_those_of_one_group(spark):
    df = spark.range(333).selectExpr("CAST((id * 37) % 101 AS DOUBLE) AS e", "1 AS g")
    a, b = intervals.split_quantiles(df, "e", []).first(), intervals.split_quantiles(df, "e", ["g"]).first()
    assert (a["n"], a["lo"], a["hi"]) == (b["n"], b["lo"], b["hi"])
    few = intervals.split_quantiles(df.limit(5), "e", []).first()
    assert few["lo"] == float("-inf") and few["hi"] == float("inf")


def test_rbf_basis(spark):
    rng = np.random.default_rng(1)
    xy = rng.uniform(0, 1000, (200, 2))
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)] + [(999, None, 1.0)], "id long, x_m double, y_m double")
    centres, width = scoring.rbf_centres(df, 6)
    got = {r["id"]: r["basis"] for r in scoring.rbf_basis(df, centres, width).collect()}
    want = np.exp(-0.5 * ((xy[:, None] - centres[None]) ** 2).sum(2) / width**2)
    assert len(centres) == 6 and got[999] is None and np.allclose([got[i] for i in range(200)], want)


def test_risk_tiers(spark):
    df = spark.range(1000).select((F.col("id") / 1000).alias("score"), (F.col("id") / 1000).alias("error"))
    rows, tiers = scoring.risk_tiers(df, "score", "error")
    t = {r["tier"]: r for r in tiers.collect()}
    assert t["low"]["n"] == 750 and t["medium"]["n"] == 150 and t["high"]["n"] == 100
    assert t["low"]["rmse"] < t["medium"]["rmse"] < t["high"]["rmse"]


def test_blend_of_condo_arms_is_numpys(spark):
    p = mart_queries.condo_scores(spark, SF).toPandas()
    v, t = p[p["split"] == "validation"], p[p["split"] == "test"]
    assert len(v) > 20 and len(t) > 20
    d = v["gbt"] - v["forest"]
    w = min(1.0, max(0.0, (d * (v["label"] - v["forest"])).sum() / (d * d).sum()))
    blend = lambda x: w * x["gbt"] + (1 - w) * x["forest"]
    edges = np.quantile(blend(v), [0.2, 0.4, 0.6, 0.8])
    place = np.searchsorted(edges, blend(v) + 1e-12, side="right")
    centre = [np.median(blend(v)[place == k]) for k in range(5)]
    level = np.maximum.accumulate([c + np.median((v["label"] - blend(v))[place == k]) for k, c in enumerate(centre)])
    calibrated = blend(p) + np.interp(blend(p), centre, level - centre)
    assert np.allclose(p["calibrated"], calibrated)
    left = np.sort(v["label"] - v["calibrated"])
    up = int(np.ceil((len(v) + 1) * 0.95))
    assert np.allclose(p["high"] - p["calibrated"], left[up - 1]) and np.allclose(p["low"] - p["calibrated"], left[len(v) - up])


def test_rescored_transitions_keep_what_was_stored(spark):
    got = {r["sale_id"]: r["probability"] for r in all_queries()["mdl_transition_rescore"](spark, LARGER).collect()}
    rows = crossfit_queries.episodes(spark, LARGER)
    before = rows.where("sale_date < DATE '1997-01-01'")
    stored = {r["sale_id"]: r["probability"] for r in crossfit.crossfit_transition(before, crossfit_queries.EPISODE_INPUTS)[0].collect()}
    kept = [i for i, x in stored.items() if x is not None]
    assert len(got) == rows.count() > len(stored) > len(kept) > 0
    assert all(got[i] == pytest.approx(stored[i], abs=1e-4) for i in kept)
    labelled = ranks.running(before.where("label IS NOT NULL"), [], ["sale_date", "sale_id"], "_nth")
    told = {r["sale_id"]: r["probability"] for r in crossfit.fit_transition(labelled, crossfit_queries.EPISODE_INPUTS).score(rows).collect()}
    assert all(got[i] == pytest.approx(x, abs=1e-4) for i, x in told.items() if stored.get(i) is None)
