"""Steps that once met whole groups in one task, or computed their input again for every pass, don't any more; same rows."""

import datetime
import random

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tallyroll.operators import equity, folds, geometry, intervals, models, ranks, ratio, ratio_studies, study
from tallyroll.plans import all_queries, model_queries

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_of(df):
    return sorted((tuple(f"{v:.9g}" if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(11)
    made = [("hot" if i % 9 else None, i % 4 == 0, rng.choice((1.0, 2.0, rng.uniform(1, 9))), None if i % 50 == 0 else rng.uniform(-1, 1), 10.0 + rng.uniform(-1, 1), rng.uniform(1e4, 9e4)) for i in range(700)]
    return spark.createDataFrame(made, "k string, side boolean, r double, predicted double, log_price double, sale double").cache()


FORMS = {
    "split_quantiles": lambda d: intervals.split_quantiles(d, "predicted", ["k"]),
    "cqr": lambda d: intervals.cqr_correction(d, "log_price", "r", "sale", ["k"]),
    "risk_coverage": lambda d: intervals.risk_coverage(d, "r", "predicted", ["k"]),
    "group_gap": lambda d: ratio_studies.group_gap(d, ["k"], "side"),
    "residual_bands": lambda d: study.residual_bands(d.withColumn("side", F.when(F.col("r") > 1.5, F.col("side"))), "side", "sale", [3e4, 6e4], "predicted"),
    "robustness_grid": lambda d: equity.robustness_grid(d.withColumn("est", F.col("r") * F.col("sale")), "side", ["sale", "est"]),
}


@pytest.mark.parametrize("name", FORMS)
def test_groups_in_parts_give_the_same_rows(rows, monkeypatch, name):
    plain = rows_of(FORMS[name](rows))
    written = []
    monkeypatch.setattr(ranks, "IN_ONE_TASK", 20)
    monkeypatch.setattr(ranks, "kept", lambda df, tag, kept=ranks.kept: written.append(tag) or kept(df, tag))
    assert rows_of(FORMS[name](rows)) == plain and written


def test_medians_of_groups_equal_plain_ones(rows):
    got = {r["k"]: r["gap"] for r in ratio_studies.group_gap(rows, ["k"], "side").collect()}
    for k, v in rows.toPandas().groupby("k", dropna=False):
        error = v["predicted"] - v["log_price"]
        assert got[None if k != k else k] == pytest.approx(error[v["side"]].median() - error[~v["side"]].median(), rel=1e-12)


def test_large_groups_are_dealt_by_value_without_a_write_of_all_rows(spark, monkeypatch):
    written = []
    monkeypatch.setattr(ranks, "kept", lambda df, tag, kept=ranks.kept: written.append(tag) or kept(df, tag))
    d = spark.range(3000).select(F.col("id").cast("double").alias("v"), F.expr("date'2020-01-01' + cast(id % 900 as int)").alias("day"), "id").cache()
    got = ranks.running(d, [], ["v"], "at", in_one_task=600, size=3000)
    assert got.where("at <> id + 1").count() == 0 and got.count() == 3000
    byday = ranks.running(d, [], ["day", "id"], "at", in_one_task=600, size=3000).toPandas().sort_values(["day", "id"])
    assert list(byday["at"]) == list(range(1, 3001))
    assert "ranges" not in written
    same = ranks.running(d.withColumn("one", F.lit(1.0)), [], ["one", "id"], "at", in_one_task=600, size=3000)
    assert same.where("at <> id + 1").count() == 0 and "ranges" in written  # equal values go on sorted by range


def test_tested_rows_do_not_meet_by_fold(spark):
    test = spark.createDataFrame([(float(i), "ab"[i % 2]) for i in range(20)], "x double, arm string")
    out = folds.predicted(test, {"a": [1.0, 2.0], "b": [0.0, -1.0], "c": None}, ["x"], "arm")
    assert "SortMergeJoin" not in plan(out) and "hashpartitioning" not in plan(out)
    assert {(r["x"], r["predicted"]) for r in out.collect()} == {(float(i), -float(i) if i % 2 else 1 + 2.0 * i) for i in range(20)}


def test_only_what_is_ranked_is_shuffled(rows):
    wide = ratio.clean_pairs(rows.withColumns({"est": F.col("r") * F.col("sale"), "unused_text": F.lit("x" * 50)}), "est", "sale")
    for f in (ratio.ratio_metrics, ratio.vertical_equity):
        assert "unused_text" not in plan(f(wide, ["k"]))


def test_rings_are_parsed_once_and_samples_split_once(spark):
    g = spark.createDataFrame([(1, '{"type":"Polygon","coordinates":[[[0,0],[10,0],[10,20],[0,20],[0,0]]]}')], "id int, g string")
    shapes = geometry.shape_measures(g.withColumn("ring", geometry.ring_of("g")), "ring")
    assert "from_json" not in plan(shapes) and shapes.first()["area"] == 200
    assert "Window" not in plan(model_queries._sample(spark, SF))


def test_sale_chasing_joins_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(ratio_studies, "kept", lambda df, tag, kept=ranks.kept: written.append(tag) or kept(df, tag))
    sales = spark.createDataFrame([(i, datetime.date(1994, 1 + i % 12, 3), 100.0 + i, None) for i in range(60)], "parcel_id int, sale_date date, sale_price double, time_adj_log double")
    rolls = spark.createDataFrame([(i, 1996, 90.0) for i in range(60)], "parcel_id int, roll_year int, roll_value double")
    out = ratio_studies.sale_chasing(sales, rolls, least=10)
    assert "parcel_id" not in plan(out) and [(r["window"], r["n"]) for r in out.collect()] == [("before_certification", 60)] and written == ["chased"]


def test_leaves_of_many_rows_are_told_by_steps_of_the_label(spark, monkeypatch):
    rng = random.Random(4)
    made = [(i, rng.choice((2.0, rng.uniform(0, 9))), Vectors.dense([float(rng.randrange(5)), float(i % 3)])) for i in range(900)]
    scored = spark.createDataFrame(made, ["id", "y", "leaves"]).withColumn("y", F.when(F.col("id") % 70 > 0, F.col("y"))).cache()
    plain = rows_of(models.leaf_quantiles(scored, "y", {"a": 0.05, "b": 0.95}).select("tree", "leaf", "a", "b"))
    monkeypatch.setattr(ranks, "IN_ONE_TASK", 100)
    dealt = models.leaf_quantiles(scored, "y", {"a": 0.05, "b": 0.95}).select("tree", "leaf", "a", "b")
    assert rows_of(dealt) == plain and len(plain) == 8 and "percentile" not in plan(dealt)
    out = models.with_forest_quantiles(scored.where("id >= 30"), scored.where("id < 30"), "y")
    assert "Join" not in plan(out) and "Generate" not in plan(out) and out.where("q_low <= q_high").count() == 30


def test_a_study_tells_fit_and_ratio_of_all_segments(spark):
    got = {(r["arm"], r["segment"]): r for r in all_queries()["eq_retail_vs_blend"](spark, SF).collect()}
    parts = ["overall", "cash", "financed", *(f"q{k}" for k in range(1, 6))]
    assert set(got) == {(a, s) for a in ("retail", "blend") for s in parts} | {(a, s) for a in ("roll", "roll_retail") for s in parts[3:]}
    for arm in ("retail", "blend"):
        assert all(got[arm, s][c] is not None for s in parts for c in ("rmse_log", "mape", "r2_log", *ratio_studies.METRICS))
        assert got[arm, "overall"]["n"] == got[arm, "cash"]["n"] + got[arm, "financed"]["n"] == sum(got[arm, s]["n"] for s in parts[3:])


def test_cash_sales_count_at_their_retail_price(spark):
    sales = spark.createDataFrame([("q1", True, 80.0, 100.0), ("q1", None, 80.0, 120.0), ("q1", False, 100.0, 100.0), ("q2", True, 80.0, 100.0), ("q2", False, 50.0, -1.0)], "segment string, cash boolean, sale_price double, roll double")
    got = {(r["arm"], r["segment"]): (r["n"], r["cash_share"], r["median_ratio"]) for r in ratio_studies.value_conventions(sales, "roll", {"q1": -0.2}).collect()}
    assert got == {("roll", "q1"): (3, pytest.approx(2 / 3), 1.25), ("roll_retail", "q1"): (3, pytest.approx(2 / 3), 1.0), ("roll", "q2"): (2, 0.5, 1.25), ("roll_retail", "q2"): (2, 0.5, 1.25)}
