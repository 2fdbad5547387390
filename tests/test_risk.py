"""The risk model's rule, ranks and tiers; the lake's lineage."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyroll.operators import risk
from tallyroll.plans import mart_queries
from tallyroll.sources import lake

SF = "/root/testdata/sf0.001"


def test_spearman_shares_ranks_of_ties(spark):
    rng = np.random.default_rng(1)
    p = pd.DataFrame({"a": rng.integers(0, 6, 300).astype(float), "b": rng.normal(size=300).round(1)})
    p["b"] += p["a"] / 4
    df = spark.createDataFrame(p)
    assert risk.spearman(df, "a", "b") == pytest.approx(p["a"].rank().corr(p["b"].rank()))
    got = risk.average_ranks(df, "a", "r").toPandas()
    assert (got["r"] == got["a"].rank()).all()
    assert risk.spearman(df.withColumn("a", F.lit(1.0)), "a", "b") is None
    assert risk.spearman(df.limit(0), "a", "b") is None


def rows(spark, errors, score=lambda i: i / 100):
    """A hundred rows; the tiers begin at 0.75 and 0.9."""
    return spark.createDataFrame([(score(i), errors(i)) for i in range(100)], "s double, e double")


@pytest.mark.parametrize(
    ("errors", "score", "why"),
    [
        (lambda i: 0.1 + i / 100, None, None),
        (lambda i: 0.1, None, "correlation"),
        (lambda i: 1.0 - i / 100, None, "correlation"),
        (lambda i: (0.1 + i / 1000) if not 75 <= i < 90 else 0.01, None, "rise"),
        (lambda i: 1.0 + i / 1000, None, "enough"),
        (lambda i: 0.1 + i / 100, lambda i: 0.5, "no rows"),
    ],
)
def test_each_branch_of_the_rule(spark, errors, score, why):
    df = rows(spark, errors, score or (lambda i: i / 100))
    got = risk.promotion(risk.evaluate(df, "s", "e", 0.75, 0.9), risk.spearman(df, "s", "e"))
    assert (got is None) if why is None else why in got


def test_evaluation_is_numpys(spark):
    df = rows(spark, lambda i: (i * 37 % 100) / 100)
    got = {r["segment"]: r for r in risk.evaluate(df, "s", "e", 0.75, 0.9).collect()}
    p = df.toPandas().sort_values("s")
    for name, part in {"standard": p[:75], "elevated": p[75:90], "high": p[90:], "retain_0.25": p[:25], "retain_0.90": p[:90], "retain_1.00": p}.items():
        r = got[name]
        assert (r["n"], r["share"]) == (len(part), len(part) / 100)
        assert [r["mean_score"], r["mean_error"], r["rmse"]] == pytest.approx([part["s"].mean(), part["e"].mean(), np.sqrt((part["e"] ** 2).mean())])


def test_fit_and_fall_back(spark):
    rng = np.random.default_rng(2)
    noise = rng.uniform(0, 1, 1600)
    p = pd.DataFrame({"i": np.arange(1600), "x": noise, "error": np.abs(rng.normal(size=1600)) * (0.05 + noise)})
    df = spark.createDataFrame(p).cache()
    good = risk.fit_risk(df.where("i < 1000"), df.where("i >= 1000"), ["x"], "error", ["i"])
    assert good.rejected is None and good.correlation > 0.3
    tiers = {r["risk_tier"] for r in good.score(df.where("i >= 1000")).collect()}
    assert tiers == set(risk.TIERS)
    blind = risk.fit_risk(df.where("i < 1000").withColumn("x", F.rand(1)), df.where("i >= 1000").withColumn("x", F.rand(2)), ["x"], "error", ["i"])
    assert blind.rejected
    few = risk.fit_risk(df.where("i < 400"), df.where("i >= 1000"), ["x"], "error", ["i"])
    assert few.rejected == "too few rows"
    for r in (blind, few):
        assert {tuple(x) for x in r.score(df).select("risk_score", "risk_tier").distinct().collect()} == {(0.0, "standard")}


def test_rows_may_carry_other_arms(spark):
    rng = np.random.default_rng(3)
    p = pd.DataFrame({"i": np.arange(1000), "x": rng.uniform(0, 1, 1000), "gbt": 1.0, "forest": 2.0, "error": rng.uniform(0, 1, 1000)})
    df = spark.createDataFrame(p)
    found = risk.fit_risk(df.where("i < 600"), df.where("i >= 600"), ["x"], "error", ["i"])
    assert found.model is not None
    assert {tuple(r) for r in found.score(df).select("gbt", "forest").distinct().collect()} == {(1.0, 2.0)}
    assert all(r["risk_score"] >= 0 for r in risk._scored(found.model, df).collect())


def test_query_uses_only_what_came_before(spark):
    validation, test = mart_queries.risk_inputs(spark, SF)
    assert validation.agg(F.max("sale_date")).first()[0] <= test.agg(F.min("sale_date")).first()[0]
    assert validation.where("width IS NULL OR width < 0 OR error < 0").count() == 0


def test_lineage_finds_a_stale_grandparent(spark, tmp_path):
    base = f"file://{tmp_path}/lake"
    df = spark.range(3)
    for layer, name, inputs, day in (("staged", "a", (), 4), ("mart", "b", ("staged/a",), 2), ("mart", "c", ("mart/b",), 5), ("mart", "d", ("mart/c", "staged/e"), 6), ("staged", "e", (), 1)):
        lake.write_derived(df, base, layer, name, dict.fromkeys(inputs, ""), built_at=f"2024-01-0{day}T00:00:00Z")
    found = {(r["table"], r["input_table"]): r["depth"] for r in lake.lineage(spark, base).collect()}
    assert found == {("b", "a"): 1, ("c", "b"): 1, ("c", "a"): 2, ("d", "c"): 1, ("d", "e"): 1, ("d", "b"): 2, ("d", "a"): 3}
    late = {(r["table"], r["input_table"]): r["depth"] for r in lake.stale(spark, base).collect()}
    assert late == {("b", "a"): 1, ("c", "a"): 2, ("d", "a"): 3}  # c and d are newer than a, but were built from a b that is not
    with pytest.raises(lake.StaleError, match="staged/a"):
        lake.require_fresh(spark, base, "mart", "d")
    assert len(lake.require_fresh(spark, base, "mart", "d", allow_stale=True)) == 1 and lake.require_fresh(spark, base, "staged", "e") == []
    lake.write_derived(df, base, "mart", "b", {"staged/a": "", "mart/d": ""}, built_at="2024-01-07T00:00:00Z")  # a circle ends
    assert lake.lineage(spark, base).where("table = input_table").count() == 3
    assert lake.provenance(spark, base).agg(F.max("rows")).first()[0] == 3


def test_rows_that_are_learned_from_are_not_scored(spark, monkeypatch):
    written = {}
    monkeypatch.setattr(lake, "kept", lambda df, tag, kept=lake.kept: written.setdefault(tag, kept(df, tag)))
    mart_queries.risk_inputs(spark, SF)
    assert {r[0] for r in written["risk-arms"].select("split").distinct().collect()} == {"validation", "test"}
