"""Values of the fitted arms against numpy and brute force, not only their rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tallyroll.operators import equity, folds, models, price_index, scoring
from tallyroll.plans import all_queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    n = 900
    x, z, kind = rng.uniform(0, 10, n), rng.normal(size=n), rng.integers(0, 3, n)
    y = 2.0 + 0.3 * x - 0.7 * z + np.array([0.0, 0.5, -0.4])[kind] + rng.normal(scale=0.05, size=n)
    p = pd.DataFrame({"id": np.arange(n), "x": x, "z": z, "kind": np.array(["a", "b", "c"])[kind], "y": y})
    return spark.createDataFrame(p).cache()


def design(p):
    return np.column_stack([np.ones(len(p)), p["x"], p["z"], p["kind"] == "b", p["kind"] == "c"]).astype(float)


def test_ridge_is_least_squares_at_its_small_penalty(rows):
    got = models.fit_arm(rows, "ridge", ["x", "z"], ["kind"], "y").transform(rows).select("id", "ridge").toPandas().sort_values("id")
    p = rows.toPandas().sort_values("id")
    want = design(p) @ np.linalg.lstsq(design(p), p["y"], rcond=None)[0]
    assert np.abs(got["ridge"].to_numpy() - want).max() < 0.02


@pytest.mark.parametrize("kind", ["gbt", "forest"])
def test_trees_learn_a_step_and_their_prediction_is_that_of_their_leaves(spark, kind):
    p = pd.DataFrame({"id": np.arange(400), "x": np.arange(400) % 100 / 10.0, "z": np.arange(400) % 7 * 1.0})
    p["y"] = np.where(p["x"] < 3, 1.0, np.where(p["x"] < 7, 4.0, 2.0))
    df = spark.createDataFrame(p)
    model = models.fit_arm(df, kind, ["x", "z"], [], "y")
    got = model.transform(df).toPandas()
    assert np.abs(got[kind] - got["y"]).mean() < 0.25
    weights = np.array(model.stages[-1].treeWeights)
    trees = np.array([[t.predict(v) for t in model.stages[-1].trees] for v in got["features"][:20]])
    total = trees @ weights if kind == "gbt" else trees.mean(axis=1)
    assert np.allclose(got[kind][:20], total)
    told = scoring.importance(spark, model, ["x", "z"]).collect()
    assert [r["feature"] for r in told] == ["x", "z"] and sum(r["importance"] for r in told) == pytest.approx(1.0) and told[0]["importance"] > 0.9


def pava(x, y):
    """Isotonic fit at the distinct sorted x, by pooling neighbours."""
    xs = np.unique(x)
    blocks = [[y[x == v].mean(), (x == v).sum(), [v]] for v in xs]
    out = []
    for b in blocks:
        out.append(b)
        while len(out) > 1 and out[-2][0] > out[-1][0]:
            a, c = out[-2], out.pop()
            out[-1] = [(a[0] * a[1] + c[0] * c[1]) / (a[1] + c[1]), a[1] + c[1], a[2] + c[2]]
    return xs, np.concatenate([[v] * len(k) for v, _, k in out])


def test_isotonic_correction_is_pooled_neighbours(spark):
    rng = np.random.default_rng(6)
    p = pd.DataFrame({"p": rng.integers(0, 40, 300) / 10.0})
    p["y"] = p["p"] + np.tanh(p["p"] - 2) + rng.normal(scale=0.3, size=300)
    df = spark.createDataFrame(p)
    got = models.isotonic_residual(df, "p", "y").transform(df).toPandas()
    xs, fit = pava(p["p"].to_numpy(), (p["y"] - p["p"]).to_numpy())
    assert np.allclose(got["correction"], np.interp(got["p"], xs, fit), atol=1e-9)


def test_forest_quantiles_are_those_of_the_leaves(rows):
    model = models.fit_arm(rows, "forest", ["x", "z"], ["kind"], "y")
    scored = model.transform(rows).select("id", "y", "leaves").cache()
    got = {r["id"]: r for r in models.forest_quantiles(scored, scored.where("id < 40"), "id", "y").collect()}
    p = scored.withColumn("l", vector_to_array("leaves")).select("id", "y", "l").toPandas()
    leaves, y = np.array(p["l"].tolist()), p["y"].to_numpy()
    assert len(got) == 40
    for i in range(40):
        mine = leaves[p["id"] == i][0]
        ends = np.mean([np.quantile(y[leaves[:, t] == mine[t]], [0.05, 0.95]) for t in range(leaves.shape[1])], axis=0)
        assert [got[i]["q_low"], got[i]["q_high"]] == pytest.approx(list(ends))


def test_drivers_add_up_to_the_prediction(rows):
    model = models.fit_arm(rows, "ridge", ["x", "z"], [], "y")
    scored = model.transform(rows)
    total = models.drivers(model, scored, "id", ["x", "z"]).groupBy("id").agg(F.sum("contribution").alias("c"))
    both = scored.join(total, "id").select("ridge", "c").toPandas()
    assert np.allclose(both["ridge"] - both["ridge"].mean(), both["c"], atol=1e-8)
    by = models.drivers(model, scored, "id", ["x", "z"]).where("feature = 'z'").join(rows, "id").toPandas()
    assert np.corrcoef(by["contribution"], by["z"])[0, 1] == pytest.approx(-1.0)


def curve_of(pairs, quarters, prior=None, ridge=0.0):
    """The index by dense least squares over one geography's pairs."""
    x = np.zeros((len(pairs), quarters))
    for i, (a, b, _) in enumerate(pairs):
        x[i, a] -= 1
        x[i, b] += 1
    y = np.array([d for _, _, d in pairs])
    if prior is None:
        return np.r_[0.0, np.linalg.lstsq(x[:, 1:], y, rcond=None)[0]]
    a = x[:, 1:].T @ x[:, 1:] + ridge * np.eye(quarters - 1)
    return np.r_[0.0, np.linalg.solve(a, x[:, 1:].T @ y + ridge * np.asarray(prior)[1:])]


def test_index_hierarchy_is_least_squares_pulled_to_the_parent(spark):
    rng = np.random.default_rng(7)
    rows = [(f"a{k % 3}", f"d{k % 3 // 2}", *sorted(map(int, rng.choice(8, 2, replace=False))), float(rng.normal())) for k in range(240)] + [("few", "d1", 0, 3, 0.5)]
    pairs = spark.createDataFrame(rows, "area string, district string, q1 int, q2 int, dlog double")
    got = {}
    for r in price_index.hierarchy(pairs, "area", "district", min_pairs=20).collect():
        got.setdefault(r["geo"], {})[r["quarter"]] = r["log_index"]
    of = lambda k, v: [(a, b, d) for *g, a, b, d in rows if v is None or g[k] == v]
    city = curve_of(of(0, None), 8)
    want = {price_index.CITY: city}
    for d in ("d0", "d1"):
        want[d] = curve_of(of(1, d), 8, city, 25.0)
    for a, d in (("a0", "d0"), ("a1", "d0"), ("a2", "d1")):
        want[a] = curve_of(of(0, a), 8, want[d], 6.0)
    assert set(got) == set(want)
    for g, curve in want.items():
        assert np.allclose([got[g][q] for q in range(8)], curve, atol=1e-8), g


def test_event_sample_is_quiet_and_the_same_each_time(spark):
    everyone = spark.range(500).selectExpr("id AS parcel_id")
    touched = [everyone.where("parcel_id % 2 = 0"), everyone.where("parcel_id % 3 = 0")]
    got = [r[0] for r in equity.event_sample(everyone, touched, 40, 7).collect()]
    assert len(set(got)) == 40 and all(i % 2 and i % 3 for i in got)
    assert got == [r[0] for r in equity.event_sample(everyone.repartition(7), touched[::-1], 40, 7).collect()]
    assert set(got) != {r[0] for r in equity.event_sample(everyone, touched, 40, 8).collect()}
    assert equity.event_sample(everyone, touched, 10_000, 7).count() == sum(1 for i in range(500) if i % 2 and i % 3)


def test_condo_bands_hold_every_test_sale(spark):
    got = all_queries()["mdl_condo"](spark, SF).collect()
    assert {r["band"] for r in got} <= {"small", "medium", "large"} and all(r["n"] > 0 and 0 < r["rmse"] < 5 for r in got)


def test_rbf_query_is_numpys(spark):
    got = all_queries()["mdl_rbf_basis"](spark, SF).toPandas()
    assert got["centre"].nunique() == 64 and got.groupby("sale_id").size().eq(64).all() and got["value"].between(0, 1).all()


def test_folds_are_numpys(rows):
    df = rows.withColumns({"period": (F.col("id") % 6).cast("int"), "is_b": (F.col("kind") == "b").cast("double"), "is_c": (F.col("kind") == "c").cast("double"), "group": F.when(F.col("id") % 10 > 0, F.concat(F.lit("g"), F.col("id") % 4))})
    features = ["x", "z", "is_b", "is_c"]
    p = df.toPandas().set_index("id")
    fit = lambda part, c=features: np.linalg.lstsq(np.column_stack([np.ones(len(part)), part[c]]), part["y"], rcond=None)[0]
    told = lambda part, beta, c=features: np.column_stack([np.ones(len(part)), part[c]]) @ beta
    got = folds.rolling_folds(df, "period", 3, 3, features, "y").toPandas().set_index("id")
    assert set(got["fold"]) == {0, 1, 2} and len(got) == (p["period"] >= 3).sum()
    for f in range(3):
        part = got[got["fold"] == f].sort_index()
        assert np.allclose(part["predicted"], told(p.loc[part.index], fit(p[p["period"] < 3 + f])))
    got = folds.left_out_folds(df, "group", 200, features, "y").toPandas().set_index("id")
    big = p.groupby("group").size()
    assert set(got["fold"]) == set(big[big >= 200].index) and got["fold"].notna().all()
    for g in set(got["fold"]):
        part = got[got["fold"] == g].sort_index()
        # Rows without a group belong to no fold and teach none.
        assert np.allclose(part["predicted"], told(p.loc[part.index], fit(p[p["group"].notna() & (p["group"] != g)])))
    arms = {"all": "true", "b": "kind = 'b'", "none": "id < 0"}
    got = folds.arms_by_training(df, arms, "id >= 800", features, "y").toPandas()
    assert set(got["arm"]) == {"all", "b"}
    one = got[got["arm"] == "b"].set_index("id").sort_index()
    want = told(p.loc[one.index], fit(p[p["kind"] == "b"], ["x", "z"]), ["x", "z"])
    same = p.loc[one.index, "kind"] == "b"
    assert np.allclose(one["predicted"][same], want[same])
    got = folds.arms_by_features(df, {"few": ["x"], "more": features}, "id < 700", "id >= 700", "y").toPandas()
    for arm, c in (("few", ["x"]), ("more", features)):
        part = got[got["arm"] == arm].set_index("id").sort_index()
        assert np.allclose(part["predicted"], told(p.loc[part.index], fit(p[p.index < 700], c), c))


def test_folds_with_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, 3, 1.0, 2.0), (2, 3, None, 2.0)], "id int, period int, x double, log_price double")
    assert folds.rolling_folds(df, "period", 3, 2, ["x"]).count() == 0
    assert folds.arms_by_features(df, {"a": ["x"]}, "id > 5", "true").count() == 0
    flat = spark.createDataFrame([(i, 0, 5.0, 2.0 + i) for i in range(4)] + [(9, 1, 5.0, 1.0)], "id int, period int, x double, log_price double")
    assert folds.rolling_folds(flat, "period", 1, 1, ["x"]).first()["predicted"] == pytest.approx(3.5)  # a constant feature adds nothing
    assert folds.fitted(np.zeros((3, 3))) is None
