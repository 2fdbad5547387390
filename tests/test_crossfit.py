"""Cross-fitted scores: no row's own outcome moves its score, and the figures are numpy's."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyroll.operators import crossfit
from tallyroll.plans import crossfit_queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def records(spark):
    return crossfit_queries.records(spark, SF).withColumn("style", F.coalesce("style", F.lit("none"))).cache()


@pytest.fixture(scope="module")
def scored(records):
    out, told = crossfit.characteristic_quality(records, crossfit_queries.RECORD_NUMERIC, crossfit_queries.RECORD_CATEGORICAL)
    return out.cache(), told


def test_bands_and_flags_are_numpys(records, scored):
    out, told = scored
    assert told["status"] == "ok"
    p = records.join(out, "parcel_id").toPandas()
    assert len(p) == records.count()
    expected, residual = p["quality_expected_livable_area"], np.log(p["livable_area"]) - np.log(p["quality_expected_livable_area"])
    used = p["livable_area"].between(300, 10_000) & (p["gross_area"] > 0) & ~(p["area_conflict"] > 0)
    seen = residual[used]
    centre = np.median(seen)
    sigma = 1.4826 * np.median(np.abs(seen - centre))
    q05, q95 = np.quantile(seen, [0.05, 0.95])
    limit = np.quantile(np.abs((seen - centre) / sigma), 0.995)
    for name, v in (("centre", centre), ("sigma", sigma), ("q05", q05), ("q95", q95), ("outlier_z", limit)):
        assert told[name] == pytest.approx(v, rel=1e-9), name
    assert np.allclose(p["quality_area_reference_low_90"], expected * np.exp(q05)) and np.allclose(p["quality_area_reference_high_90"], expected * np.exp(q95))
    z = (residual - centre) / sigma
    clear = np.abs(np.abs(z) - limit) > 1e-9  # the limit may itself be some row's value
    assert (p["quality_area_outlier"] == (np.abs(z) > limit))[clear].all() and p["quality_area_outlier"].any()
    beds = np.where(p["beds"] <= 0, p["quality_expected_beds"], 0.0)
    baths = np.where(p["baths"] <= 0, p["quality_expected_baths"], 0.0)
    assert (p["quality_zero_bed_bath_conflict"] == ((p["beds"] <= 0) & (p["baths"] <= 0) & (beds >= 1) & (baths >= 0.75))).all() and p["quality_zero_bed_bath_conflict"].any()
    score = np.maximum.reduce([np.abs(z), beds, baths * 2]) / 3  # none without an area
    assert np.allclose(p["quality_characteristic_conflict_score"], score, equal_nan=True) and np.isnan(score).any()
    cut = np.nanquantile(score, 0.95)
    assert (p["quality_characteristic_outlier"] == (score >= cut))[np.abs(score - cut) > 1e-9].all()
    # The models recover the area from the building, so trebled records stand out.
    assert np.median(np.abs(z[(p["parcel_id"] % 50 == 0) & p["livable_area"].notna()])) > 3


def test_own_record_does_not_move_its_score(records, scored):
    out, _ = scored
    fold = crossfit.hash_fold("parcel_id", 3, 42)
    for f in (1,):
        changed = records.withColumns({c: F.when(fold == f, F.col(c) * 1.2 + 1).otherwise(F.col(c)) for c in ("livable_area", "beds", "baths")})
        other = crossfit.characteristic_quality(changed, crossfit_queries.RECORD_NUMERIC, crossfit_queries.RECORD_CATEGORICAL)[0]
        names = ["quality_expected_livable_area", "quality_expected_beds", "quality_expected_baths"]
        both = out.where(fold == f).select("parcel_id", *names).join(other.select("parcel_id", *[F.col(c).alias(f"_{c}") for c in names]), "parcel_id")
        worst = both.agg(*[F.max(F.abs(F.col(c) - F.col(f"_{c}"))) for c in names]).first()
        assert max(worst) < 1e-9


def test_rows_that_are_alike_are_learned_as_one(spark, monkeypatch):
    rows = spark.range(9000).selectExpr(
        "id AS parcel_id", "600.0 + id % 31 * 40 + id % 7 AS livable_area", "1.0 + id % 31 DIV 8 AS beds", "1.0 + id % 2 AS baths", "650.0 + id % 31 * 40 AS gross_area", "CAST(NULL AS DOUBLE) AS area_conflict",
        "IF(id % 11 = 0, NULL, CAST(id % 31 AS DOUBLE)) AS footprint", "IF(id % 2 = 0, 'row', 'twin') AS style",
    )
    sizes, fit = [], crossfit.fit_arm
    monkeypatch.setattr(crossfit, "fit_arm", lambda df, *a, **b: (sizes.append(df.count()), fit(df, *a, **b))[1])
    out, told = crossfit.characteristic_quality(rows, ["footprint"], ["style"])
    assert told["area_records"] == 9000 and len(sizes) == 9 and max(sizes) <= 62  # 31 steps in two styles, however many records
    # The trees are those of all rows, one by one, with the median where a number is missing.
    ready = rows.withColumns({"fold": crossfit.hash_fold("parcel_id", 3, 42), "_label": F.ln("livable_area")})
    arm = fit(ready.where("fold <> 1"), "gbt", ["footprint"], ["style"], "_label")
    both = arm.transform(ready.where("fold = 1")).select("parcel_id", "gbt").join(out, "parcel_id")
    n, worst = both.agg(F.count(F.lit(1)), F.max(F.abs(F.col("gbt") - F.ln("quality_expected_livable_area")))).first()
    assert n == rows.where(crossfit.hash_fold("parcel_id", 3, 42) == 1).count() and worst < 1e-9


def test_too_few_records(records):
    out, told = crossfit.characteristic_quality(records.limit(50), crossfit_queries.RECORD_NUMERIC, crossfit_queries.RECORD_CATEGORICAL)
    assert told == {"status": "not_fit", "reason": "too_few_coherent_area_records"} and dict(out.dtypes) == {"parcel_id": "bigint", **crossfit.QUALITY}
    row = out.first()
    assert row["quality_area_outlier"] is False and row["quality_expected_beds"] is None


def test_transition_sees_no_own_or_later_label(spark):
    rows = crossfit_queries.episodes(spark, SF).cache()
    out, folds = crossfit.crossfit_transition(rows, crossfit_queries.EPISODE_INPUTS)
    got = {r["sale_id"]: r for r in out.collect()}
    told = folds.orderBy("fold").collect()
    n = rows.count()
    assert len(got) == n and [t["prediction_rows"] for t in told] == [n * (f + 1) // 5 - n * f // 5 for f in range(5)]
    assert told[0]["status"] == "insufficient_history_missing" and told[4]["status"] == "trained"
    order = sorted(got.values(), key=lambda r: (r["sale_date"], r["sale_id"]))
    assert [r["fold"] for r in order] == sorted(r["fold"] for r in order)
    for r in order:
        if not r["eligible"]:
            assert r["probability"] == 0.0
        elif told[r["fold"] - 1]["status"] != "trained":
            assert r["probability"] is None
        else:
            assert 0.0 <= r["probability"] <= 1.0
    # Labels of the fourth fold and later are turned round: nothing up to the fourth fold moves, the fifth does.
    late = [r["sale_id"] for r in order if r["fold"] >= 4]
    turned = rows.withColumn("label", F.when(F.col("sale_id").isin(late), 1 - F.col("label")).otherwise(F.col("label")))
    other = {r["sale_id"]: r["probability"] for r in crossfit.crossfit_transition(turned, crossfit_queries.EPISODE_INPUTS)[0].collect()}
    assert all(other[r["sale_id"]] == r["probability"] for r in order if r["fold"] <= 4)
    assert any(other[r["sale_id"]] != r["probability"] for r in order if r["fold"] == 5)
    last = [r for r in order if r["fold"] == 5 and r["label"] is not None and r["eligible"]]
    mean = lambda y: np.mean([r["probability"] for r in last if r["label"] == y])
    assert mean(1) > mean(0) + 0.2
