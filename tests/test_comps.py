"""Comparable sales against all pairs of leaf vectors."""

import datetime
import math
import random

from pyspark.sql import functions as F

from tallyroll.operators import comps
from tallyroll.plans import all_queries, model_queries

TARGET = "parcel_id long, style string, area double, lon double, lat double, leaves array<int>"
SALE = "sale_id long, parcel_id long, sale_date date, sale_price double, time_adj_log double, style string, area double, lon double, lat double, leaves array<int>"


def brute(targets, sales, k, years=5.0, band=0.3, least=50):
    newest = max(s["sale_date"] for s in sales)
    pool = [s for s in sales if s["sale_date"] >= newest - datetime.timedelta(days=int(years * 365.25))]
    out = {}
    for t in targets:
        others = [s for s in pool if s["parcel_id"] != t["parcel_id"]]
        styled = [s for s in others if t["style"] is None or s["style"] == t["style"]]
        area = t["area"]
        sized = [s for s in styled if not area or area <= 0 or (s["area"] is not None and area * (1 - band) <= s["area"] <= area * (1 + band))]
        for rung, chosen in ((1, sized), (2, styled), (3, others)):
            if len(chosen) >= max(least, 5 * k):
                break
        scored = [(sum(a == b for a, b in zip(t["leaves"], s["leaves"])), s) for s in chosen]
        scored = sorted(((-n, s["sale_id"]) for n, s in scored if n))[:k]
        out[t["parcel_id"]] = [(rung, i, -n / len(t["leaves"])) for n, i in scored]
    return out


def check(got, want):
    found = {p: [] for p in want}
    for r in sorted(got, key=lambda r: (r["parcel_id"], r["rank"])):
        found[r["parcel_id"]].append((r["rung"], r["sale_id"], r["similarity"]))
    assert found == want


def test_comps_equal_all_pairs(spark):
    rng = random.Random(4)
    styles = ["row", "row", "row", "twin", None]
    leaves = lambda: [rng.choice((1, 1, 1, 2, 3)) for _ in range(12)]
    day = lambda: datetime.date(2024, 1, 1) - datetime.timedelta(days=rng.randrange(2400))
    sales = [(i, rng.randrange(60), day(), 1e5 + i, rng.choice((None, 0.1)), rng.choice(styles), rng.choice((None, 500.0, 700.0, 1000.0, 1300.0, 3000.0)), -75.0 + i / 1e4, 40.0, leaves()) for i in range(500)]
    targets = [(i, rng.choice(styles), rng.choice((None, 0.0, 500.0, 1000.0, 2500.0)), None if i % 9 == 0 else -75.0, 40.0, leaves()) for i in range(80)]
    targets += [(900, "twin", 1000.0, -75.0, 40.0, [9] * 12), (901, "none", 1.0, -75.0, 40.0, [1] * 11 + [9])]
    t, s = spark.createDataFrame(targets, TARGET), spark.createDataFrame(sales, SALE)
    for k in (3, 10):
        got = comps.find_comps(t, s, k=k).collect()
        want = brute(t.collect(), s.collect(), k)
        check(got, want)
        assert {r[0] for rows in want.values() for r in rows} >= {1, 2, 3} and want[900] == []
    for r in got:
        assert math.isclose(r["price_adj_today"], r["sale_price"] * math.exp(dict((x[0], x[4]) for x in sales)[r["sale_id"]] or 0))
        assert (r["distance_m"] is None) == (r["parcel_id"] % 9 == 0 and r["parcel_id"] < 900)
    assert comps.find_comps(t.limit(0), s).count() == 0 and comps.find_comps(t, s.limit(0)).count() == 0


def test_sizes_are_counted_over_all_tasks_alike(spark, monkeypatch):
    rng = random.Random(5)
    sales = spark.createDataFrame([(i, i % 40, datetime.date(2024, 1, 1), 1.0, 0.0, rng.choice(("a", "b")), float(rng.randrange(5, 30)), 0.0, 0.0, [1]) for i in range(400)], SALE)
    targets = spark.createDataFrame([(i, rng.choice(("a", None)), float(rng.randrange(5, 30)), 0.0, 0.0, [1]) for i in range(60)], TARGET)
    plain = sorted(map(tuple, comps.pool_rungs(targets, sales).collect()))
    monkeypatch.setattr("tallyroll.operators.ranks.IN_ONE_TASK", 10)
    assert sorted(map(tuple, comps.pool_rungs(targets, sales).collect())) == plain


def test_query_equals_all_pairs(spark):
    sf = "/root/testdata/sf0.001"
    targets, sales = model_queries.comps_inputs(spark, sf)
    check(all_queries()["mdl_comps"](spark, sf).collect(), {p: [(a, i, round(x, 4)) for a, i, x in rows] for p, rows in brute(targets.collect(), sales.collect(), 10).items()})
    assert sales.where(F.size("leaves") < 10).count() == 0


def test_targets_of_a_crowded_leaf_do_not_meet_all_its_sales(spark):
    sales = spark.range(30_000).selectExpr("id AS sale_id", "id % 500 AS parcel_id", "date'2024-01-01' AS sale_date", "1.0D AS sale_price", "0.0D AS time_adj_log", "'row' AS style", "300.0D + id % 1000 AS area", "0.0D AS lon", "0.0D AS lat", "array(1, 1, 1, 1) AS leaves")
    targets = spark.range(5_000).selectExpr("id AS parcel_id", "'row' AS style", "300.0D + id % 1000 AS area", "0.0D AS lon", "0.0D AS lat", "array(1, 1, 1, CAST(1 + id % 2 AS INT)) AS leaves")
    pool = sales.select("sale_id", F.col("parcel_id").alias("_parcel"), F.col("style").alias("_style"), F.col("area").alias("_area"), F.col("leaves").alias("_leaves"))
    found = comps._nearest(targets.withColumn("rung", F.lit(1)), pool, 4, 2, 10, 0.3)
    assert "FlatMapCoGroups" in found._jdf.queryExecution().toString()  # lists are shared: no row for each target and sale
    got = found.toPandas()
    assert len(got) == 50_000 and got.groupby("parcel_id").size().eq(10).all()
    for p in (0, 1, 777, 4_999):
        area = 300.0 + p % 1000
        want = [i for i in range(30_000) if i % 500 != p and area * (1 - 0.3) <= 300.0 + i % 1000 <= area * (1 + 0.3)][:10]
        assert list(got[got["parcel_id"] == p].sort_values("rank")["sale_id"]) == want
