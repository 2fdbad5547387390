"""All counts of a sale's events from one meeting are those of each by itself."""

import random

from pyspark.sql import functions as F

from tallyroll.operators import events, features, geometry
from tallyroll.plans import all_queries

SF = "/root/testdata/sf0.001"


def test_counts_are_those_of_each_operator(spark):
    rng = random.Random(4)
    day = lambda: f"199{rng.randrange(2, 9)}-{rng.randrange(1, 13):02}-{rng.randrange(1, 29):02}"
    maybe = lambda v, p=0.1: None if rng.random() < p else v
    s = [(i, maybe(rng.randrange(12)), maybe(day()), 1e5 * (1 + rng.random() * 3), maybe(rng.random() / 5)) for i in range(150)]
    e = [(i, maybe(rng.randrange(14)), maybe(day()), maybe(day(), 0.4), maybe(rng.choice(["Major Alteration", "Change of Use", "Sign"])), maybe(rng.random() < 0.5)) for i in range(400)]
    sales = spark.createDataFrame(s, "sale_id long, parcel_id long, sale_date string, sale_price double, time_adj_log double").withColumn("sale_date", F.col("sale_date").cast("date"))
    dated = spark.createDataFrame(e, "event_id long, parcel_id long, issued string, closed string, kind string, severe boolean").withColumns({c: F.col(c).cast("date") for c in ("issued", "closed")})
    issued, closed, severe, sign = F.col("issued"), F.col("closed"), F.col("severe"), F.col("kind") == "Sign"
    tenure = {
        "complaints": {"day": issued, "exterior": severe}, "investigations": {"opened": issued, "closed": closed, "court": severe},
        "licenses": {"is_one": sign, "start": issued, "stop": closed, "units": F.col("event_id") % 10}, "appeals": {"day": issued, "granted": F.col("event_id") % 4 == 0},
    }
    rows = features.episode_rows(sales).select("sale_id", "parcel_id", "sale_date", "_bought", "held", "eligible", "_gain")
    got = features.sale_events(rows, dated, tenure)
    tables = {
        "complaints": dated.select("parcel_id", issued.alias("day"), severe.alias("exterior")), "investigations": dated.select("parcel_id", issued.alias("opened"), "closed", severe.alias("court")),
        "licenses": dated.where(sign).select("parcel_id", issued.alias("start"), closed.alias("stop"), F.lit(False).alias("owner_occupied"), (F.col("event_id") % 10).alias("units")),
        "appeals": dated.select("parcel_id", issued.alias("day"), (F.col("event_id") % 4 == 0).alias("granted")),
    }
    parts = {
        "permit": events.before_anchor(sales, dated, "issued", {"n_all": None, "n_reno": events.is_renovation("kind")}, {"since_any": None}),
        "case": events.open_at_anchor(sales, dated, "issued", "closed", {"n_open": None, "n_open_severe": severe}),
        "tenure": features.distress_tenure(sales, **tables),
        "episode": features.episode_labels(sales, dated).drop("held", "eligible"),
    }
    found = {r["sale_id"]: r for r in got.collect()}
    assert len(found) == got.count() == 150
    for name, part in parts.items():
        for r in part.collect():
            for c in part.columns:
                assert c == "sale_id" or found[r["sale_id"]][f"{name}_{c}"] == r[c], (name, c, r)
    assert sum(r["tenure_rented"] for r in found.values()) and sum(r["episode_permit_confirmed"] or 0 for r in found.values())


def test_sales_meet_events_once(spark):
    q = all_queries()["asm_sale_features"](spark, SF)
    plan = q._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [l_orderkey") == 1 and plan.count("Join ") <= 16


def test_widths_of_a_band_share_their_evidence(spark, monkeypatch):
    """Targets of unlike dates begin with cells of unlike widths; evidence goes to few groups, not to one for each width."""
    rng = random.Random(5)
    e = spark.createDataFrame([(i, i % 997, rng.uniform(0, 1e4), rng.uniform(0, 1e4), i % 28, 1.0) for i in range(20_000)], "evidence_id long, parcel_id long, x_m double, y_m double, q int, v double")
    t = e.withColumnRenamed("evidence_id", "target_id").drop("v")
    seen = spark.sparkContext.accumulator(0)
    near = geometry._nearest_in_cells

    def counted(t, e, **k):
        seen.add(len(e))
        return near(t, e, **k)

    monkeypatch.setattr(geometry, "_nearest_in_cells", counted)
    found = geometry.k_nearest(t, e, 15, 100.0, 1, "v", "q").groupBy("target_id").count()
    assert found.where("count <> 15").isEmpty() and found.count() == e.where("q > 0").count()
    assert seen.value < 4.5 * 20_000, seen.value
