"""Order statistics within groups: the way over all tasks gives the rows of the way in one."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyroll.operators import ranks, ratio
from tallyroll.sources import lake


@pytest.fixture(scope="module")
def pairs(spark):
    rng = random.Random(8)
    rows = [("hot" if i % 10 else None, i % 3, rng.choice((1e5, 2e5, rng.uniform(5e4, 9e5))), rng.uniform(0.4, 1.9)) for i in range(1600)]
    rows += [("small", 0, 1e5, 1.0), ("small", 0, 1e5, 1.1), ("mid", 1, 1e5, 1.0)] + [("forty", 1, 1e5 + i, 1 + i / 50) for i in range(40)]
    df = spark.createDataFrame([(k, g, s * r, s) for k, g, s, r in rows], "k string, g int, a double, s double")
    return ratio.clean_pairs(df, "a", "s").cache()


def rows_of(df):
    return sorted((tuple(f"{v:.9g}" if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)


@pytest.mark.parametrize("keys", [[], ["k"], ["k", "g"]])
def test_large_groups_give_the_same_rows(pairs, monkeypatch, keys):
    forms = {
        "metrics": lambda: ratio.ratio_metrics(pairs, keys),
        "vei": lambda: ratio.vertical_equity(pairs, keys),
        "trim": lambda: ratio.iqr_trim(pairs, keys).groupBy(*keys).agg(F.count_if("is_outlier").alias("out"), F.count(F.lit(1)).alias("n"), F.max("q3").alias("q3")),
        "ends": lambda: ratio.ends_by(pairs, "sale", keys),
        "tiers": lambda: ratio.tier_redistribution(pairs, "est", "sale", keys),
    }
    plain = {n: rows_of(f()) for n, f in forms.items()}
    assert sum(r[-2] for r in plain["trim"]) == pairs.count()  # null keys are groups too
    monkeypatch.setattr(ranks, "IN_ONE_TASK", 5)
    for n, f in forms.items():
        assert rows_of(f()) == plain[n], n


def test_a_hot_group_runs_in_many_tasks(spark, pairs, request):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the rows are few
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    one = pairs.withColumn("all", F.lit(1))
    out = ranks.running(one, ["all"], ["r", "sale", "est"], "at", in_one_task=5)
    got = out.select("r", "at", F.spark_partition_id().alias("p")).toPandas()
    assert got["p"].nunique() > 1 and sorted(got["at"]) == list(range(1, len(got) + 1))
    assert (got.sort_values("at")["r"].diff().dropna() >= 0).all()
    summed = ranks.running(one, ["all"], ["r", "sale", "est"], "at", F.col("sale"), in_one_task=5).toPandas().sort_values(["r", "sale", "est"])
    assert np.allclose(summed["at"], summed["sale"].cumsum())


def test_quantiles(pairs):
    shares = {"lo": 0.2, "mid": 0.5, "hi": 0.995}
    for limit in (10**9, 5):
        got = {r["k"]: r for r in ranks.group_quantiles(pairs, ["k"], "r", shares, in_one_task=limit).collect()}
        for k, v in pairs.toPandas().groupby("k", dropna=False)["r"]:
            k = None if k != k else k
            assert [got[k][n] for n in shares] == pytest.approx(list(np.quantile(v, list(shares.values()))), rel=1e-12) and got[k]["_n"] == len(v)
    assert ranks.quantile(pairs, "r", 0.37) == pytest.approx(np.quantile(pairs.toPandas()["r"], 0.37))
    assert ranks.quantile(pairs.limit(0), "r", 0.37) is None


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Unset:
        master = "spark://host:7077"

        def get(self, *a):
            return None

        def getConf(self):
            return self

    class Session:
        conf = sparkContext = Unset()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        lake.scratch(Session(), "x")
