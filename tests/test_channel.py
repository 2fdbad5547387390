"""The channel gap in stages against numpy's least squares with the same weights."""

import numpy as np
import pandas as pd
import pytest

from tallyroll.operators import channel
from tallyroll.plans import crossfit_queries

SF = "/root/testdata/sf0.001"


def design(p, stage):
    dummies = lambda c: [(p[c].isna() if v is None else p[c] == v).astype(float) for v in [None, *sorted(p[c].dropna().unique())][1:]]
    out = [np.ones(len(p)), *dummies("district")]
    bad = p[["delinquent", "violations"]].fillna(0.0)
    if stage != "raw":
        out += [np.log1p(p["area"]), p["beds"].fillna(p["beds"].median()), *dummies("style")]
    if stage in ("distress", "interaction"):
        out += [bad["delinquent"], bad["violations"]]
    out.append(p["cash"].astype(float))
    if stage == "interaction":
        out.append(p["cash"] * (bad.sum(axis=1) > 0))
    return np.column_stack(out).astype(float)


def fit(p, stage, w=None):
    x, y = design(p, stage), np.log(p["sale_price"]) + p["time_adj_log"].fillna(0.0)
    w = np.ones(len(p)) if w is None else np.sqrt(w)
    return np.linalg.lstsq(x * w[:, None], y * w, rcond=None)[0]


@pytest.fixture(scope="module")
def sales(spark):
    return crossfit_queries.channel_sales(spark, SF).cache()


def test_stages_and_interval(spark, sales):
    from pyspark.sql import functions as F

    table, both = channel.decompose(sales, *crossfit_queries.CHANNEL_INPUTS, draws=40)
    p = sales.withColumn("digest", F.xxhash64("sale_id")).toPandas()
    p = p[p["district"].notna() & (p["sale_price"] > 0)].reset_index(drop=True)
    cuts = np.quantile(p["sale_price"], [0.2, 0.4, 0.6, 0.8])
    parts = {"overall": p} | {f"q{k}": p[np.digitize(p["sale_price"], cuts) + 1 == k] for k in range(1, 6)}
    weights = channel.poisson_weights(p["digest"].to_numpy().view(np.uint64), 40)
    rows = {(r["segment"], r["stage"]): r for r in table.collect()}
    assert len(rows) == 18
    for (segment, stage), r in rows.items():
        assert r["n"] == len(parts[segment])
        assert r["cash_discount_pct"] == pytest.approx(np.exp(fit(parts[segment], stage)[-1]) - 1, abs=1e-9)
        if segment == "overall":
            boots = [fit(p, stage, weights[:, b])[-1] for b in range(40)]
            assert [r["ci_low"], r["ci_high"]] == pytest.approx(list(np.exp(np.quantile(boots, [0.025, 0.975])) - 1), abs=1e-9)
            assert r["ci_low"] < r["cash_discount_pct"] < r["ci_high"]
        else:
            assert r["ci_low"] is None
    b, more = fit(p, "interaction")[-2:]
    assert both["clean"] == pytest.approx(np.exp(b) - 1) and both["distressed"] == pytest.approx(np.exp(b + more) - 1)


def test_weights_are_poisson():
    w = channel.poisson_weights(np.arange(200_000, dtype=np.uint64) * np.uint64(7919), 3)
    assert np.allclose(w.mean(axis=0), 1, atol=0.02) and np.allclose(w.var(axis=0), 1, atol=0.03)
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.01


def test_edges(spark, sales):
    assert channel.decompose(sales.limit(0), *crossfit_queries.CHANNEL_INPUTS)[0].count() == 0
    few = channel.decompose(sales.where("cash"), *crossfit_queries.CHANNEL_INPUTS, draws=3)[0].toPandas()
    assert isinstance(few, pd.DataFrame) and np.isfinite(few["cash_discount_pct"]).all()
