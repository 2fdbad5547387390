"""Language profiles by held-out accuracy, nearest neighbours by recall against brute force."""

import numpy as np
from pyspark.sql import functions as F

from tallyroll.llm import ann, langid, registry

SF = "/root/testdata/sf0.001"


def test_language_profiles_hold_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = registry.op2_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    held = [r for r in got if r["held_out"]]
    assert len(held) > 150 and sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_profiles_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text", "lang")
    learned = langid.learn(docs)
    odd = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (3, "12 + 34!", 0.5), (4, "The thing", 0.5), (4, "The thing", 0.5), (5, "\u4e2d\u6587" * 9000, 0.1)], "id long, text string, score double")
    got = {(r["id"], r["lang_pred"]) for r in langid.predict(odd, learned).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (4, "en")} <= got and len(got) == 5
    assert langid.learn(docs.limit(0)) == {}
    assert {r["lang_pred"] for r in langid.predict(odd, {}).collect()} == {"und"}


def test_bundle_is_the_sum_of_bound_vectors():
    p = langid.Profiles(256)
    keys, n = langid.grams("Ab, abc ab")
    want = np.zeros(256)
    v = lambda c: p.vectors(np.array([c]))[0]
    for s in (" ab", "ab ", "b a", " ab", "abc", "bc ", "c a", " ab", "ab "):
        a, b, c = (ord(x) if x != " " else 0 for x in s)
        want += np.roll(v(a), 2) * np.roll(v(b), 1) * v(c)
    assert np.allclose(p.bundle(keys, n), want) and n.sum() == 9


def test_bundle_of_many_letters_in_blocks():
    rng = np.random.default_rng(2)
    text = "".join(map(chr, rng.integers(0x4E00, 0x9F00, 20_000)))
    keys, n = langid.grams(text)
    p = langid.Profiles(64)
    want = np.zeros(64)
    for key, c in zip(keys.tolist(), n.tolist()):
        a, b, z = (p.vectors(np.array([(key >> s) & (2**21 - 1)]))[0] for s in (42, 21, 0))
        want += c * np.roll(a, 2) * np.roll(b, 1) * z
    assert np.array_equal(p.bundle(keys, n), want)


def test_neighbours_of_few_in_a_leaf(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(800, 6)) * 50
    rows = [(i, (centres[i % 800] + rng.normal(size=6) * 0.01).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(df, F.col("vec_id") % 100 == 0, recall=0.3).groupBy("query_id").count().collect()
    assert len(got) == 30 and all(r["count"] == 10 for r in got)


def test_neighbours_recall(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    x = {r["vec_id"]: np.array(r["embedding"], float) for r in vectors.collect()}
    ids = np.array(sorted(x))
    m = np.stack([x[i] for i in ids])
    got = {}
    for r in registry.op5_nearest_neighbours(spark, "/root/testdata/sf0.1").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {i for i in x if i % 100 == 0}
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((m - x[q]) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 11))
        assert all(abs(s - np.sqrt(((x[v] - x[q]) ** 2).sum())) < 1e-12 for _, v, s in found)
        hits += len({int(ids[i]) for i in order} & {v for _, v, _ in found})
    assert hits >= 0.9 * 10 * len(got)


def test_neighbours_odd_rows(spark):
    same = [(i, [1.0, 2.0, 3.0]) for i in range(0, 60)]
    odd = [(100, None), (101, [0.0, 0.0, 0.0]), (102, [1.0, float("nan"), 0.0]), (103, [1.0, None, 0.0]), (104, [1.0, 2.0]), (105, [float("inf"), 0.0, 1.0]), (None, [1.0, 1.0, 1.0])]
    rows = same + same[:3] + odd + [(200 + i, [float(i), 1.0, 0.0]) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(1))
    got = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0, k=4, recall=1.0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert sorted(got[0]) == [(1, 1), (2, 2), (3, 3), (4, 4)] and sorted(got[20]) == [(1, 0), (2, 1), (3, 2), (4, 3)]
    assert sorted(got[220]) == [(1, 219), (2, 221), (3, 218), (4, 222)] and 100 not in got
    assert ann.search(df.limit(0), F.lit(True)).count() == 0
    assert ann.search(df.where("vec_id = 3"), F.lit(True)).count() == 0


def test_bundles_are_exact_without_a_copy_in_double_precision(monkeypatch):
    rng = np.random.default_rng(3)
    keys = np.unique((rng.integers(97, 123, (400, 3)) << np.array([42, 21, 0])).sum(axis=1))
    einsum, seen = np.einsum, []
    monkeypatch.setattr(np, "einsum", lambda *a, **k: seen.append((k.get("dtype"), {x.dtype for x in a[1:]})) or einsum(*a, **k))
    for most, kind in ((9, np.float32), (2**22, np.float64)):  # in all below and above 2 ** 24
        counts = rng.integers(1, most, len(keys))
        p = langid.Profiles(64)
        v = lambda c, k: np.roll(p.vectors(np.array([c]))[0].astype(np.int64), k)
        want = sum(n * v(k >> 42, 2) * v((k >> 21) & (2**21 - 1), 1) * v(k & (2**21 - 1), 0) for k, n in zip(keys.tolist(), counts.tolist()))
        got = p.bundle(keys, counts)
        assert got.dtype == np.float64 and (got == want).all()
        assert all(d is None and max(t.itemsize for t in types) == np.dtype(kind).itemsize for d, types in seen) and seen
        seen.clear()
