"""The Jaccard join against all pairs."""

import random

import numpy as np
import pytest

from tallyroll.llm import components, jaccard

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, node string"


def brute(rows, width, percent):
    sets = []
    for _, text in rows:
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({c: " " for c in range(9, 14)}).split(" ")
        words = [w for w in words if w]
        sets.append({tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def planted(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = [(900, None), (901, ""), (902, " \n\t"), (903, "One"), (904, "one"), (905, "a b c"), (906, "A b\nc"), (907, "a b c d"), (908, "a b c d e")]
    for base in range(12):
        n = rng.choice([8, 20, 40, 90, 300])
        words = [word() for _ in range(n)]
        for copy in range(rng.choice([1, 2, 6, 25])):
            w = list(words)
            for _ in range(rng.choice([0, 1, 1, 2, 2, 3, n // 40, n // 30])):
                w[rng.randrange(n)] = word()
            rows.append((100 * base + copy, " ".join(w)))
            if copy % 5 == 0:
                rows.append((5000 + 100 * base + copy, " ".join(w).upper()))
    return rows


@pytest.mark.parametrize("seed,width,percent", [(1, 4, 85), (2, 5, 80)])
def test_components_of_planted_copies(spark, seed, width, percent):
    rows = planted(seed)
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA).repartition(5)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.link(df, width, percent).collect())
    assert got == brute(rows, width, percent)


def test_components_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.link(docs).collect())
    assert got == brute(rows, 4, 85)
    assert jaccard.link(docs.limit(0)).count() == 0


def test_no_similar_pair_escapes_the_blocks():
    rng = np.random.default_rng(3)
    bands = jaccard.Bands(85)
    for _ in range(300):
        n = int(rng.integers(6, 900))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = a
        while True:  # the least similar set that still links
            c = b[rng.permutation(len(b))[1:]] if rng.random() < 0.5 else np.append(b, rng.integers(0, 2**63).astype(np.uint64))
            if 100 * len(np.intersect1d(a, c)) < 85 * len(np.union1d(a, c)):
                break
            b = np.unique(c)
        owner, key = jaccard.block_keys([a, b], bands)
        assert len(np.setxor1d(a, b)) == 0 or set(key[owner == 0]) & set(key[owner == 1])
        assert jaccard.hamming(jaccard.sketch(a), jaccard.sketch(b)) <= len(np.setxor1d(a, b))


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(0, 90)] + [(200, 201), (7, 7), (201, 200)]
    got = {r["node"]: r["root"] for r in components.roots(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(91)) and got[200] == got[201] == 200
    assert components.roots(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rows_without_an_id_link_too(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(None, " ".join(words)), (4, " ".join([*words, "x"])), (None, " ".join(f"v{i}" for i in range(30))), (None, None), (3, "alone here is one")]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA)
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in jaccard.link(df).collect())
    assert got == [(0, 0, 0), (0, 27, 0), (0, 57, 4), (3, 1, 3), (4, 58, 4)]


def test_rows_that_share_an_id_are_found_by_their_own_text(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    near = [" ".join([*words[:k], "other", *words[k + 1 :]]) for k in (0, 30, 59)]
    rows = [(d, t, "x") for d in (None, 7) for t in near] + [(7, " ".join(f"{rng.random()}" for _ in range(40)), "x") for _ in range(50)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = jaccard.link(df).collect()
    assert len(got) == len(rows) and {r["component_id"] for r in got} == {7}
    nodes = {r["node"] for r in got}
    assert len(nodes) == 53
    drawn = jaccard._draw(df, "text", "doc_id", 4, 85, 4).groupBy("bucket").applyInArrow(jaccard._meet, jaccard.FOUND)
    keys = {r["row"] for r in drawn.where("kind = 0").collect()}
    assert len(keys) == len(rows)  # no two of them meet under one key


def test_groups_go_on_merged(spark):
    # Three blocks of the same torn nodes are one group by their smallest root; it goes on with a row for each node.
    members = spark.createDataFrame([(g, n) for g in (91, 92, 93) for n in range(10, 15)] + [(94, 50), (94, 51)], "group long, node long")
    root = spark.createDataFrame([(11, 10), (51, 50)], "node long, root long")
    _, rows = jaccard._torn(members, root)
    close = spark.createDataFrame([(10, 12, 10), (10, 13, 10), (11, 14, None)], "a long, b long, cut long")
    assert sorted(tuple(r) for r in jaccard._cut_short(rows, close).collect()) == [(10, n) for n in range(10, 15)]
