"""Areas in one piece, and votes of the nearest sale points, against brute force."""

import math
import random
from collections import Counter

from tallyroll.operators import geometry, models


def pockets_of(points, radius):
    """area -> sizes of its connected pockets."""
    out = {}
    for area in {p[3] for p in points}:
        left = {p[0]: p for p in points if p[3] == area}
        sizes = []
        while left:
            todo, n = [left.pop(next(iter(left)))], 0
            while todo:
                q = todo.pop()
                n += 1
                near = [i for i, p in left.items() if math.dist(p[1:3], q[1:3]) <= radius]
                todo += [left.pop(i) for i in near]
            sizes.append(n)
        out[area] = sorted(sizes, reverse=True)
    return out


def test_areas_are_in_one_piece(spark):
    rng = random.Random(2)
    blob = lambda n, x, y, a: [(x + rng.uniform(0, 500), y + rng.uniform(0, 500), a) for _ in range(n)]
    rows = blob(90, 0, 0, "a") + blob(60, 9000, 0, "a") + blob(5, 5000, 50, "a") + blob(80, 5200, 0, "b") + [(60_000.0, 60_000.0, "b"), (60_010.0, 60_000.0, "a")] + blob(3, 9200, 900, "b")
    points = [(i, *r) for i, r in enumerate(rows)] + [(900, None, 1.0, "a"), (901, 1.0, 1.0, None)]
    got = {r["point_id"]: (r["area"], r["parent"]) for r in geometry.contiguous_areas(spark.createDataFrame(points, "point_id long, x_m double, y_m double, area string"), "area").collect()}
    placed = [p for p in points if p[1] is not None and p[3] is not None]
    assert sorted(got) == sorted(p[0] for p in placed)
    assert all(len(s) == 1 for s in pockets_of([(p[0], p[1], p[2], got[p[0]][0]) for p in placed], 300.0).values())
    of = lambda lo, hi: {got[i] for i in range(lo, hi)}
    assert of(0, 90) == {("a", "a")}
    assert len(of(90, 150)) == 1 and next(iter(of(90, 150)))[1] == "a" and of(90, 150) != {("a", "a")}  # a large pocket of its own
    assert of(155, 235) == {("b", "b")} and of(150, 155) == {("b", "b")}  # strays join the nearest area
    assert got[235][0] == got[236][0] not in ("a", "b")  # strays far from everything stay together, in an area of their own


def test_votes(spark):
    rng = random.Random(3)
    sold = [(i, rng.uniform(0, 1000), rng.uniform(0, 1000), rng.randrange(4)) for i in range(120)]
    parcels = [(i, rng.uniform(-500, 1500), rng.uniform(0, 1000)) for i in range(60)] + [(100, None, 3.0), (101, 90_000.0, 0.0)]
    got = geometry.vote_areas(spark.createDataFrame(parcels, "parcel_id long, x_m double, y_m double"), spark.createDataFrame(sold, "point_id long, x_m double, y_m double, area int"), 7, 100.0)
    got = {r["parcel_id"]: r["area"] for r in got.collect()}
    for i, x, y in parcels:
        if x is None:
            assert got[i] is None
            continue
        near = sorted(sold, key=lambda s: (math.dist((x, y), s[1:3]), s[0]))[:7]
        n = Counter(s[3] for s in near)
        assert got[i] == min(n, key=lambda a: (-n[a], a))
    assert len(got) == len(parcels)


def test_districts_hold_the_areas(spark):
    sold = spark.createDataFrame([(i, float(i % 10 // 5 * 9000 + i % 5), 1.0 * (i % 3), i % 10, float(i)) for i in range(100)], "point_id long, x_m double, y_m double, area int, level double")
    got = {r["area"]: r for r in models.districts(sold, 2).collect()}
    assert len(got) == 10 and all(r["n"] == 10 and r["level"] == 45.0 + a for a, r in got.items())
    assert len({r["district"] for a, r in got.items() if a < 5}) == 1 and got[0]["district"] != got[5]["district"]


def test_components_of_long_chains_and_dense_spots(spark):
    """Chains of hundreds of steps settle; spots of many points, places unknown and steps just beyond reach are told apart."""
    rng = random.Random(5)
    ids = list(range(700))
    rng.shuffle(ids)
    rows = [(ids[i], i * 99.0, 0.0) for i in range(200)]
    rows += [(ids[200 + i], rng.uniform(0, 1500), 5000 + rng.uniform(0, 1500)) for i in range(300)]
    rows += [(ids[500 + i], 9e4 + rng.uniform(0, 40), 9e4 + (i % 2) * 139.0) for i in range(198)]
    rows += [(ids[698], None, 0.0), (ids[699], 199 * 99.0 + 100.001, 0.0)]
    parent = {r[0]: r[0] for r in rows}

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, x, y in rows:
        for j, a, b in rows:
            if None not in (x, a) and (x - a) ** 2 + (y - b) ** 2 <= 100.0**2:
                p, q = sorted((root(i), root(j)))
                parent[q] = p
    got = {r["point_id"]: r["component"] for r in geometry.near_components(spark.createDataFrame(rows, "point_id long, x_m double, y_m double"), 100.0).collect()}
    assert got == {i: root(i) for i in parent}
