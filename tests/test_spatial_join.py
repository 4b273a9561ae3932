import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracksmith.functions.geo import haversine_np
from tracksmith.operators.spatial_join import near_and_within, rings_of, triangulate

REGIONS = [
    (1, "POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0), (0.5 0.5, 1.5 0.5, 1.5 1.5, 0.5 1.5, 0.5 0.5), (0.1 0.1, 0.3 0.1, 0.2 0.3, 0.1 0.1))"),
    (2, "POLYGON ((2 0, 4 0, 4 1, 3 1, 3 2, 2 2, 2 0))"),
    (3, "polygon ((5 5, 7 5, 6 6, 7 7, 5 7, 5.5 6, 5 5))"),
    (4, "MULTIPOLYGON (((8 0, 9 0, 9 1, 8 0)), ((8 2, 9 2, 9 3, 8 3, 8 2)))"),
    (5, None), (6, "POINT (1 1)"), (None, "POLYGON ((0 0, 1 0, 1 1, 0 0))"),
]


def inside(wkt, x, y):
    odd = lambda ring: sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(ring, ring[1:] + ring[:1])) % 2
    return any(odd(rings[0]) and not any(odd(h) for h in rings[1:]) for rings in rings_of(wkt))


def run(spark, points, others, **options):
    p = spark.createDataFrame([(i, la, lo, 0, "x") for i, la, lo in points], "pid long, y double, x double, id long, kind string")
    r = spark.createDataFrame([(i, g, 1) for i, g in REGIONS], "rid long, shape string, id long")
    o = spark.createDataFrame([(i, la, lo, 1) for i, la, lo in others], "oid long, la double, lo double, id long")
    got = near_and_within(p, "pid", F.col("y"), F.col("x"), r, "rid", "shape", o, "oid", "la", "lo", 5000.0, **options).collect()
    return sorted(map(tuple, got))


@pytest.mark.parametrize("broadcast_items", [100_000, 3])
def test_against_brute_force(spark, broadcast_items):
    rng = random.Random(2)
    points = [(i, rng.uniform(-1, 8), rng.uniform(-1, 10)) for i in range(600)] + [(1000 + i, 1.0, 2.5 + i * 1e-6) for i in range(300)]
    others = [(i, rng.uniform(-1, 8), rng.uniform(-1, 10)) for i in range(300)]
    want = [(p, "region", r) for p, la, lo in points for r, g in REGIONS if r and inside(g, lo, la)]
    ola, olo = np.array([o[1] for o in others]), np.array([o[2] for o in others])
    for p, la, lo in points:
        want += [(p, "point", others[j][0]) for j in np.nonzero(haversine_np(la, lo, ola, olo) <= 5000)[0]]
    assert run(spark, points + points[:40], others, broadcast_items=broadcast_items) == sorted(want)


def test_shared_border_goes_to_the_smallest_id_and_holes_are_out(spark):
    got = run(spark, [(1, 1.0, 2.0), (2, 1.0, 1.0), (3, 0.15, 0.2), (4, 0.05, 0.05)], [])
    assert got == [(1, "region", 1), (4, "region", 1)]


def test_nulls_and_empty(spark):
    points = [(1, None, 1.0), (2, float("nan"), 1.0), (None, 0.1, 0.1)]
    assert run(spark, points, [(1, None, 1.0), (2, 0.1, float("nan"))]) == []
    assert run(spark, [], []) == []


def test_triangles_cover_a_comb():
    ring = [(0, 0)] + [p for i in range(6) for p in ((i + 0.5, 3), (i + 1, 1))] + [(6, 0)]
    area = lambda r: sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:] + r[:1])) / 2
    assert abs(sum(area(list(t)) for t in triangulate([ring])) - abs(area(ring))) < 1e-9


def area(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1])) / 2


def covered(triangles, x, y):
    side = lambda a, b: (b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0])
    return any(side(a, b) >= 0 and side(b, c) >= 0 and side(c, a) >= 0 for a, b, c in triangles)


@pytest.mark.parametrize("rings", [
    [[(0, 0), (10, 10), (10, 0), (0, 10)]],
    [[(0, 0), (6, 0), (6, 4), (2, 4), (2, -2), (4, -2), (4, 6), (0, 6)]],
    [[(0, 0), (8, 0), (8, 8), (0, 8)], [(6, 3), (10, 3), (10, 5), (6, 5)]],
    [[(5, 0), (8, 9), (0, 3), (10, 3), (2, 9)]],
])
def test_crossing_rings_are_inside_by_odd_number(rings):
    rng = random.Random(1)
    odd = lambda ring, x, y: sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(ring, ring[1:] + ring[:1]))
    triangles = triangulate([[(float(x), float(y)) for x, y in r] for r in rings])
    for _ in range(2000):
        x, y = rng.uniform(-1, 11), rng.uniform(-3, 11)
        assert covered(triangles, x, y) == bool(sum(odd(r, x, y) for r in rings) % 2)


def test_a_ring_of_two_thousand_vertices_and_many_holes():
    rng = random.Random(7)
    ring = [(math.cos(a) * r, math.sin(a) * r) for a in (2 * math.pi * k / 2000 for k in range(2000)) for r in [rng.uniform(60, 100)]]
    holes = [[(x, y), (x + 1, y), (x + 1.0, y + 2), (x, y + 1)] for x in range(-30, 30, 10) for y in range(-30, 30, 10)]
    began = time.time()
    out = triangulate([ring, *holes])
    assert time.time() - began < 10
    assert abs(sum(area(list(t)) for t in out) - abs(area(ring)) + sum(abs(area(h)) for h in holes)) < 1e-6


@pytest.mark.parametrize("broadcast_items", [100_000, 3])
def test_no_link_is_lost_at_meridian_and_poles(spark, broadcast_items):
    rng = random.Random(3)
    spots = [(0.0, -179.9999), (0.0, 179.9999), (1.0, 180.0), (1.0, -180.0), (89.999, 10.0), (89.999, -170.0), (-90.0, 0.0), (-89.99, 77.0), (90.0, 5.0), (60.0, 179.97), (60.0, -179.99), (-75.0, -179.9), (-75.0, 179.95)]
    spots += [(rng.choice([-1, 1]) * rng.uniform(80, 90), rng.uniform(-180, 180)) for _ in range(200)] + [(rng.uniform(-60, 60), rng.choice([-1, 1]) * rng.uniform(179.9, 180)) for _ in range(200)]
    points = [(i, la, lo) for i, (la, lo) in enumerate(spots)]
    la, lo = np.array([s[0] for s in spots]), np.array([s[1] for s in spots])
    want = sorted((p, "point", int(j)) for p, a, o in points for j in np.nonzero(haversine_np(a, o, la, lo) <= 5000)[0])
    got = [r for r in run(spark, points, points, broadcast_items=broadcast_items) if r[1] == "point"]
    assert got == want and (0, "point", 1) in got


def test_many_items_by_tiles(spark):
    # pairs 11 m and 55 m apart on a lattice of 400 x 400, and a crowd of items in one place
    n = 160_000
    at = lambda i: ((F.floor(i / 400) * 0.01).alias("la"), (F.pmod(i, F.lit(400)) * 0.01).alias("lo"))
    base = spark.range(n).select("id", *at(F.col("id")))
    crowd = spark.range(60_000).select((F.col("id") + n).alias("id"), F.lit(2.5).alias("la"), (F.lit(1.7) + F.col("id") * 1e-9).alias("lo"))
    points = base.select("id", (F.col("la") + 0.0001).alias("la"), "lo")
    none = spark.createDataFrame([], "c long, g string")
    found = near_and_within(points, "id", F.col("la"), F.col("lo"), none, "c", "g", base.unionByName(crowd), "id", "la", "lo", 20.0)
    got = found.select(F.count(F.lit(1)), F.sum((F.col("target_id") == F.col("id")).cast("long")), F.sum((F.col("target_id") >= n).cast("long"))).first()
    assert tuple(got) == (n + 60_000, n, 60_000)
