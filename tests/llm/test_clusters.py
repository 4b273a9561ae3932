import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tracksmith.functions.geo import haversine_np
from tracksmith.llm.clusters import candidate_cells, clean_code, connected_components, describe_clusters, full_codes, similarity_clusters

M = 1 / 111_195.0


def run(spark, rows):
    df = spark.createDataFrame([(i, la, lo, c, 1, 2) for i, la, lo, c in rows], "rid long, la double, lo double, c string, x long, n long")
    return similarity_clusters(df, "rid", F.col("la"), F.col("lo"), F.col("c"))


def brute(rows, reach=100.0):
    rows = list({r[0]: r for r in rows if r[0] is not None}.values())
    placed = [r for r in rows if r[1] is not None and r[1] == r[1]]
    parent = {r[0]: r[0] for r in placed}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, p in enumerate(placed):
        for q in placed[k + 1 :]:
            if haversine_np(p[1], p[2], q[1], q[2]) <= reach:
                a, b = sorted((find(p[0]), find(q[0])))
                parent[b] = a
    size = Counter(find(r[0]) for r in placed)
    return {r[0]: find(r[0]) for r in placed if size[find(r[0])] >= 3}


def test_positions_against_brute_force(spark):
    rng = random.Random(9)
    rows = []
    for i in range(500):
        kind = rng.random()
        la, lo = (12 + rng.gauss(0, 30 * M), 140 + rng.gauss(0, 30 * M)) if kind < 0.3 else (12 + rng.uniform(0, 3500 * M), 140 + rng.uniform(0, 3500 * M))
        rows.append((1000 - i, la, lo, None))
    # two dense spots whose nearest points are a little more, or a little less, than 100 m apart
    for k, gap in enumerate((99.0, 101.0)):
        base = 13 + k * 0.1
        for i in range(60):
            rows.append((5000 + 200 * k + i, base - rng.uniform(0, 40) * M, 141 + rng.uniform(-20, 20) * M, None))
            rows.append((5100 + 200 * k + i, base + (gap + rng.uniform(0, 40)) * M, 141 + rng.uniform(-20, 20) * M, None))
        rows += [(5090 + 200 * k, base, 141.0, None), (5190 + 200 * k, base + gap * M, 141.0, None)]
    rows += rows[:30]
    got = run(spark, rows)
    assert {r["rid"]: r["cluster_id"] for r in got["members"].collect()} == brute(rows)
    described = describe_clusters(got["cells"]).collect()
    assert Counter({r["cluster_id"]: 0 for r in described}) is not None
    total = defaultdict(int)
    for r in described:
        total[r["cluster_id"]] += r["n_records"]
    assert total == Counter(brute(rows).values())


def test_codes_attach_records_without_position(spark):
    a, b = "aaaabbbbcccc" + "1" * 20, "ddddeeeeffff" + "2" * 20
    rows = [(i, 12.0, 140.0, a) for i in range(1, 5)] + [(i, 12.1, 140.0, b) for i in range(11, 15)] + [(20, 12.0, 140.0, b)]
    rows += [(30, None, None, "place:" + a.upper()), (31, None, None, a[:14] + "..."), (32, None, None, " " + b[:12]), (33, float("nan"), 140.0, b), (34, None, None, "ffff"), (35, None, None, None), (None, 12.0, 140.0, a)]
    got = {r["rid"]: r["cluster_id"] for r in run(spark, rows)["members"].collect()}
    assert got == {**{i: 1 for i in (1, 2, 3, 4, 20, 30, 31)}, **{i: 11 for i in (11, 12, 13, 14, 32, 33)}}


def test_empty(spark):
    got = run(spark, [])
    assert got["members"].collect() == [] and describe_clusters(got["cells"]).collect() == []
    assert run(spark, [(1, None, None, "x"), (2, 12.0, 140.0, None), (3, 12.0, 140.0, None)])["members"].collect() == []


@pytest.mark.parametrize("n", [1, 60])
def test_components_of_a_path_and_a_star(spark, n):
    edges = [(i, i + 1) for i in range(n)] + [(1000, 1001 + i) for i in range(n)]
    nodes = sorted({x for e in edges for x in e} | {7777})
    got = connected_components(spark.createDataFrame([(x,) for x in nodes], "node long"), spark.createDataFrame(edges, "a long, b long"))
    assert {r[0]: r[1] for r in got.collect()} == {x: 7777 if x == 7777 else 1000 if x >= 1000 else 0 for x in nodes}


def test_code_forms(spark):
    df = spark.createDataFrame([("place: AB.c ",), ("...",), (None,)], "c string").select(clean_code(F.col("c")).alias("c"))
    assert [r[0] for r in df.collect()] == ["abc", None, None]
    codes = spark.createDataFrame([("abcdefghijkl", 1), ("abcdefghijklmn", 1), ("abcdefghijklmnop", 5), ("abcdefghijklzz", 1), ("abc", 1)], "code string, n long")
    got = dict(map(tuple, full_codes(codes).collect()))
    assert got == {"abcdefghijkl": "abcdefghijklmnop", "abcdefghijklmn": "abcdefghijklmnop", "abcdefghijklmnop": "abcdefghijklmnop", "abcdefghijklzz": "abcdefghijklzz", "abc": "abc"}


def test_loose_clusters_are_split_around_dense_spots_and_tight_ones_are_not(spark):
    rng = random.Random(3)
    spot = lambda la, lo, n, first: [(first + i, la + rng.uniform(-60, 60) * M, lo + rng.uniform(-60, 60) * M, None) for i in range(n)]
    # two dense spots 900 m apart, joined by a chain of records 80 m apart
    loose = spot(12.0, 140.0, 60, 100) + spot(12.0 + 900 * M, 140.0, 60, 200) + [(300 + i, 12.0 + i * 80 * M, 140.0, None) for i in range(12)]
    tight = [(500 + i, 13.0 + rng.uniform(-40, 40) * M, 141.0 + rng.uniform(-40, 40) * M, None) for i in range(50)]
    got = run(spark, loose + tight)
    parts = describe_clusters(got["cells"]).collect()
    of = lambda c: [r for r in parts if r["cluster_id"] == c]
    assert len(of(100)) >= 2 and sum(r["n_records"] for r in of(100)) == 132
    assert len(of(500)) == 1 and of(500)[0]["n_records"] == 50
    # the two largest parts lie around the two spots
    large = sorted(of(100), key=lambda r: -r["n_records"])[:2]
    where = {r[0]: r[1] for r in loose}
    assert {round((where[r["medoid"]] - 12.0) / (900 * M)) for r in large} == {0, 1}


def test_sizes_count_records_attached_by_code(spark):
    rng = random.Random(4)
    spot = lambda la, first, c: [(first + i, la + rng.uniform(-40, 40) * M, 140.0 + rng.uniform(-40, 40) * M, c) for i in range(40)]
    # two spots of one cluster, 900 m apart, each with a code of its own, and a cluster of one spot
    rows = spot(12.0, 100, "north") + spot(12.0 + 900 * M, 200, "south") + [(300 + i, 12.0 + i * 80 * M, 140.0, None) for i in range(12)] + spot(13.0, 500, "far")
    rows += [(700 + i, None, None, c) for i, c in enumerate(["north"] * 3 + ["south"] * 5 + ["far"] * 7 + ["nowhere"])] + [(700, None, None, "north")]
    got = run(spark, rows)
    described = describe_clusters(got["cells"]).collect()
    total = Counter()
    for r in described:
        total[r["cluster_id"]] += r["n_records"]
    assert total == Counter(r["cluster_id"] for r in got["members"].collect()) == {100: 100, 500: 47}
    at = {r["part"]: r["attached"] for r in got["cells"].collect() if r["attached"]}
    where = {r[0]: r[1] for r in rows}
    assert sorted((round((where[k] - 12.0) / (900 * M)), n) for k, n in at.items() if k < 500) == [(0, 3), (1, 5)]


def test_drawn_permutations_find_nearly_all_and_chosen_ones_the_rest(spark):
    rng = random.Random(12)
    cells = {(rng.randrange(-40, 40), rng.randrange(-40, 40)): rng.choice([None, "a", "b", "c"]) for _ in range(900)}
    df = spark.createDataFrame([(x, y, c) for (x, y), c in cells.items()], "x long, y long, code string")
    span = 2
    near = {(a, b) for a in cells for b in cells if a < b and max(abs(a[0] - b[0]), abs(a[1] - b[1])) <= span}
    adjacent = {(a, b) for a, b in near if max(abs(a[0] - b[0]), abs(a[1] - b[1])) == 1}
    pairs = lambda **how: {((r["ax"], r["ay"]), (r["bx"], r["by"])) for r in candidate_cells(df, span, **how).collect()}
    assert near <= pairs() and near <= pairs(drawn=0)
    found = pairs(chosen=False)
    assert len(found & near) > 0.9 * len(near) and len(found & adjacent) > 0.99 * len(adjacent)


def test_a_code_that_is_written_everywhere_makes_no_large_bucket(spark):
    df = spark.range(90_000).select((F.col("id") % 300 * 9).alias("x"), (F.floor(F.col("id") / 300) * 9).alias("y"), F.lit("home").alias("code"))
    assert candidate_cells(df, 2).count() == 0
