import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracksmith.operators import measures as m
from tracksmith.operators import model as mm
from tracksmith.operators import preparing as pr
from tracksmith.operators import spatial as sp
from tracksmith.operators.temporal import TemporalAggregator


def frame(spark, rows):
    return spark.createDataFrame([(u, t, float(x) if x is not None else None, float(y) if y is not None else None) for u, t, x, y in rows], "user_id long, datetime string, lon double, lat double").withColumn("datetime", F.to_timestamp("datetime"))


def test_grid_keeps_edges_and_nulls(spark):
    df = frame(spark, [(1, "2020-01-01", 0, 0), (1, "2020-01-02", 1000, 500), (1, "2020-01-03", None, 3), (2, "2020-01-01", 999, 0)])
    got = sp.GridAggregation(400).aggregate(df).orderBy("user_id", "datetime").collect()
    w = 1000 / 3
    assert [(r["lon"] and round(r["lon"], 6), r["lat"] and round(r["lat"], 6), r["labels"]) for r in got] == [(round(w / 2, 6), 125.0, 0), (round(2.5 * w, 6), 375.0, 1), (None, None, None), (round(2.5 * w, 6), 125.0, 2)]
    one = sp.GridAggregation(400).aggregate(df.where("user_id = 2")).first()
    assert (one["lon"], one["lat"]) == (999.0, 0.0)
    assert sp.GridAggregation(400, x_min=0, x_max=10, y_min=0, y_max=10).aggregate(df).where("lon is not null").count() == 1


@given(st.floats(1, 1000), st.floats(0, 1), st.floats(0.5, 200))
def test_grid_cell_is_the_one_found_by_search(size, share, resolution):
    v, n = share * size, sp.resolution_to_points(resolution, size, 0)
    w = size / (n - 1)
    k = min(math.floor(v / w), n - 2)
    assert -1e-6 <= v - k * w <= w + 1e-6 and w <= resolution + 1e-9


@settings(deadline=None, max_examples=40)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), min_size=1, max_size=40))
def test_dbscan(points):
    x, y = np.array(points, float).T
    labels = sp.dbscan(x, y, 1.5, 3)
    near = np.hypot(x[:, None] - x, y[:, None] - y) <= 1.5
    core = near.sum(1) >= 3
    assert ((labels >= 0) == (near & core).any(1)).all()
    for i, j in zip(*np.nonzero(near & core[:, None] & core)):
        assert labels[i] == labels[j]
    assert sorted(set(labels[labels >= 0])) == list(range(labels.max() + 1))


def test_clustering_takes_any_algorithm(spark):
    class Halves:
        def __init__(self, at):
            self.at = at

        def fit(self, xy):
            self.labels_ = (xy[:, 0] > self.at).astype(int) - (xy[:, 0] > 100)
            self.labels_[xy[:, 0] > 100] = -1
            return self

    df = frame(spark, [(1, "2020-01-01", 0, 0), (1, "2020-01-02", 2, 0), (1, "2020-01-03", 9, 0), (1, "2020-01-04", 500, 0), (1, "2020-01-05", None, None)])
    got = sp.ClusteringAggregator(Halves, {"at": 5}).aggregate(df).orderBy("datetime").collect()
    assert [(r["lon"], r["labels"]) for r in got] == [(1.0, 0), (1.0, 0), (9.0, 1), (500.0, -1), (None, None)]
    assert sp.ClusteringAggregator(Halves, {"at": 5}).aggregate(df, drop_noise=True).count() == 3


def test_centroid_and_shapes(spark):
    ring = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in [(0, 0), (4, 0), (4, 2), (0, 2)]))
    c = spark.range(1).select(sp.centroid(ring).alias("c")).first()["c"]
    assert (c["x"], c["y"]) == (2.0, 1.0)
    inside = lambda x, y: spark.range(1).select(sp.in_ellipse(*(F.lit(float(v)) for v in (x, y, 0, 0, 10, 0)), 0.5)).first()[0]
    assert inside(9.9, 0) and inside(-9.9, 0) and inside(0, 4.9) and not inside(0, 5.1) and not inside(10.1, 0)


def test_stop_scan(spark):
    rows = [(1, f"2020-01-01 00:{k:02d}:00", x, 0) for k, x in enumerate([0, 10, 20, 500, 510, 1500, 1510, 1520, 1530])]
    got = pr.stop_detection(frame(spark, rows), 300, "1 min", crs="EPSG:3857").orderBy("datetime").collect()
    assert [(r["is_stop"], r["lon"]) for r in got] == [(True, 10.0)] * 3 + [(False, 500.0), (False, 510.0)] + [(False, float(x)) for x in (1500, 1510, 1520, 1530)]
    tail = pr.stop_detection(frame(spark, rows), 300, None, crs="EPSG:3857", emit_tail=True)
    assert tail.where("is_stop").count() == 9


def test_start_end_drops_what_lasts_no_time(spark):
    rows = [(1, "2020-01-01 00:00:00", 0, 0), (1, "2020-01-01 01:00:00", 0, 0), (1, "2020-01-01 02:00:00", 5, 0), (2, "2020-01-01 03:00:00", 5, 0), (2, "2020-01-01 04:00:00", 5, 0)]
    got = [(r["user_id"], r["start"].hour, r["end"].hour) for r in pr.start_end(frame(spark, rows)).orderBy("user_id").collect()]
    assert got == [(1, 0, 1), (2, 3, 4)]
    # the runs of two users at one place are not one
    assert [r["user_id"] for r in pr.next_location_sequence(frame(spark, rows)).orderBy("user_id", "datetime").collect()] == [1, 1, 2]


def test_fill_gaps_stays_with_the_user(spark):
    rows = [(1, "2020-01-01", 1, 1), (1, "2020-01-02", None, None), (2, "2020-01-01", None, None), (2, "2020-01-02", 7, 7)]
    at = lambda how: [r["lon"] for r in pr.fill_gaps(frame(spark, rows), how).orderBy("user_id", "datetime").collect()]
    assert at("ffill") == [1.0, 1.0, None, 7.0] and at("bfill") == [1.0, None, 7.0, 7.0]
    with pytest.raises(ValueError):
        pr.fill_gaps(frame(spark, rows), "nearest")


def test_temporal_rules(spark):
    rows = [(1, "2020-01-01 10:00:00", "2020-01-01 10:50:00", 1), (1, "2020-01-01 10:50:00", "2020-01-01 12:10:00", 2), (1, "2020-01-01 15:30:00", "2020-01-01 15:30:00", 3)]
    df = spark.createDataFrame(rows, "user_id long, start string, end string, labels int").select("user_id", F.to_timestamp("start").alias("start"), F.to_timestamp("end").alias("end"), "labels")
    at = lambda **o: [(r["datetime"].hour, r["labels"]) for r in TemporalAggregator("1H").aggregate(df, **o).orderBy("datetime").collect()]
    assert at() == [(10, 1), (11, 2), (12, 2), (13, None), (14, None), (15, 3)]
    assert at(drop_empty=True) == [(10, 1), (11, 2), (12, 2), (15, 3)]
    assert at(fill_method="ffill")[3:5] == [(13, 2), (14, 2)] and at(fill_method="bfill")[3:5] == [(13, 3), (14, 3)]


def test_measures_of_one_record_users(spark):
    df = frame(spark, [(1, "2020-01-01", 5, 5)]).withColumn("labels", F.lit(1))
    assert m.radius_of_gyration(df, False).first()["value"] == 0
    assert m.jump_lengths(df).first()["value"] is None
    assert m.self_transitions(df).first()["value"] == 0
    assert [r["flow"] for r in m.flows(df, "all").collect()] == [0]
    assert m.first_visits(df).count() == 1
    assert m.dist_travelling_distance(df).count() == 0


def test_model_end_to_end(spark):
    rng = np.random.default_rng(0)
    rows = []
    for u in range(12):
        home, work = (rng.integers(0, 3), 0), (rng.integers(5, 8), 5)
        for d in range(1, 6):
            for h in range(24):
                x, y = work if (9 <= h < 17) ^ (u % 2 == 0) else home
                rows.append((u, f"2020-01-{d:02d} {h:02d}:00:00", x * 100 + 50, y * 100 + 50))
    df = sp.to_labels(frame(spark, rows))
    cells = spark.createDataFrame([(i * 10 + j, i * 100.0, j * 100.0, (i + 1) * 100.0, (j + 1) * 100.0) for i in range(10) for j in range(10)], "cell_id long, x0 double, y0 double, x1 double, y1 double")
    layer = cells.select("cell_id", sp.box_wkt(*(F.col(c) for c in ("x0", "y0", "x1", "y1"))).alias("geometry"), ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"))
    model = mm.fit_mobility_model(df, layer, agents=20, spread=0.9, seed=1)
    agents = model.agents.collect()
    assert 18 <= len(agents) <= 22 and all(a["home_lon"] is not None for a in agents)
    moves = model.generate("2020-02-01", 2, seed=3)
    assert moves.count() == len(agents) * 49 and moves.where("lon is null or lat is null").count() == 0
    shares = mm.cluster_shares(mm.cluster_trajectories(mm.circadian_profiles(df, mm.rank_freq(df)))).collect()
    assert abs(sum(r["share"] for r in shares) - 1) < 1e-9
    homes = model.agents.select("agent_id", F.lit(0).cast("long").alias("cell_id"), F.col("home_lon").alias("lon"), F.col("home_lat").alias("lat"))
    works = mm.convert_to_2d_distribution(mm.rank_freq(df), layer, 1)
    found = mm.commuting_candidates(homes, works, works.select("cell_id", F.lit(600.0).alias("value")), 0.5).collect()
    cells = [r for r in works.collect() if r["value"] > 0]
    want = sorted((h["agent_id"], c["cell_id"]) for h in homes.collect() for c in cells if 300 <= math.hypot(h["lon"] - c["cx"], h["lat"] - c["cy"]) <= 900)
    assert sorted(map(tuple, found)) == want and want
