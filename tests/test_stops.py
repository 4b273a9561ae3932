import random
import time
from datetime import datetime, timedelta, timezone

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tracksmith.functions.geo import haversine_np
from tracksmith.operators import stops as module
from tracksmith.operators.stops import _chunks, plateau_knots, stops_and_trips, stops_of

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "who string, t timestamp, n long, la double, lo double, kind string, k string"
M = 1 / 111_195.0


def frame(spark, rows):
    return spark.createDataFrame([(w, T0 + timedelta(seconds=t) if t is not None else None, n, la, lo, "x", "y") for w, t, n, la, lo in rows], SCHEMA)


def run(spark, rows, **options):
    got = stops_and_trips(frame(spark, rows), "who", "t", F.col("la"), F.col("lo"), order="n", **options).collect()
    s = lambda x: int((x.replace(tzinfo=timezone.utc) - T0).total_seconds())
    return sorted((r["who"], r["kind"], s(r["start"]), s(r["end"])) for r in got), got


def walk(rng, n):
    """A made-up day: spots with noise and strays, trips between them, silences; and its true stops and trips."""
    t, la, lo, out, stops, breaks = 0, 10.0, 0.0, [], [], []
    for _ in range(n):
        k = rng.randrange(6, 40)
        start = t
        for i in range(k):
            stray = 0 < i < k - 1 and rng.random() < 0.05 and not (out and out[-1][3])
            out.append((t, la + rng.gauss(0, 25 * M) + (0.03 if stray else 0), lo + rng.gauss(0, 25 * M), stray))
            last = t
            t += rng.randrange(120, 400)
        stops.append((start, last))
        if rng.random() < 0.2:
            t += 4 * 3600
            breaks.append(t)
            la += 0.05
        for _ in range(rng.randrange(3, 12)):
            la, lo = la + 600 * M, lo + 300 * M
            out.append((t, la, lo, False))
            t += rng.randrange(30, 90)
        la += 700 * M
    trips = [(a[1], b[0]) for a, b in zip(stops, stops[1:]) if not any(a[1] < x <= b[0] for x in breaks)]
    return [(t, a, o) for t, a, o, _ in out], stops, trips


def test_made_up_days(spark):
    rng = random.Random(5)
    rows, want = [], []
    for who in ("a", "b", "c"):
        pings, stops, trips = walk(rng, 25)
        rows += [(who, t, i, a, o) for i, (t, a, o) in enumerate(pings)]
        want += [(who, "stop", a, b) for a, b in stops] + [(who, "trip", a, b) for a, b in trips]
    rows += rows[::9]
    rng.shuffle(rows)
    for chunk in ("1 hour", "1 day", "30 days"):
        assert run(spark, rows, chunk=chunk)[0] == sorted(want)


def test_trip_distance_is_the_path(spark):
    pings = [(i * 60, 0.0) for i in range(12)] + [(720 + i * 60, i * 0.01) for i in range(1, 9)] + [(1300 + i * 60, 0.1) for i in range(12)]
    for chunk in ("5 min", "1 day"):
        got = [r for r in run(spark, [("u", t, 0, 10.0, x) for t, x in pings], chunk=chunk)[1] if r["kind"] == "trip"]
        assert len(got) == 1 and abs(got[0]["distance_m"] - haversine_np(10.0, 0.0, 10.0, 0.1)) < 1


def test_edges(spark):
    assert run(spark, [])[0] == []
    assert run(spark, [(None, 0, 1, 10.0, 10.0), ("u", None, 1, 10.0, 10.0), ("u", 5, 1, None, 10.0), ("u", 6, 1, float("nan"), 10.0)])[0] == []
    assert run(spark, [("u", 0, 1, 10.0, 10.0)])[0] == []
    assert run(spark, [("u", 0, 1, 10.0, 10.0), ("u", 599, 2, 10.0, 10.0)])[0] == []
    assert run(spark, [("u", 0, 1, 10.0, 10.0), ("u", 600, 2, 10.0, 10.0)])[0] == [("u", "stop", 0, 600)]
    assert run(spark, [("u", 0, 1, 10.0, 10.0), ("u", 10801, 2, 10.0, 10.0)])[0] == []
    same = [("u", 0, i, 10.0, 10.0) for i in range(5)] + [("u", 900, 9, 10.0, 10.0)]
    assert run(spark, same)[0] == [("u", "stop", 0, 900)]


def test_plateaus_of_a_step():
    assert plateau_knots([0.0] * 5 + [10.0] * 5, 1.0) == [0, 5, 10]
    assert plateau_knots([0.0, 0.1, -0.1, 0.0], 5.0) == [0, 4]
    assert plateau_knots([3.0], 1.0) == [0, 1]


def denoised(values, weight, sizes):
    """Taut string by its knots: the slopes between the bends, each at the ceiling or the floor of the tube."""
    knots = plateau_knots(values, weight, sizes)
    v = np.repeat(values, sizes)
    total, at = np.concatenate([[0], np.cumsum(v)]), np.concatenate([[0], np.cumsum(sizes)])[knots]
    # a bend lies at the ceiling or the floor; the right choice has the least objective
    best = None
    for signs in np.ndindex(*[2] * (len(knots) - 2)):
        heights = np.array([0.0, *(total[p] + weight * (2 * s - 1) for p, s in zip(at[1:-1], signs)), total[-1]])
        u = np.repeat(np.diff(heights) / np.diff(at), np.diff(at))
        cost = ((u - v) ** 2).sum() / 2 + weight * np.abs(np.diff(u)).sum()
        best = min(best, cost) if best is not None else cost
    return best


def test_values_with_sizes():
    rng = random.Random(2)
    for _ in range(60):
        values = [rng.choice([0.0, 50.0, 400.0]) + rng.gauss(0, 20) for _ in range(rng.randrange(1, 9))]
        sizes = [rng.randrange(1, 5) for _ in values]
        each = [v for v, s in zip(values, sizes) for _ in range(s)]
        if len(plateau_knots(each, 100.0)) < 12:
            assert abs(denoised(values, 100.0, sizes) - denoised(each, 100.0, [1] * len(each))) < 1e-6


def sequence(seed, n=25):
    pings, stops, _ = walk(random.Random(seed), n)
    return [t * 1_000_000 for t, _, _ in pings], [a for _, a, _ in pings], [o for _, _, o in pings], [(a * 1_000_000, b * 1_000_000) for a, b in stops]


def found(t, la, lo):
    return [(t[i], t[j]) for i, j, _ in stops_of(t, la, lo, 300.0, 600 * 10**6, 3 * 3600 * 10**6, 2)]


def test_plateaus_decide(monkeypatch):
    t, la, lo, want = sequence(11)
    assert found(t, la, lo) == want
    # every ping for itself, and all pings as one, are no plateaus of anything
    monkeypatch.setattr(module, "plateau_knots", lambda v, w, s=None: list(range(len(v) + 1)))
    assert found(t, la, lo) == []
    monkeypatch.setattr(module, "plateau_knots", lambda v, w, s=None: [0, len(v)])
    assert found(t, la, lo) != want


def batch(t, la, lo):
    n = len(t)
    return pa.RecordBatch.from_arrays([pa.array(["u"] * n), pa.array(np.array(t) // (86_400 * 10**6)), pa.array(t, pa.int64()), pa.array(range(n), pa.int64()), pa.array(la), pa.array(lo)], names=["k", "c", "t", "o", "la", "lo"])


FOLDED = pa.schema([("k", pa.string()), *((c, pa.int64()) for c in ("c", "t", "o", "n", "rest", "cut")), *((c, pa.float64()) for c in ("la", "lo", "sla", "slo"))])


def test_a_device_at_rest_leaves_few_rows(spark):
    rng = np.random.default_rng(4)
    n = 1_000_000
    t = (np.arange(n) * 2 * 10**6).tolist()
    la, lo = 10 + rng.normal(0, 10 * M, n), rng.normal(0, 10 * M, n)
    began = time.time()
    out = pa.Table.from_batches(_chunks(FOLDED, 300.0, 600 * 10**6, 3 * 3600 * 10**6, 2, False)(iter([batch(t, la, lo)])))
    assert out.num_rows < n / 100 and pa.compute.sum(out["n"]).as_py() == n
    assert abs(pa.compute.sum(out["sla"]).as_py() / n - la.mean()) < 1e-9
    assert time.time() - began < 60
    some = slice(0, 200_000)
    rows = [("u", int(x) // 10**6, i, float(a), float(o)) for i, (x, a, o) in enumerate(zip(t[some], la[some], lo[some]))]
    stops, got = run(spark, rows)
    assert stops == [("u", "stop", 0, 399_998)] and got[0]["n_pings"] == 200_000 and abs(got[0]["lat"] - la[some].mean()) < 1e-9


def test_folded_rests_change_no_stop(spark, monkeypatch):
    rng = random.Random(8)
    rows, t, la = [], 0, 10.0
    for _ in range(12):
        for _ in range(rng.randrange(3, 300)):
            rows.append((t, la + rng.gauss(0, 12 * M), rng.gauss(0, 12 * M)))
            t += rng.randrange(5, 60)
        for _ in range(rng.randrange(3, 9)):
            la += 900 * M
            rows.append((t, la, 0.0))
            t += 60
        la += 900 * M
    us = [x * 10**6 for x, _, _ in rows]
    want = found(us, [a for _, a, _ in rows], [o for _, _, o in rows])
    got = [(a, b) for _, kind, a, b in run(spark, [("u", x, i, a, o) for i, (x, a, o) in enumerate(rows)])[0] if kind == "stop"]
    assert got == [(a // 10**6, b // 10**6) for a, b in want] and len(got) > 5
