import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tracksmith.operators.grid import regular_grid

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
H0 = int(T0.timestamp()) // 3600
SCHEMA = "who long, t timestamp, a timestamp, b timestamp, x double, step long, state string"


def at(hours):
    return None if hours is None else T0 + timedelta(hours=hours)


def frame(spark, rows):
    return spark.createDataFrame([(w, at(t), at(a), at(b), x, 1, "z") for w, t, a, b, x in rows], SCHEMA)


def grid(df, **options):
    return regular_grid(df, "who", F.col("t"), "1 hour", F.col("a"), F.col("b"), **options)


def test_missing_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(120):
        t = rng.uniform(0, 300)
        kind = rng.random()
        rows.append((rng.choice([1, 2, None]), t, t if kind < 0.4 else None, t + rng.choice([-3, 0, 4]) if kind < 0.6 else None, None))
    rows += rows[:20]
    filled = {}
    for w, t, a, b, _ in rows:
        if w is not None:
            lo, hi = (a, b) if a is not None and b is not None and b >= a else (t, t)
            filled.setdefault(w, set()).update(range(int(lo // 1), int(hi // 1) + 1))
    want = []
    for w, hours in filled.items():
        hours = sorted(hours)
        want += [(w, H0 + h) for p, q in zip(hours, hours[1:]) if q - p - 1 <= 5 for h in range(p + 1, q)]
    got = grid(frame(spark, rows), max_gap=5, emit="missing").select("who", "step").collect()
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("fill,want", [("mark", [None, None]), ("previous", [1.0, 1.0]), ("linear", [2.0, 3.0])])
def test_fill_and_bounds(spark, fill, want):
    df = frame(spark, [(1, 0, None, None, 1.0), (1, 0, None, None, 1.0), (1, 3, None, None, 4.0)])
    got = grid(df, value=F.col("x"), fill=fill, bounds=(F.lit(at(-1)), F.lit(at(4)))).collect()
    got = sorted((r["step"] - H0, r["state"], r["value"]) for r in got)
    assert got == [(-1, "outside", None), (0, "reading", 1.0), (1, "missing", want[0]), (2, "missing", want[1]), (3, "reading", 4.0), (4, "outside", None)]


def test_overlapping_stays_give_each_step_once(spark):
    df = frame(spark, [(1, 0, 0, 5, None), (1, 2, 2, 3, None), (1, 4, 4, 7, None)])
    got = sorted(r["step"] - H0 for r in grid(df).collect())
    assert got == list(range(8))


def test_empty_and_null_rows(spark):
    assert grid(frame(spark, [])).collect() == []
    assert grid(frame(spark, [(None, 1, None, None, None), (1, None, None, None, None)])).collect() == []
    with pytest.raises(ValueError):
        grid(frame(spark, []), fill="cubic")
