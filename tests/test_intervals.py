import random
from datetime import datetime, timedelta, timezone

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tracksmith.operators.intervals import IntervalMap, merge_intervals

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "who string, a timestamp, b timestamp, kind string, k string, s long"


def at(hours):
    return None if hours is None else T0 + timedelta(hours=hours)


def run(spark, rows, **options):
    df = spark.createDataFrame([(w, at(a), at(b), "x", "y", 1) for w, a, b in rows], SCHEMA)
    hours = lambda t: (t.replace(tzinfo=timezone.utc) - T0) / timedelta(hours=1)
    return sorted((r[0], r[1], hours(r[2]), hours(r[3])) for r in merge_intervals(df, "who", "a", "b", **options).collect())


def brute(rows, max_gap=None):
    out = []
    for who in {w for w, a, b in rows if w is not None}:
        periods = []
        for a, b in sorted((a, b) for w, a, b in rows if w == who and a is not None and b is not None and b >= a):
            if periods and a <= periods[-1][1]:
                periods[-1][1] = max(periods[-1][1], b)
            else:
                periods.append([a, b])
        out += [(who, "period", float(a), float(b)) for a, b in periods]
        out += [(who, "gap", float(p[1]), float(q[0])) for p, q in zip(periods, periods[1:]) if max_gap is None or q[0] - p[1] <= max_gap]
    return sorted(out)


@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 9))))
def test_interval_map_is_the_union(pieces):
    m = IntervalMap()
    for a, n in pieces:
        m.insert(a, a + n)
    rows = [("u", a, a + n) for a, n in pieces]
    assert [("u", "period", float(a), float(b)) for a, b in zip(m.starts, m.ends)] == [r for r in brute(rows) if r[1] == "period"]
    assert sorted(("u", "gap", float(a), float(b)) for a, b in m.gaps()) == [r for r in brute(rows) if r[1] == "gap"]


@pytest.mark.parametrize("block", ["1 hour", "1 day", "7 days"])
def test_against_brute_force(spark, block):
    rng = random.Random(block)
    rows = []
    for who, n in (("hot", 400), ("b", 30), ("c", 1), (None, 5)):
        for _ in range(n):
            a = rng.randrange(-300, 900)
            rows.append((who, a, a + rng.choice([0, 0, 1, 2, 3, 5, 40, 200])))
    rows += rows[:50] + [("b", 5, None), ("b", None, 5), ("b", 50, 40)]
    assert run(spark, rows, block=block) == brute(rows)
    assert run(spark, rows, block=block, max_gap="4 hours") == brute(rows, 4)


def test_touching_nested_and_zero_length(spark):
    assert run(spark, [("u", 0, 2), ("u", 2, 3), ("u", 1, 2), ("u", 9, 9)]) == [("u", "gap", 3.0, 9.0), ("u", "period", 0.0, 3.0), ("u", "period", 9.0, 9.0)]


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, 0, 1), ("u", None, None), ("u", 3, 1)]) == []


def test_integer_keys(spark):
    df = spark.createDataFrame([(7, at(0), at(1)), (7, at(1), at(2))], "who long, a timestamp, b timestamp")
    assert [r[0] for r in merge_intervals(df, "who", "a", "b").collect()] == [7]
