import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracksmith.functions.geo import haversine_np
from tracksmith.llm.runs import SYMBOLS, canonical, collapse_runs, spans_of_runs

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "who string, t timestamp, n long, la double, lo double, k string, part long"


def run(spark, rows, **options):
    df = spark.createDataFrame([(w, T0 + timedelta(seconds=t) if t is not None else None, n, la, lo, "z", 1) for w, t, n, la, lo in rows], SCHEMA)
    got = collapse_runs(df, "who", F.col("t"), "n", F.col("la"), F.col("lo"), **options).collect()
    s = lambda x: int((x.replace(tzinfo=timezone.utc) - T0).total_seconds())
    return sorted((r["who"], s(r["start"]), s(r["end"]), r["n"]) for r in got)


def brute(rows, within=5.0, least=2):
    out = []
    for who in {r[0] for r in rows if r[0] is not None}:
        events = sorted({r[1:] for r in rows if r[0] == who})
        runs = []
        for e in events:
            if runs and haversine_np(runs[-1][-1][2], runs[-1][-1][3], e[2], e[3]) <= within:
                runs[-1].append(e)
            else:
                runs.append([e])
        out += [(who, r[0][0], r[-1][0], len(r)) for r in runs if len(r) >= least]
    return sorted(out)


@given(st.lists(st.tuples(st.integers(0, 3), st.booleans()), max_size=200))
def test_spans(steps):
    """Few places that come again and again; a step to another place is out of reach, one to the same place may be."""
    places = np.array([p for p, _ in steps], float)
    starts = np.array([i == 0 or p != steps[i - 1][0] or far for i, (p, far) in enumerate(steps)], bool)
    events = canonical(places, places, starts)
    assert events.tolist() == np.unique(places, return_inverse=True)[1].tolist()
    at = np.nonzero(starts)[0]
    assert spans_of_runs(events, starts).tolist() == [list(p) for p in zip(at, [*at[1:], len(steps)])]


def test_the_text_decides():
    """A place has its symbol wherever it comes, and the repetitions are those of the text, not of the flags."""
    lat = np.array([1.0, 1.0, 2.0, 1.0, 1.00001, 1.0])
    starts = np.array([True, False, True, True, False, False])
    assert canonical(lat, lat, starts).tolist() == [0, 0, 1, 0, 0, 0]
    assert spans_of_runs(np.array([5, 5, 7, 5]), np.array([True, True, True, True])).tolist() == [[0, 1], [1, 2], [2, 3], [3, 4]]
    assert spans_of_runs(np.array([5, 5, 7, 5]), np.zeros(4, bool)).tolist() == [[0, 2], [2, 3], [3, 4]]


def test_more_events_than_symbols():
    n = len(SYMBOLS) + 50
    events, starts = np.arange(n), np.ones(n, bool)
    events[len(SYMBOLS) - 2 : len(SYMBOLS) + 3], starts[len(SYMBOLS) - 1 : len(SYMBOLS) + 3] = 7, False
    at = np.nonzero(starts)[0]
    assert spans_of_runs(events, starts).tolist() == [list(p) for p in zip(at, [*at[1:], n])]


@pytest.mark.parametrize("chunk", ["1 min", "1 hour", "7 days"])
@pytest.mark.parametrize("least", [1, 2])
def test_against_brute_force(spark, chunk, least):
    rng = random.Random(chunk)
    rows, spot = [], 0
    for i in range(900):
        spot = rng.choice([spot, spot, spot, 0, rng.randrange(4)])
        rows.append((rng.choice(["hot", "hot", "hot", "b"]), rng.randrange(0, 40000) if rng.random() < 0.9 else 777, i, 10.0 + spot * 0.01, 20.0 + rng.uniform(0, 2e-5)))
    rows += rng.sample(rows, 100)
    rng.shuffle(rows)
    assert run(spark, rows, chunk=chunk, least=least) == brute(rows, least=least)


def test_drift_within_reach_is_one_run(spark):
    rows = [("u", 60 * i, i, 10.0 + i * 4e-5, 20.0) for i in range(50)]
    assert run(spark, rows) == [("u", 0, 60 * 49, 50)]


def test_small_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [("u", 60 * i, i, 10.0 + (i // 7) * 0.01, 20.0) for i in range(40)] * 2
        rows += [("v", 5, 1, 1.0, 1.0)] * 9
        assert run(spark, rows) == brute(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_edges(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, 1, 1, 1.0, 1.0), ("u", None, 1, 1.0, 1.0), ("u", 1, None, 1.0, 1.0), ("u", 1, 1, None, 1.0), ("u", 1, 1, float("nan"), 1.0)]) == []
    assert run(spark, [("u", 1, 1, 1.0, 1.0), ("u", 1, 1, 1.0, 1.0)]) == []
    assert run(spark, [("u", 1, 1, 1.0, 1.0), ("u", 1, 2, 1.0, 1.0)]) == [("u", 1, 1, 2)]
