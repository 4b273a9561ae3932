import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracksmith.operators import sequences as sq

SYMBOLS = st.lists(st.integers(0, 3), min_size=1, max_size=14)


def frame(spark, sequences):
    rows = [(u, f"2020-01-01 00:{i // 60:02d}:{i % 60:02d}", s) for u, seq in sequences.items() for i, s in enumerate(seq)]
    return spark.createDataFrame(rows, "user_id string, datetime string, labels int").withColumn("datetime", F.to_timestamp("datetime"))


@given(st.lists(st.integers(0, 3), max_size=40))
def test_match_lengths_are_those_of_the_definition(s):
    want = [1 + max((k for k in range(1, len(s) - i + 1) if any(s[i : i + k] == s[j : j + k] for j in range(i - k + 1))), default=0) for i in range(len(s))]
    assert sq.match_lengths_of(s) == want


@given(SYMBOLS, SYMBOLS)
def test_recurrence_kernels(a, b):
    inside = lambda x, y: any(y[i : i + len(x)] == x for i in range(len(y) - len(x) + 1))
    assert sq.common_substring(a, b) == max((j - i for i in range(len(b)) for j in range(i + 1, len(b) + 1) if inside(b[i:j], a)), default=0)
    assert sq.shifted_matches(a, b) == max(sum(1 for i, s in enumerate(b) if 0 <= i + d < len(a) and a[i + d] == s) for d in range(-len(b), len(a) + 1))
    row = [0] * (len(b) + 1)
    for s in a:
        row = list(itertools.accumulate(range(1, len(b) + 1), lambda left, j, old=row, s=s: max(left, old[j], old[j - 1] + (b[j - 1] == s)), initial=0))
    assert sq.common_subsequence(a, b) == row[-1]


def brute_align(a, b):
    """Best score over all ways to interleave, gaps at the ends free."""
    from functools import lru_cache

    n, m = len(a), len(b)

    @lru_cache(None)
    def best(i, j, state):
        if i == n and j == m:
            return 0
        out = []
        if i < n and j < m:
            out.append((1 if a[i] == b[j] else -1) + best(i + 1, j + 1, 0))
        if i < n:
            out.append((0 if state == 1 or j in (0, m) else -1) + best(i + 1, j, 1))
        if j < m:
            out.append((0 if state == 2 or i in (0, n) else -1) + best(i, j + 1, 2))
        return max(out)

    return best(0, 0, 0)


@settings(deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=8), st.lists(st.integers(0, 3), min_size=1, max_size=8))
def test_alignment(a, b):
    score, partner = sq.align(a, b)
    assert score == brute_align(tuple(a), tuple(b))
    known = [p for p in partner if p >= 0]
    assert known == sorted(set(known)) and len(partner) == len(b)


def test_iterative_alignment_adds_what_is_left():
    assert sq.aligned_again([1, 2, 3, 4], [1, 2, 3, 4]) == 3
    assert sq.aligned_again([1, 2, 3, 4, 9, 9], [3, 4, 9, 9, 1, 2, 3]) > sq.align([1, 2, 3, 4, 9, 9], [3, 4, 9, 9, 1, 2, 3])[0] - 1


def test_sequences_of_users(spark):
    df = frame(spark, {"a": [0, 1] * 10, "b": [5], "c": [None, None], "d": [1, None, 2, 1]})
    assert {r[0]: r[1] for r in sq.lz_entropy(df).collect()}["c"] is None
    got = {r[0]: r for r in sq.unc_predictability(df.withColumns({"lon": F.col("labels").cast("double"), "lat": F.lit(0.0)})).collect()}
    assert got["b"]["predictability"] == 1.0
    assert abs(got["a"]["entropy"] - 1) < 1e-12 and abs(got["a"]["predictability"] - 0.5) < 1e-9
    train, test = frame(spark, {"a": [1, 2, 3, 1, 2], "only": [1]}), frame(spark, {"a": [2, 3, 1], "other": [4, 4]})
    for op, want in ((sq.repeatability_dense, 1.0), (sq.repeatability_sparse, 1.0), (sq.repeatability_equally_sparse, 1.0), (sq.global_alignment, 1.5)):
        assert {r[0]: r[1] for r in op(train, test).collect()} == {"a": want, "only": None, "other": None}


def test_scaled_entropy():
    rng = np.random.default_rng(0)
    full = [int(x) for x in np.arange(300) % 6]
    gone = [None if rng.random() < 0.3 else s for s in full]
    assert sq.scaled_entropy_of([None] * 95 + [1] * 5, 0) is None
    assert sq.scaled_entropy_of(full, 0) == pytest.approx(math.log2(300) / np.mean(sq.match_lengths_of(full)))
    value = sq.scaled_entropy_of(gone, 0)
    assert 0 < value < math.log2(6) + 1
    assert sq.scaled_entropy_of(gone, 0) == value
    assert sq.scaled_entropy_of(gone, 0, "shuff") > 0


def test_fit_finds_the_curve():
    q = np.linspace(0.2, 0.9, 12)
    a, b, c = sq.fit_exponential(q, 0.2 * np.exp(1.5 * q) - 0.4)
    assert abs(a - 0.2) < 1e-3 and abs(b - 1.5) < 1e-2 and abs(c + 0.4) < 1e-2


@pytest.mark.parametrize("n,s", [(2, 0.5), (10, 1.7), (50, 5.0), (5, math.log2(5)), (5, 9.0), (1, 0.0), (4, 0.0)])
def test_fano(spark, n, s):
    x = spark.createDataFrame([(n, s)], "n long, s double").select(sq.fano(F.col("n"), F.col("s"))).first()[0]
    if n == 1 or s == 0:
        assert x == 1
    elif s >= math.log2(n):
        assert x == pytest.approx(1 / n)
    else:
        assert -(x * math.log2(x) + (1 - x) * math.log2(1 - x)) + (1 - x) * math.log2(n - 1) == pytest.approx(s, abs=1e-9)


def test_match_lengths_by_the_automaton():
    import random

    from tracksmith.operators.sequences import match_lengths_of

    def brute(x):
        out = []
        for i in range(len(x)):
            k = 0
            while i + k < len(x) and any(x[j : j + k + 1] == x[i : i + k + 1] for j in range(0, i - k)):
                k += 1
            out.append(k + 1)
        return out

    rng = random.Random(3)
    for _ in range(400):
        x = [rng.randrange(rng.choice([1, 2, 3, 6])) for _ in range(rng.randrange(0, 40))]
        if rng.random() < 0.3:
            x = x[: len(x) // 3] * 3
        assert match_lengths_of(x) == brute(x)
    # a long periodic sequence takes no more than its length
    assert match_lengths_of([0, 1] * 100_000)[-1] == 2
