import random
from collections import Counter

from pyspark.sql import functions as F

from tracksmith.operators.hotkeys import heavy_keys, key_totals


def test_totals_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 30 + ["a", "b", None]), rng.choice([None, float("nan"), 1.0, -2.5, 7.0]), "x") for _ in range(3000)]
    df = spark.createDataFrame(rows, "k string, x double, n string").repartition(7)
    got = {r["k"]: r for r in key_totals(df, "k", {"x": F.col("x")}).collect()}
    assert {k: r["n"] for k, r in got.items()} == Counter(k for k, _, _ in rows)
    for k, r in got.items():
        xs = [x for key, x, _ in rows if key == k and x is not None and x == x]
        assert (r["x_n"], r["x_min"], r["x_max"]) == (len(xs), min(xs), max(xs))
        assert abs(r["x_sum"] - sum(xs)) < 1e-9


def test_key_without_values_and_empty(spark):
    df = spark.createDataFrame([(1, None), (None, 2.0)], "k long, x double")
    got = {r["k"]: tuple(r)[1:] for r in key_totals(df, "k", {"x": F.col("x")}).collect()}
    assert got == {1: (1, 0, None, None, None), None: (1, 1, 2.0, 2.0, 2.0)}
    assert key_totals(df.where("k = 9"), "k").collect() == []


def test_heavy_keys_count_all_rows(spark):
    df = spark.createDataFrame([("a",)] * 2 + [("b",)] + [(None,)] * 97, "k string")
    assert [tuple(r) for r in heavy_keys(df, "k", 0.02).collect()] == [("a", 2)]
    assert heavy_keys(df.where("k = 'z'"), "k", 0.02).collect() == []


def test_an_exact_share_counts(spark):
    for total in (50, 350, 650, 1150):
        df = spark.range(total).selectExpr(f"case when id < {total // 50} then 1 else 2 end as k")
        assert sorted(r["k"] for r in heavy_keys(df, "k", 0.02).collect()) == [1, 2]
