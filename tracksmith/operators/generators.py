"""Synthetic sequences (GN1-GN6): hourly symbols from the epoch, ``user_id, datetime, labels``.

Random ones depend on nothing but the seed, the user and the place in the sequence, however the rows are divided.
``places``, ``length``, ``prob``, ``repeats`` and ``states`` may be lists, from which each user's value is drawn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracksmith.operators.prediction import uniform


def _each(value: int | float | list, seed: int, salt: int) -> Column:
    """The value, or each user's one of a list."""
    if not isinstance(value, (list, tuple)):
        return F.lit(value)
    return F.element_at(F.array(*map(F.lit, value)), (F.floor(uniform(seed, "user_id", F.lit(salt)) * len(value)) + 1).cast("int"))


def _hourly(spark: SparkSession, users: int, length: Column, label: Column, **values: Column) -> DataFrame:
    """``length`` rows of each user; ``label`` may use the columns ``values``."""
    rows = spark.range(users).select(F.col("id").alias("user_id")).withColumns({"length": length, **values})
    rows = rows.where(F.col("length") > 0).withColumn("n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length").cast("long") - 1)))
    return rows.select("user_id", F.timestamp_seconds(F.col("n") * 3600).cast("timestamp_ntz").alias("datetime"), label.cast("int").alias("labels"))


def _draw(seed: int, salt: int) -> Column:
    return F.floor(uniform(seed, "user_id", "n", F.lit(salt)) * F.col("places"))


def markovian_sequences_generator(spark: SparkSession, users: int, places: int | list, length: int | list, prob: float | list, seed: int = 0) -> DataFrame:
    """GN1: with probability ``prob`` the place in the sequence modulo ``places``, else any symbol."""
    label = F.when(uniform(seed, "user_id", "n", F.lit(1)) < F.col("prob"), F.col("n") % F.col("places")).otherwise(_draw(seed, 2))
    return _hourly(spark, users, _each(length, seed, 11), label, places=_each(places, seed, 12), prob=_each(prob, seed, 13))


def random_sequences_generator(spark: SparkSession, users: int, places: int | list, length: int | list, seed: int = 0) -> DataFrame:
    """GN2: any symbol."""
    return _hourly(spark, users, _each(length, seed, 11), _draw(seed, 1), places=_each(places, seed, 12))


def deterministic_sequences_generator(spark: SparkSession, users: int, places: int | list, repeats: int | list, seed: int = 0) -> DataFrame:
    """GN3: all symbols in order, again and again."""
    many = _each(places, seed, 12)
    return _hourly(spark, users, many * _each(repeats, seed, 11), F.col("n") % F.col("places"), places=many)


def exploratory_sequences_generator(spark: SparkSession, users: int, places: int | list, seed: int = 0) -> DataFrame:
    """GN4: every symbol once, in random order."""
    rows = spark.range(users).select(F.col("id").alias("user_id")).withColumn("places", _each(places, seed, 12)).where(F.col("places") > 0)
    ranked = F.array_sort(F.transform(F.sequence(F.lit(0), F.col("places") - 1), lambda p: F.struct(F.xxhash64(F.lit(seed), "user_id", p).alias("h"), p.alias("p"))))
    rows = rows.select("user_id", F.posexplode(ranked).alias("n", "x"))
    return rows.select("user_id", F.timestamp_seconds(F.col("n") * 3600).cast("timestamp_ntz").alias("datetime"), F.col("x.p").cast("int").alias("labels"))


def self_transitions_sequences_generator(spark: SparkSession, users: int, places: int | list, length: int | list, seed: int = 0) -> DataFrame:
    """GN5: each symbol ``length // places`` times in a row."""
    many = _each(places, seed, 12)
    each = F.floor(_each(length, seed, 11) / many)
    return _hourly(spark, users, each * many, F.floor(F.col("n") / F.greatest(F.col("each"), F.lit(1))), each=each)


def non_stationary_sequences_generator(spark: SparkSession, users: int, places: int | list, states: int | list, length: int | list, seed: int = 0) -> DataFrame:
    """GN6: every step is in a state drawn by the user's weights, and its symbol is drawn by the state's own weights."""

    def pick(n: Column, weight, u: Column) -> Column:
        weights = F.transform(F.sequence(F.lit(0), n - 1), weight)
        total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
        walked = F.aggregate(weights, F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("k")), lambda a, x: F.struct((a["sum"] + x).alias("sum"), (a["k"] + (a["sum"] + x <= u * total).cast("int")).alias("k")))
        return F.least(walked["k"], n - 1)

    state = pick(F.col("states"), lambda k: uniform(seed, "user_id", F.lit(1), k), uniform(seed, "user_id", "n", F.lit(2)))
    symbol = pick(F.col("places"), lambda k: uniform(seed, "user_id", F.lit(3), state, k), uniform(seed, "user_id", "n", F.lit(4)))
    return _hourly(spark, users, _each(length, seed, 11), symbol, places=_each(places, seed, 12), states=_each(states, seed, 13))
