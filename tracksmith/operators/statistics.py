"""Quality statistics per user (US1-US8) and helpers over per-user values (PR3-PR9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracksmith.functions.timebins import floor_to, micros, micros_of
from tracksmith.operators.trajectory import in_time, up_to_now

DAY = 86_400_000_000


def with_bins(df: DataFrame, resolution: str, scope: str = "user") -> DataFrame:
    """``bin``: start of each record's time bin in microseconds.

    Bins start at midnight of the first day of the user, or of the whole table (``scope="frame"``); where bins divide a
    day that makes no difference and nothing needs to be looked up.
    """
    step, us = micros_of(resolution), micros(F.col("datetime"))
    df = df.where(F.col("datetime").isNotNull())
    if DAY % step == 0:
        return df.withColumn("bin", floor_to(us, step))
    if scope == "user":
        origin = floor_to(F.min(us).over(Window.partitionBy("user_id")), DAY)
    else:
        first = df.agg(F.min(us)).first()[0]
        origin = F.lit((first or 0) // DAY * DAY)
    return df.withColumn("bin", floor_to(us, step, origin))


def user_quality(df: DataFrame, resolution: str) -> DataFrame:
    """All of the statistics below that need no order, in one aggregation."""
    step = micros_of(resolution)
    return with_bins(df, resolution).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_records"), F.count_distinct("bin").alias("occupied"), (F.floor((F.max("bin") - F.min("bin")) / step) + 1).alias("duration")
    )


def fraction_of_empty_records(df: DataFrame, resolution: str) -> DataFrame:
    """US1: share of empty bins between a user's first and last record."""
    return user_quality(df, resolution).select("user_id", (1 - F.col("occupied") / F.col("duration")).alias("value"))


def count_records(df: DataFrame, column: str | None = None) -> DataFrame:
    """US2: records per user; with ``column`` only those where it is not null."""
    return df.groupBy("user_id").agg(F.count(F.col(column) if column else F.lit(1)).alias("value"))


def count_records_per_time_frame(df: DataFrame, resolution: str, column: str | None = None) -> DataFrame:
    """US3: records per user and occupied bin; with ``column`` only those where it is not null."""
    binned = with_bins(df, resolution, "frame").groupBy("user_id", "bin").agg(F.count(F.col(column) if column else F.lit(1)).alias("n_records"))
    return binned.select("user_id", F.timestamp_micros("bin").cast("timestamp_ntz").alias("bin_start"), "n_records")


def user_trajectories_duration(df: DataFrame, resolution: str, count_empty: bool = True) -> DataFrame:
    """US4: bins from first to last record, or occupied ones only."""
    return user_quality(df, resolution).select("user_id", F.col("duration" if count_empty else "occupied").cast("long").alias("value"))


def consecutive_record(df: DataFrame, resolution: str) -> DataFrame:
    """US5: longest run of occupied bins."""
    step = micros_of(resolution)
    bins = with_bins(df, resolution).select("user_id", "bin").distinct()
    island = F.col("bin") - F.row_number().over(Window.partitionBy("user_id").orderBy("bin")) * F.lit(step)
    return bins.withColumn("island", island).groupBy("user_id", "island").count().groupBy("user_id").agg(F.max("count").alias("value"))


def per_user(df: DataFrame, value: str, how: str) -> DataFrame:
    """US6-US8 and PR4: ``max``, ``min`` or ``avg`` of a value per user."""
    return df.groupBy("user_id").agg({"max": F.max, "min": F.min, "avg": F.avg}[how](value).alias("value"))


def rowwise_average(df: DataFrame, value: str, row_count: int | None = None) -> DataFrame:
    """PR3: mean over users of their n-th records."""
    n = F.row_number().over(in_time(df)) - 1
    out = df.select(n.alias("n"), F.col(value).alias("v")).groupBy("n").agg(F.avg("v").alias("mean"))
    return out if row_count is None else out.where(F.col("n") < row_count)


def groupwise_normalise(df: DataFrame, value: str) -> DataFrame:
    """PR5: share of the user's sum."""
    return df.withColumn("value", F.col(value) / F.sum(value).over(Window.partitionBy("user_id")))


def groupwise_expansion(df: DataFrame, value: str) -> DataFrame:
    """PR6: running mean of a user's values."""
    return df.withColumn("value", F.avg(value).over(up_to_now(df)))


def convert_to_distribution(df: DataFrame, value: str, bin_size: float | None = None, num_of_classes: int | None = None, include_lowest: bool = False) -> DataFrame:
    """PR7: share of values in right-closed bins from the least to the greatest value: ``bin_lo, bin_hi, share``.

    The least value itself lies in no bin unless ``include_lowest``; with ``bin_size`` neither does what lies above the
    last full edge. Empty bins have 0. Exactly one of the two sizes is given.
    """
    if (bin_size is None) == (num_of_classes is None):
        raise ValueError("give bin_size or num_of_classes")
    values = df.select(F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    lo, hi = values.agg(F.min("v"), F.max("v")).first()
    if lo is None:
        return values.select(F.col("v").alias("bin_lo"), F.col("v").alias("bin_hi"), F.col("v").alias("share"))
    width = float(bin_size) if bin_size is not None else (hi - lo) / num_of_classes
    n = num_of_classes if num_of_classes is not None else max(0, -int(-(hi - lo) // width) - 1)
    index = F.least(F.ceil((F.col("v") - lo) / width), F.lit(n)) if num_of_classes is not None else F.ceil((F.col("v") - lo) / width)
    if width <= 0:
        index = F.lit(0)
    if include_lowest:
        index = F.greatest(index, F.lit(1))
    counts = values.select(index.cast("long").alias("i")).where(F.col("i").between(1, n)).groupBy("i").count()
    bins = df.sparkSession.range(1, n + 1).withColumnRenamed("id", "i").join(F.broadcast(counts), "i", "left")
    total = counts.agg(F.sum("count")).scalar()
    return bins.select((F.lit(lo) + (F.col("i") - 1) * width).alias("bin_lo"), (F.lit(lo) + F.col("i") * width).alias("bin_hi"), (F.coalesce("count", F.lit(0)) / total).alias("share"))


def normalize(df: DataFrame, value: str, name: str = "value") -> DataFrame:
    """PR8: shares of the sum, the rounding residue put on the largest so that they add up to 1."""
    total = df.agg(F.sum(value)).scalar()
    shares = df.withColumn(name, F.col(value) / total)
    top = shares.agg(F.max(name)).scalar()
    residue = 1.0 - shares.agg(F.sum(name)).scalar()
    holders = shares.where(F.col(name) == top).agg(F.count(F.lit(1))).scalar()
    return shares.withColumn(name, F.when(F.col(name) == top, F.col(name) + residue / holders).otherwise(F.col(name)))


def total_normalise(df: DataFrame, value: str) -> DataFrame:
    """PR9: share of the sum over all rows."""
    return df.withColumn("value", F.col(value) / df.agg(F.sum(value)).scalar())
