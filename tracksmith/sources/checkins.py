"""Check-ins as first read: times as text in several spellings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spellings of a time, tried in order. A time without zone is UTC.
FORMATS = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy HH:mm")


def parse_time(text: Column) -> Column:
    """A timestamp from any of FORMATS or from seconds since the epoch; null for what is none of them."""
    seconds = F.when(text.rlike(r"^\s*\d{9,11}\s*$"), F.timestamp_seconds(F.trim(text).try_cast("long")))
    return F.coalesce(seconds, *(F.try_to_timestamp(text, F.lit(f)) for f in FORMATS))


def clean_checkins(df: DataFrame) -> DataFrame:
    """``user_id, datetime, lon, lat, place``: unreadable times and null users dropped, repeated rows once, positions at 0/0 null."""
    nowhere = (F.col("lat") == 0) & (F.col("lon") == 0)
    at = lambda c: F.when(~nowhere & ~F.isnan(c), F.col(c)).alias(c)
    rows = df.select(F.col("id").alias("user_id"), parse_time(F.col("datetime")).alias("datetime"), at("lon"), at("lat"), "place")
    return rows.where(F.col("user_id").isNotNull() & F.col("datetime").isNotNull()).distinct()
