"""Streams of stays and records: continuous periods, counts per bin, and moves to another place.

The batch operators say what is computed; here the same comes out as rows arrive. Keyed state holds what a key needs to
go on: the interval map, or the last place.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracksmith.functions.timebins import micros
from tracksmith.operators.intervals import IntervalMap


def stream_periods(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Periods and gaps of the keys that a micro-batch touches, as they stand after it: ``key, kind, start_us, end_us``.

    The state of a key is its ordered disjoint-interval map. Use output mode ``update``; the rows of a key replace those
    given for it before. Intervals that are open or run backwards, and rows without key, are left out.
    """
    kind = dict(df.dtypes)[key]
    rows = df.select(F.col(key).alias("k"), micros(F.col(start)).alias("s"), micros(F.col(end)).alias("e")).where(F.col("k").isNotNull() & (F.col("e") >= F.col("s")))

    def update(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = IntervalMap(*pickle.loads(state.get[0])) if state.exists else IntervalMap()
        for pdf in batches:
            for s, e in zip(pdf["s"].tolist(), pdf["e"].tolist()):
                known.insert(s, e)
        state.update((pickle.dumps((known.starts, known.ends)),))
        spans = [("period", s, e) for s, e in zip(known.starts, known.ends)] + [("gap", s, e) for s, e in known.gaps()]
        yield pd.DataFrame([(keys[0], *x) for x in spans], columns=["k", "kind", "start_us", "end_us"])

    out = rows.groupBy("k").applyInPandasWithState(update, f"k {kind}, kind string, start_us long, end_us long", "map binary", "update", GroupStateTimeout.NoTimeout)
    return out.withColumnRenamed("k", key)


def stream_counts(df: DataFrame, resolution: str, late: str) -> DataFrame:
    """Records per user and bin, given out when no record of the bin can come any more: ``user_id, bin_start, n_records``."""
    binned = df.withWatermark("datetime", late).groupBy("user_id", F.window("datetime", resolution)).agg(F.count(F.lit(1)).alias("n_records"))
    return binned.select("user_id", F.col("window.start").alias("bin_start"), "n_records")


def stream_next_locations(df: DataFrame) -> DataFrame:
    """Records whose place differs from the user's record before, in order of time within a micro-batch.

    ``user_id, datetime, lon, lat``. The state of a user is the last place. A record older than that place was is in
    another order than in a batch; let the source deliver in order, or use ``stream_counts`` with a watermark.
    """
    kind = dict(df.dtypes)["user_id"]
    rows = df.select("user_id", "datetime", "lon", "lat").where("user_id is not null and lon is not null and lat is not null")

    def update(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches)).sort_values("datetime", kind="stable")
        last = tuple(state.get) if state.exists else None
        keep = []
        for place in zip(pdf["lon"].tolist(), pdf["lat"].tolist()):
            keep.append(place != last)
            last = place
        state.update(last)
        yield pdf[keep]

    return rows.groupBy("user_id").applyInPandasWithState(update, f"user_id {kind}, datetime timestamp, lon double, lat double", "lon double, lat double", "append", GroupStateTimeout.NoTimeout)
