"""Stays, gaps and sequences (PR1, PR2, PR10, FI1-FI4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracksmith.functions.geo import to_mercator
from tracksmith.functions.timebins import micros, micros_of
from tracksmith.operators.statistics import with_bins
from tracksmith.operators.trajectory import in_time, up_to_now


def changed(df: DataFrame, *columns: str):
    """Whether a record differs from the one before, the first one included; nulls are equal to each other."""
    w = in_time(df)
    same = F.lag(F.lit(True)).over(w).isNotNull()
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.lag(c).over(w))
    return ~same


def top_time(df: DataFrame, resolution: str) -> DataFrame:
    """PR1: in every bin with several places the records of the place with the longest dwell time; else all records.

    A record dwells until the next one of its bin, the last one not at all. A tie goes to the place seen first.
    """
    binned = with_bins(df, resolution)
    w = Window.partitionBy("user_id", "bin").orderBy("datetime", *(["seq"] if "seq" in df.columns else []))
    binned = binned.withColumn("_dwell", F.coalesce(micros(F.lead("datetime").over(w)) - micros(F.col("datetime")), F.lit(0)))
    places = binned.groupBy("user_id", "bin", "lon", "lat").agg(F.sum("_dwell").alias("d"), F.min(F.struct("datetime", *(["seq"] if "seq" in df.columns else []))).alias("first"))
    best = F.row_number().over(Window.partitionBy("user_id", "bin").orderBy(F.desc("d"), "first"))
    kept = places.select("user_id", "bin", "lon", "lat", best.alias("r")).where("r = 1").drop("r")
    on = [binned["user_id"].eqNullSafe(kept["user_id"]), binned["bin"] == kept["bin"], binned["lon"].eqNullSafe(kept["lon"]), binned["lat"].eqNullSafe(kept["lat"])]
    return binned.join(kept, on, "left_semi").drop("_dwell")


def mode_of(df: DataFrame, value: str) -> DataFrame:
    """PR2: each user's most frequent value (a tie: the smallest): ``user_id, value``."""
    counts = df.where(F.col(value).isNotNull()).groupBy("user_id", F.col(value).alias("v")).count()
    return counts.groupBy("user_id").agg(F.min(F.struct((-F.col("count")).alias("c"), "v")).alias("m")).select("user_id", F.col("m.v").alias("value"))


def start_end(df: DataFrame, date: str = "datetime") -> DataFrame:
    """PR10: runs of one place as stays: the first record's columns with ``start`` and ``end``; runs that last no time are dropped."""
    runs = df.withColumn("_run", F.sum(changed(df, "lon", "lat").cast("int")).over(up_to_now(df)))
    rest = [c for c in df.columns if c not in ("user_id", "start", "end")]
    order = F.struct("datetime", *(["seq"] if "seq" in df.columns else []))
    stays = runs.groupBy("user_id", "_run").agg(F.min_by(F.struct(*rest), order).alias("r"), F.min_by(date, order).alias("start"), F.max_by(date, order).alias("end"))
    return stays.where(F.col("start") != F.col("end")).select("user_id", "r.*", "start", "end")


def fill_gaps(df: DataFrame, fill_method: str, columns: tuple[str, ...] = ("lon", "lat")) -> DataFrame:
    """FI1: nulls replaced by a user's value before (``ffill``) or after (``bfill``); never by another user's."""
    if fill_method not in ("ffill", "bfill"):
        raise ValueError("fill_method is 'ffill' or 'bfill'")
    w = in_time(df, descending=fill_method == "bfill").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def next_location_sequence(df: DataFrame) -> DataFrame:
    """FI2: records with a place that differs from the one before."""
    there = df.where(F.col("lon").isNotNull() & F.col("lat").isNotNull())
    return there.withColumn("_new", changed(there, "lon", "lat")).where("_new").drop("_new")


def stop_detection(df: DataFrame, distance_condition: float = 300, time_condition: str | None = "10 min", crs: str = "EPSG:4326", emit_tail: bool = False, pieces: int = 256) -> DataFrame:
    """FI3, FI4: anchor scan: ``df`` with ``stop_id`` and ``is_stop``; records of a stop get its mean coordinates.

    From an anchor the scan goes on while records are at most ``distance_condition`` metres from the anchor. Where one is
    farther, the records before it are a stop if there are at least two and they last longer than ``time_condition``;
    it becomes the next anchor. The run at the end is no stop unless ``emit_tail``. Only time, projected coordinates
    and a row number of the user go through the sequential kernel; the rest stays in Spark.

    A step of more than twice the distance leads away from any anchor, so the record after it is an anchor whatever came
    before: there a user's records are cut, and every ``pieces`` pieces are a group of their own.
    """
    x, y = (F.col("lon"), F.col("lat")) if crs.endswith("3857") else to_mercator(F.col("lon"), F.col("lat"))
    least = micros_of(time_condition) if time_condition else None
    rows = df.withColumn("_n", F.row_number().over(in_time(df)))
    slim = rows.where(F.col("lon").isNotNull() & F.col("lat").isNotNull()).select("user_id", "_n", micros(F.col("datetime")).alias("t"), x.alias("x"), y.alias("y"))
    limit = float(distance_condition)
    w = Window.partitionBy("user_id").orderBy("_n")
    away = F.coalesce(F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)) > 2.000001 * limit, F.lit(False))
    slim = slim.withColumn("_away", away).withColumn("_g", F.floor(F.sum(F.col("_away").cast("int")).over(w) / pieces)).drop("_away")
    slim = slim.withColumn("_end", F.max("_g").over(Window.partitionBy("user_id")) == F.col("_g"))

    def scan(pdf):
        pdf = pdf.sort_values("_n")
        t, xs, ys = pdf["t"].tolist(), pdf["x"].tolist(), pdf["y"].tolist()
        n, s, number, ids = len(t), 0, 0, [None] * len(t)
        ends = [e for e in (n,) if emit_tail or not pdf["_end"].iloc[0]]
        for e in [*range(1, n), *ends]:
            if e == n or ((xs[e] - xs[s]) ** 2 + (ys[e] - ys[s]) ** 2) ** 0.5 > limit:
                if e - s > 1 and (least is None or t[e - 1] - t[s] > least):
                    number += 1
                    ids[s:e] = [number] * (e - s)
                s = e
        return pdf.assign(stop_id=ids)[["user_id", "_n", "_g", "stop_id"]].astype({"stop_id": "Int64"})

    kind = dict(df.dtypes)["user_id"]
    found = slim.groupBy("user_id", "_g").applyInPandas(scan, f"user_id {kind}, _n int, _g long, stop_id long").where(F.col("stop_id").isNotNull())
    # stops are numbered by group; those of the groups before are added
    before = found.groupBy("user_id", "_g").agg(F.max("stop_id").alias("n"))
    before = before.select("user_id", "_g", F.coalesce(F.sum("n").over(Window.partitionBy("user_id").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    found = found.join(before, ["user_id", "_g"]).select("user_id", "_n", (F.col("stop_id") + F.col("before")).alias("stop_id"))
    joined = rows.join(found, ["user_id", "_n"], "left")
    w = Window.partitionBy("user_id", "stop_id")
    mean = lambda c: F.when(F.col("stop_id").isNotNull(), F.avg(c).over(w)).otherwise(F.col(c))
    return joined.withColumns({"lon": mean("lon"), "lat": mean("lat"), "is_stop": F.col("stop_id").isNotNull()}).drop("_n")
