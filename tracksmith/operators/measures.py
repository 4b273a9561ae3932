"""Individual measures (IM1-IM14, IM24, IM25) and collective ones (CM1, CM2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracksmith.functions.geo import planar
from tracksmith.functions.timebins import micros, micros_of
from tracksmith.operators.preparing import changed, next_location_sequence
from tracksmith.operators.statistics import convert_to_distribution, with_bins
from tracksmith.operators.trajectory import in_time, up_to_now

PLACE = ("user_id", "lon", "lat")


def _there(df: DataFrame) -> DataFrame:
    """G5: the records with a place."""
    return df.where(F.col("lon").isNotNull() & F.col("lat").isNotNull())


def n_locations() -> Column:
    """Distinct labels of a group; null counts as one."""
    return F.count_distinct("labels") + F.max(F.col("labels").isNull().cast("int"))


def num_of_distinct_locations(df: DataFrame) -> DataFrame:
    """IM1"""
    return df.groupBy("user_id").agg(n_locations().alias("value"))


def visitation_frequency(df: DataFrame) -> DataFrame:
    """IM2: share of a user's records at each place: ``user_id, lon, lat, freq``."""
    counts = _there(df).groupBy(*PLACE).count()
    return counts.select(*PLACE, (F.col("count") / F.sum("count").over(Window.partitionBy("user_id"))).alias("freq"))


def first_visits(df: DataFrame) -> DataFrame:
    """IM4: a user's first record at each place."""
    order = F.struct("datetime", *(["seq"] if "seq" in df.columns else []))
    rest = [c for c in df.columns if c not in PLACE]
    return _there(df).groupBy(*PLACE).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*PLACE, "r.*")


def distinct_locations_over_time(df: DataFrame, resolution: str = "1H") -> DataFrame:
    """IM3: places found so far, for every bin from a user's first record to the bin of the last new place."""
    step = micros_of(resolution)
    found = with_bins(first_visits(df), resolution).groupBy("user_id", "bin").count()
    w = Window.partitionBy("user_id").orderBy("bin")
    steps = found.select("user_id", "bin", F.sum("count").over(w).alias("n"), F.lead("bin").over(w).alias("next"))
    filled = F.explode(F.sequence(F.col("bin"), F.coalesce(F.col("next") - step, F.col("bin")), F.lit(step)))
    return steps.select("user_id", filled.alias("b"), "n").select("user_id", F.timestamp_micros("b").cast("timestamp_ntz").alias("bin_start"), F.col("n").alias("n_distinct"))


def jump_lengths(df: DataFrame) -> DataFrame:
    """IM5: distance to a user's record before, in the units of the coordinates: ``user_id, datetime, value``."""
    there = _there(df)
    w = in_time(there)
    return there.select("user_id", "datetime", planar(F.lag("lon").over(w), F.lag("lat").over(w), F.col("lon"), F.col("lat")).alias("value"))


def nonzero_trips(df: DataFrame) -> DataFrame:
    """IM6: jumps other than 0 per user; users without any are absent."""
    return jump_lengths(df).where(F.col("value") != 0).groupBy("user_id").agg(F.count(F.lit(1)).alias("value"))


def self_transitions(df: DataFrame) -> DataFrame:
    """IM7: records at the place of the one before, per user, 0 included."""
    there = _there(df)
    return there.withColumn("_new", changed(there, "lon", "lat")).groupBy("user_id").agg(F.sum((~F.col("_new")).cast("long")).alias("value"))


def _units(us: Column, time_unit: str) -> Column:
    return F.floor(us / F.lit(micros_of(time_unit))).cast("long")


def waiting_times(df: DataFrame, time_unit: str = "h") -> DataFrame:
    """IM8: whole units between the last records of successive places."""
    there = _there(df)
    w = in_time(there)
    leaves = ~(F.lead("lon").over(w).eqNullSafe(F.col("lon")) & F.lead("lat").over(w).eqNullSafe(F.col("lat")))
    kept = there.withColumn("_leaves", leaves).where("_leaves")
    return kept.select("user_id", "datetime", _units(micros(F.col("datetime")) - micros(F.lag("datetime").over(in_time(kept))), time_unit).alias("value"))


def center_of_mass(df: DataFrame, weighted: bool = False) -> DataFrame:
    """IM9: mean of a user's distinct places, or of all records: ``user_id, lon, lat``."""
    places = _there(df).select(*PLACE)
    return (places if weighted else places.distinct()).groupBy("user_id").agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"))


def _from_center(df: DataFrame) -> DataFrame:
    centre = center_of_mass(df).select("user_id", F.col("lon").alias("_cx"), F.col("lat").alias("_cy"))
    return _there(df).join(centre, "user_id").withColumn("_d", planar(F.col("_cx"), F.col("_cy"), F.col("lon"), F.col("lat")))


def radius_of_gyration(df: DataFrame, time_evolution: bool = True, compat: bool = False) -> DataFrame:
    """IM10: root mean square distance from the centre of mass, over all records or as it develops.

    ``compat`` gives the developing form as the mean distance.
    """
    far = _from_center(df)
    if not time_evolution:
        return far.groupBy("user_id").agg(F.sqrt(F.avg(F.col("_d") * F.col("_d"))).alias("value"))
    value = F.avg("_d").over(up_to_now(far)) if compat else F.sqrt(F.avg(F.col("_d") * F.col("_d")).over(up_to_now(far)))
    return far.select("user_id", "datetime", value.alias("value"))


def mean_square_displacement(df: DataFrame, from_center: bool = False, time_evolution: bool = True, reference_locs: DataFrame | None = None) -> DataFrame:
    """IM11: mean square distance from a user's first place, centre, or given place (``user_id, lon, lat``)."""
    if reference_locs is not None:
        given = reference_locs.select("user_id", F.col("lon").alias("_cx"), F.col("lat").alias("_cy"))
        far = _there(df).join(given, "user_id").withColumn("_d", planar(F.col("_cx"), F.col("_cy"), F.col("lon"), F.col("lat")))
    elif from_center:
        far = _from_center(df)
    else:
        far = _there(df)
        w = up_to_now(far)
        far = far.withColumn("_d", planar(F.first("lon").over(w), F.first("lat").over(w), F.col("lon"), F.col("lat")))
    square = F.col("_d") * F.col("_d")
    if not time_evolution:
        return far.groupBy("user_id").agg(F.avg(square).alias("value"))
    return far.select("user_id", "datetime", F.avg(square).over(up_to_now(far)).alias("value"))


def return_time(df: DataFrame, time_unit: str = "h", by_place: bool = False, scope: str = "user") -> DataFrame:
    """IM12: whole units since the record before at the same place; by place, their count and mean.

    ``scope="global"`` takes the records of all users at a place as one sequence.
    """
    there = _there(df)
    keys = PLACE if scope == "user" else PLACE[1:]
    w = Window.partitionBy(*keys).orderBy("datetime", *(["seq"] if "seq" in df.columns else []))
    times = there.select(*PLACE, "datetime", _units(micros(F.col("datetime")) - micros(F.lag("datetime").over(w)), time_unit).alias("value"))
    if not by_place:
        return times.select("user_id", "datetime", "value")
    return times.where(F.col("value").isNotNull()).groupBy(*keys).agg(F.count("value").alias("n"), F.avg("value").alias("mean"))


def random_entropy(df: DataFrame) -> DataFrame:
    """IM13: binary logarithm of the number of distinct places."""
    return _there(df).groupBy("user_id").agg(F.log2(F.count_distinct("lon", "lat")).alias("value"))


def unc_entropy(df: DataFrame) -> DataFrame:
    """IM14: entropy of the visitation frequency."""
    p = F.col("freq")
    return visitation_frequency(df).groupBy("user_id").agg(F.sum(-p * F.log2(p)).alias("value"))


def stationarity(df: DataFrame, compat: bool = False) -> DataFrame:
    """IM24: share of records with the label of the one before.

    ``compat`` takes the records without any null, and the share of their values in all columns but user and time.
    """
    there = df.na.drop("any") if compat else df.where(F.col("labels").isNotNull())
    columns = len(set(df.columns) - {"user_id", "datetime"}) if compat else 1
    return there.withColumn("_new", changed(there, "labels")).groupBy("user_id").agg((F.sum((~F.col("_new")).cast("int")) / (F.count(F.lit(1)) * columns)).alias("value"))


def regularity(df: DataFrame) -> DataFrame:
    """IM25: records per distinct location."""
    return df.groupBy("user_id").agg((F.count(F.lit(1)) / n_locations()).alias("value"))


def dist_travelling_distance(df: DataFrame, bin_size: float | None = None, n_bins: int = 20) -> DataFrame:
    """CM1: distribution of all users' jumps other than 0; ``bin_size`` takes the place of ``n_bins``."""
    jumps = jump_lengths(df).where(F.col("value") != 0)
    return convert_to_distribution(jumps, "value", bin_size, None if bin_size is not None else n_bins)


def flows(df: DataFrame, flows_type: str = "all") -> DataFrame:
    """CM2: moves into (``incoming``), out of (``outgoing``) or both (``all``) of every place: ``lon, lat, flow``."""
    moves = next_location_sequence(df)
    w = in_time(moves)
    has_prev, has_next = F.lag(F.lit(1)).over(w).isNotNull().cast("long"), F.lead(F.lit(1)).over(w).isNotNull().cast("long")
    flow = {"incoming": has_prev, "outgoing": has_next, "all": has_prev + has_next}[flows_type]
    return moves.select("lon", "lat", flow.alias("flow")).groupBy("lon", "lat").agg(F.sum("flow").alias("flow"))
