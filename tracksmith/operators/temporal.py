"""Temporal aggregation (TA1-TA3): stays to one winner per time bin."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracksmith.functions.timebins import floor_to, micros, micros_of
from tracksmith.operators.statistics import DAY


@dataclass(frozen=True)
class TemporalAggregator:
    """One record per user and bin from the first to the last bin of the user.

    A stay counts in every bin from that of ``start`` to that of ``end``. The stay with the most weight wins, of equals the
    one that begins first. ``rule="overlap"`` weighs by the time spent in the bin. ``rule="reference"`` weighs a stay inside
    the bin by its length, one that runs past it by the time from its start to the end of the bin, and any other by the
    time from the start of the bin to its own start, which is not positive.
    """

    resolution: str
    rule: str = "overlap"

    def aggregate(self, df: DataFrame, fill_method: str | None = None, drop_empty: bool = False) -> DataFrame:
        step = micros_of(self.resolution)
        rest = [c for c in df.columns if c not in ("user_id", "datetime", "start", "end")]
        seq = ["seq"] if "seq" in df.columns else []
        s, e = micros(F.col("start")), micros(F.col("end"))
        stays = df.where(F.col("start").isNotNull() & F.col("end").isNotNull() & (F.col("end") >= F.col("start"))).withColumns({"_s": s, "_e": e})
        origin = F.lit(0).cast("long") if DAY % step == 0 else floor_to(F.min("_s").over(Window.partitionBy("user_id")), DAY)
        stays = stays.withColumn("_o", origin)
        spread = stays.withColumn("_b", F.explode(F.sequence(floor_to(F.col("_s"), step, F.col("_o")), floor_to(F.col("_e"), step, F.col("_o")), F.lit(step))))
        b0, b1 = F.col("_b"), F.col("_b") + step
        if self.rule == "reference":
            weight = F.when((F.col("_e") < b1) & (F.col("_s") > b0), F.col("_e") - F.col("_s")).when(F.col("_e") > b1, b1 - F.col("_s")).otherwise(F.col("_s") - b0)
        elif self.rule == "overlap":
            weight = F.least(F.col("_e"), b1) - F.greatest(F.col("_s"), b0)
        else:
            raise ValueError("rule is 'overlap' or 'reference'")
        # one aggregation and no sort: the greatest of (weight, earlier start, earlier record)
        value = F.struct(*(F.col(c) for c in rest), F.col("start").alias("start"), F.col("end").alias("end"))
        rank = F.struct(weight.alias("w"), (-F.col("_s")).alias("s"), *((-F.col(c)).alias("q") for c in seq))
        winners = spread.groupBy("user_id", "_b").agg(F.max_by(value, rank).alias("v"))
        w = Window.partitionBy("user_id").orderBy("_b")
        if drop_empty and fill_method is None:
            grid = winners.select("user_id", "_b", "v")
        else:
            grid = winners.select("user_id", "_b", "v", F.lead("_b").over(w).alias("n"))
            grid = grid.select("user_id", F.explode(F.transform(F.sequence(F.col("_b"), F.coalesce(F.col("n") - step, F.col("_b")), F.lit(step)), lambda b: F.struct(b.alias("b"), F.when(b == F.col("_b"), F.col("v")).alias("v")))).alias("x")).select("user_id", F.col("x.b").alias("_b"), F.col("x.v").alias("v"))
        if fill_method is not None:
            back, on = (w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("user_id").orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, 0))
            filled = F.last("v", ignorenulls=True)
            grid = grid.withColumn("v", filled.over(back if fill_method == "ffill" else on))
            # what is left at an edge is filled from after it
            grid = grid.withColumn("v", F.last("v", ignorenulls=True).over(on))
        if drop_empty:
            grid = grid.where(F.col("v").isNotNull())
        return grid.select("user_id", F.timestamp_micros("_b").cast("timestamp_ntz").alias("datetime"), "v.*")
