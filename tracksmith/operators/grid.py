"""Problem 4: irregular readings onto a regular grid of time steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracksmith.functions.timebins import micros, micros_of


def regular_grid(
    df: DataFrame, key: str, time: Column, step: str = "1 hour", start: Column | None = None, end: Column | None = None, value: Column | None = None,
    max_gap: int | None = None, fill: str = "mark", bounds: tuple[Column, Column] | None = None, emit: str = "all",
) -> DataFrame:
    """One row per ``key`` and step between its first and last reading: ``key, step, state, value``.

    ``step`` counts whole steps since the epoch. ``state`` is ``reading`` for a step with data, ``missing`` for one
    without between two with data, and ``outside`` for one that only ``bounds`` asks for. A row with ``start`` and ``end``
    in order covers every step from one to the other; any other row covers the step of ``time``; rows without key or
    time are left out. If more than ``max_gap`` steps in a row are missing, none of them is listed.

    ``value`` of a step is that of its latest reading (largest value on a tie). Missing steps have null with
    ``fill="mark"``, the value before with ``"previous"``, and one on the line between both sides with ``"linear"``.
    ``bounds`` are the first and last time (constants, or expressions over ``key``) that every key is extended to.
    ``emit="missing"`` lists only the missing steps and explodes nothing else. Repeated rows change nothing; an empty
    table gives no rows.

    Readings are first reduced to one per key and first step, on the map side too, so what a key brings to the window
    is bounded by the length of the calendar and not by its rows. The window pairs each with the next one (``lead``), and
    only the steps between the two are made.
    """
    if fill not in ("mark", "previous", "linear") or emit not in ("all", "missing"):
        raise ValueError("fill is 'mark', 'previous' or 'linear'; emit is 'all' or 'missing'")
    size = micros_of(step)
    none = F.lit(None).cast("timestamp")
    s, e, t = micros(start if start is not None else none), micros(end if end is not None else none), micros(time)
    floor = lambda us: F.floor(us / F.lit(size)).cast("long")
    usable = F.coalesce(e >= s, F.lit(False))
    rows = df.select(
        F.col(key).alias("k"), floor(F.when(usable, s).otherwise(t)).alias("lo"), floor(F.when(usable, e).otherwise(t)).alias("hi"),
        F.when(usable, e).otherwise(t).alias("at"), (value if value is not None else F.lit(None)).cast("double").alias("v"),
    ).where(F.col("k").isNotNull() & F.col("lo").isNotNull())
    latest = F.max(F.when(F.col("v").isNotNull(), F.struct("at", "v")))["v"] if value is not None else F.lit(None).cast("double")
    ranges = rows.groupBy("k", "lo").agg(F.max("hi").alias("hi"), latest.alias("v"))
    w = Window.partitionBy("k").orderBy("lo")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    paired = ranges.select(
        "k", "lo", "hi", "v", F.max("hi").over(upto).alias("top"), F.lag("lo").over(w).isNull().alias("is_first"),
        F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("covered"), F.lead("lo").over(w).alias("next"), F.lead("v").over(w).alias("next_v"),
    )
    gap = F.col("next") - F.col("top") - 1
    listed = (gap > 0) if max_gap is None else (gap > 0) & (gap <= max_gap)
    steps = lambda a, b: F.when(a <= b, F.sequence(a, b))
    if fill == "linear":
        between = lambda x: F.col("v") + (F.col("next_v") - F.col("v")) * (x - F.col("top")) / (F.col("next") - F.col("top"))
    else:
        between = lambda x: F.col("v") if fill == "previous" else F.lit(None).cast("double")
    made = lambda state, array, v: F.transform(array, lambda x: F.struct(x.alias("step"), F.lit(state).alias("state"), v(x).alias("value")))
    missing = made("missing", F.when(listed, steps(F.col("top") + 1, F.col("next") - 1)), between)
    if emit == "missing":
        return paired.where(listed).select(F.col("k").alias(key), F.explode(missing).alias("x")).select(key, "x.*")
    parts = [made("reading", steps(F.greatest(F.col("lo"), F.coalesce(F.col("covered") + 1, F.col("lo"))), F.col("hi")), lambda _: F.col("v")), missing]
    if bounds is not None:
        blank = lambda _: F.lit(None).cast("double")
        first, last = (floor(micros(b)) for b in bounds)
        parts += [made("outside", F.when(F.col("is_first"), steps(first, F.col("lo") - 1)), blank), made("outside", F.when(F.col("next").isNull(), steps(F.col("top") + 1, last)), blank)]
    none_of = F.array().cast("array<struct<step:bigint,state:string,value:double>>")
    every = F.concat(*(F.coalesce(p, none_of) for p in parts))
    return paired.select(F.col("k").alias(key), F.explode(every).alias("x")).select(key, "x.*")
