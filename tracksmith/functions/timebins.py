"""Durations as text, and regular time bins."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = {
    "us": 1, "ms": 1_000, "s": 1_000_000, "sec": 1_000_000, "second": 1_000_000, "t": 60_000_000, "min": 60_000_000, "minute": 60_000_000,
    "h": 3_600_000_000, "hour": 3_600_000_000, "d": 86_400_000_000, "day": 86_400_000_000, "w": 604_800_000_000, "week": 604_800_000_000,
}


def micros_of(resolution: str) -> int:
    """``'1H'``, ``'10 min'``, ``'D'``, ``'7 days'`` in microseconds."""
    m = re.fullmatch(r"\s*(\d*)\s*([A-Za-z]+?)s?\s*", resolution)
    unit = m and (_UNITS.get(m[2].lower()) or _UNITS.get(m[2].lower() + "s"))
    if not unit:
        raise ValueError(f"not a resolution: {resolution!r}")
    n = int(m[1] or 1)
    if n < 1:
        raise ValueError(f"a resolution must be positive: {resolution!r}")
    return n * unit


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a timestamp with or without zone (sessions run in UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def floor_to(us: Column, step: int, origin: Column | int = 0) -> Column:
    """Start of the bin of ``us`` for bins of ``step`` microseconds from ``origin``."""
    o = F.lit(origin) if isinstance(origin, int) else origin
    return us - F.pmod(us - o, F.lit(step))
