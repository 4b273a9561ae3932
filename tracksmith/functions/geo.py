"""Positions, distances and projections as column expressions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean earth radius in metres (IUGG) for great-circle distances.
EARTH_RADIUS_M = 6_371_008.8
#: Radius of the sphere of the web Mercator projection in metres.
MERCATOR_RADIUS_M = 6_378_137.0
#: Default study area: latitude from, to, longitude from, to.
STUDY_AREA = (10.0, 15.0, 139.0, 144.0)

_NUMBER = r"([-+0-9.eE]+)"
_WKT_POINT = rf"(?i)^\s*(?:srid\s*=\s*\d+\s*;)?\s*point\s*(?:zm|z|m)?\s*\(\s*{_NUMBER}\s+{_NUMBER}"


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    # not least(): it skips nulls, and a missing point must give no distance
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.when(a > 1.0, F.lit(1.0)).otherwise(F.sqrt(a)))


def haversine_np(lat1, lon1, lat2, lon2):
    """The same over NumPy arrays."""
    lat1, lon1, lat2, lon2 = map(np.radians, (lat1, lon1, lat2, lon2))
    a = np.sin((lat2 - lat1) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin((lon2 - lon1) / 2) ** 2
    return 2 * EARTH_RADIUS_M * np.arcsin(np.minimum(1.0, np.sqrt(a)))


def wkt_x(geometry: Column) -> Column:
    """First coordinate of a WKT point in any spelling; null for empty, NaN-free failure or other shapes."""
    return F.regexp_extract(geometry, _WKT_POINT, 1).try_cast("double")


def wkt_y(geometry: Column) -> Column:
    """Second coordinate of a WKT point."""
    return F.regexp_extract(geometry, _WKT_POINT, 2).try_cast("double")


def position(lat: Column, lon: Column, geometry: Column, area: tuple[float, float, float, float] = STUDY_AREA) -> Column:
    """G2: ``struct<lat, lon>`` of a record, or null.

    ``lat``/``lon`` count if they are a point of the area as they stand or exchanged; otherwise the point of
    ``geometry`` (x = lon, y = lat, or exchanged); otherwise there is none. NaN is in no area.
    """
    la0, la1, lo0, lo1 = area

    def within(a: Column, b: Column) -> Column:
        return a.between(la0, la1) & b.between(lo0, lo1)

    def point(a: Column, b: Column) -> Column:
        return F.struct(a.alias("lat"), b.alias("lon"))

    x, y = wkt_x(geometry), wkt_y(geometry)
    return (
        F.when(within(lat, lon), point(lat, lon))
        .when(within(lon, lat), point(lon, lat))
        .when(within(y, x), point(y, x))
        .when(within(x, y), point(x, y))
    )


def to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """EPSG:4326 degrees to EPSG:3857 metres."""
    return F.lit(MERCATOR_RADIUS_M) * F.radians(lon), F.lit(MERCATOR_RADIUS_M) * F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2))


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    """EPSG:3857 metres to EPSG:4326 degrees (lon, lat)."""
    return F.degrees(x / MERCATOR_RADIUS_M), F.degrees(F.lit(2.0) * F.atan(F.exp(y / MERCATOR_RADIUS_M)) - F.lit(math.pi / 2))


def planar(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """G3: Euclidean distance in the units of the coordinates."""
    return F.hypot(x2 - x1, y2 - y1)
