"""Plane coordinate systems beyond the web Mercator: UTM on WGS 84 and the British national grid, by closed series."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tracksmith.functions.geo import MERCATOR_RADIUS_M

# Half-axes of the ellipsoids, and the step from WGS 84 to the datum of the British grid
# (metres, parts per million, seconds of arc).
WGS84, AIRY = (6378137.0, 6356752.314245), (6377563.396, 6356256.909)
TO_OSGB36 = (-446.448, 125.157, -542.060, 20.4894, -0.1502, -0.2470, -0.8421)


@dataclass(frozen=True)
class TransverseMercator:
    """A transverse Mercator projection (series in the third flattening up to its fourth power, better than a millimetre)."""

    axes: tuple[float, float]
    lat0: float
    lon0: float
    scale: float
    east: float
    north: float
    shift: tuple[float, ...] | None = None

    def _series(self):
        a, b = self.axes
        n = (a - b) / (a + b)
        radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
        alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
        beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280)
        return radius * self.scale, alpha, beta, 2 * np.sqrt(n) / (1 + n)

    def _plane(self, lon, lat):
        radius, alpha, _, e = self._series()
        s, turn = np.sin(np.radians(lat)), np.radians(lon - self.lon0)
        t = np.sinh(np.arctanh(s) - e * np.arctanh(e * s))
        xi, eta = np.arctan2(t, np.cos(turn)), np.arctanh(np.sin(turn) / np.sqrt(1 + t * t))
        x = eta + sum(c * np.cos(2 * j * xi) * np.sinh(2 * j * eta) for j, c in enumerate(alpha, 1))
        y = xi + sum(c * np.sin(2 * j * xi) * np.cosh(2 * j * eta) for j, c in enumerate(alpha, 1))
        return radius * x, radius * y

    def forward(self, lon, lat):
        """Degrees on the projection's own datum to metres."""
        x, y = self._plane(lon, lat)
        return self.east + x, self.north + y - self._plane(np.float64(self.lon0), np.float64(self.lat0))[1]

    def inverse(self, x, y):
        radius, _, beta, e = self._series()
        xi, eta = (y - self.north + self._plane(np.float64(self.lon0), np.float64(self.lat0))[1]) / radius, (x - self.east) / radius
        p = xi - sum(c * np.sin(2 * j * xi) * np.cosh(2 * j * eta) for j, c in enumerate(beta, 1))
        q = eta - sum(c * np.cos(2 * j * xi) * np.sinh(2 * j * eta) for j, c in enumerate(beta, 1))
        conformal = np.arctanh(np.sin(p) / np.cosh(q))
        s = np.tanh(conformal)
        for _ in range(8):
            s = np.tanh(conformal + e * np.arctanh(e * s))
        return self.lon0 + np.degrees(np.arctan2(np.sinh(q), np.cos(p))), np.degrees(np.arcsin(s))


def _to_space(lon, lat, axes):
    a, b = axes
    e2 = 1 - (b / a) ** 2
    lo, la = np.radians(lon), np.radians(lat)
    v = a / np.sqrt(1 - e2 * np.sin(la) ** 2)
    return v * np.cos(la) * np.cos(lo), v * np.cos(la) * np.sin(lo), v * (1 - e2) * np.sin(la)


def _from_space(x, y, z, axes):
    a, b = axes
    e2 = 1 - (b / a) ** 2
    p = np.hypot(x, y)
    la = np.arctan2(z, p * (1 - e2))
    for _ in range(8):
        v = a / np.sqrt(1 - e2 * np.sin(la) ** 2)
        la = np.arctan2(z + e2 * v * np.sin(la), p)
    return np.degrees(np.arctan2(y, x)), np.degrees(la)


def shift_datum(lon, lat, source, target, step, back: bool):
    """Longitude and latitude on another datum by a seven-parameter step (``back``: the exact reverse of it)."""
    x = np.stack(_to_space(lon, lat, source))
    scale, (rx, ry, rz) = 1 + step[3] * 1e-6, np.radians(np.array(step[4:]) / 3600)
    turn = np.array([[scale, -rz, ry], [rz, scale, -rx], [-ry, rx, scale]])
    moved = np.array(step[:3]).reshape(3, *[1] * (x.ndim - 1))
    out = np.tensordot(np.linalg.inv(turn), x - moved, 1) if back else np.tensordot(turn, x, 1) + moved
    return _from_space(*out, target)


def projection(code: str) -> TransverseMercator | None:
    """The projection of an EPSG code: 27700, 32601 to 32660 and 32701 to 32760; nothing for others."""
    if code == "27700":
        return TransverseMercator(AIRY, 49.0, -2.0, 0.9996012717, 400_000.0, -100_000.0, TO_OSGB36)
    if len(code) == 5 and code[:3] in ("326", "327") and 1 <= int(code[3:]) <= 60:
        return TransverseMercator(WGS84, 0.0, int(code[3:]) * 6 - 183.0, 0.9996, 500_000.0, 0.0 if code[2] == "6" else 10_000_000.0)
    return None


def known(code: str) -> bool:
    return code in ("4326", "3857") or projection(code) is not None


def reproject(x, y, here: str, there: str):
    """Coordinates (NumPy) of one EPSG code in another; by way of longitude and latitude on WGS 84."""
    if here == "3857":
        x, y = np.degrees(x / MERCATOR_RADIUS_M), np.degrees(2 * np.arctan(np.exp(y / MERCATOR_RADIUS_M)) - np.pi / 2)
    elif here != "4326":
        p = projection(here)
        x, y = p.inverse(x, y)
        if p.shift:
            x, y = shift_datum(x, y, p.axes, WGS84, p.shift, True)
    if there == "3857":
        return MERCATOR_RADIUS_M * np.radians(x), MERCATOR_RADIUS_M * np.log(np.tan(np.pi / 4 + np.radians(y) / 2))
    if there != "4326":
        p = projection(there)
        if p.shift:
            x, y = shift_datum(x, y, WGS84, p.axes, p.shift, False)
        return p.forward(x, y)
    return x, y


def reprojected(x: Column, y: Column, here: str, there: str) -> Column:
    """``struct<lon, lat>`` in another system, a batch at a time; null coordinates stay null."""

    @F.pandas_udf("lon double, lat double")
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        with np.errstate(all="ignore"):
            a, b = reproject(x.to_numpy(float), y.to_numpy(float), here, there)
        both = np.isfinite(a) & np.isfinite(b)
        return pd.DataFrame({"lon": np.where(both, a, np.nan), "lat": np.where(both, b, np.nan)})

    moved = run(x.cast("double"), y.cast("double"))
    one = lambda c: F.when(~F.isnan(moved[c]), moved[c])
    return F.struct(one("lon").alias("lon"), one("lat").alias("lat"))
