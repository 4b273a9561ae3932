"""Polygon layers: ``cell_id, geometry`` (WKT), the box around each polygon and its middle."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracksmith.functions.projections import known, reproject
from tracksmith.operators.spatial_join import rings_of
from tracksmith.operators.trajectory import UnsupportedCrs


def layer(df: DataFrame, cell_id: str, geometry: str) -> DataFrame:
    """IO7: ``cell_id, geometry, xmin, ymin, xmax, ymax, cx, cy`` of a table with WKT polygons; ``cx, cy`` is the centre of area.

    Holes count as holes. Rows whose text is no polygon are left out.
    """

    @F.pandas_udf("xmin double, ymin double, xmax double, ymax double, cx double, cy double")
    def measure(wkt: pd.Series) -> pd.DataFrame:
        rows = []
        for text in wkt:
            polygons = rings_of(text)
            if not polygons:
                rows.append((None,) * 6)
                continue
            xs, ys = zip(*(p for rings in polygons for p in rings[0]))
            area = sx = sy = 0.0
            for rings in polygons:
                for k, ring in enumerate(rings):
                    terms = [(a[0] * b[1] - b[0] * a[1], a[0] + b[0], a[1] + b[1]) for a, b in zip(ring, ring[1:] + ring[:1])]
                    own = sum(t[0] for t in terms)
                    # outlines add, holes take away, whichever way they run
                    sign = (1 if own > 0 else -1) * (1 if k == 0 else -1)
                    area += sign * own
                    sx += sign * sum(t[0] * t[1] for t in terms)
                    sy += sign * sum(t[0] * t[2] for t in terms)
            rows.append((min(xs), min(ys), max(xs), max(ys), sx / (3 * area) if area else None, sy / (3 * area) if area else None))
        return pd.DataFrame(rows, columns=["xmin", "ymin", "xmax", "ymax", "cx", "cy"]).astype(float)

    measured = df.select(F.col(cell_id).alias("cell_id"), F.col(geometry).alias("geometry")).withColumn("m", measure("geometry"))
    return measured.where(F.col("m.xmin").isNotNull()).select("cell_id", "geometry", "m.*")


def to_crs(df: DataFrame, here: str, there: str) -> DataFrame:
    """A layer (``cell_id, geometry``) in another system, vertex by vertex, measured anew; see ``Trajectories.to_crs`` for those known."""
    here, there = ("".join(filter(str.isdigit, c)) for c in (here, there))
    if not (known(here) and known(there)):
        raise UnsupportedCrs(f"from {here} to {there}")

    @F.pandas_udf("string")
    def moved(wkt: pd.Series) -> pd.Series:
        def ring(points) -> str:
            x, y = reproject(*np.array([*points, points[0]], float).T, here, there)
            return "(" + ", ".join(f"{a!r} {b!r}" for a, b in zip(x.tolist(), y.tolist())) + ")"

        return wkt.map(lambda text: "MULTIPOLYGON (" + ", ".join("(" + ", ".join(map(ring, rings)) + ")" for rings in rings_of(text)) + ")" if rings_of(text) else None)

    return layer(df.select("cell_id", moved("geometry").alias("geometry")).where(F.col("geometry").isNotNull()), "cell_id", "geometry")


def read_geojson(spark: SparkSession, path: str, cell_id: str | None = None, lines: bool = False) -> DataFrame:
    """IO7: a layer from a GeoJSON feature collection; ``cell_id`` names a property, else features are numbered as they stand.

    With ``lines`` there is a feature in every line instead, read in parallel, and ``cell_id`` must be named.
    """
    feature = "struct<properties: map<string, string>, geometry: struct<type: string, coordinates: string>>"
    if lines:
        if cell_id is None:
            raise ValueError("name the property with the id")
        features = spark.read.text(path).select(F.lit(0).alias("n"), F.from_json("value", feature).alias("f"))
    else:
        features = spark.read.schema(f"features array<{feature}>").option("multiLine", True).json(path).select(F.posexplode("features").alias("n", "f"))
    number = r"(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)"
    pairs = F.regexp_replace("f.geometry.coordinates", rf"\[\s*{number}\s*,\s*{number}\s*(?:,[^\[\]]*)?\]", "$1 $2")
    wkt = F.concat(F.upper("f.geometry.type"), F.lit(" "), F.translate(pairs, "[]", "()"))
    name = F.col("n").cast("long") if cell_id is None else F.col("f.properties")[cell_id].try_cast("long")
    return layer(features.select(name.alias("cell_id"), wkt.alias("geometry")), "cell_id", "geometry")
