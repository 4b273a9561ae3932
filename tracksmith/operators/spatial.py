"""Spatial aggregation (SP1-SP11), layers and shapes (G4, G6-G8)."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracksmith.operators.spatial_join import matches, triangles
from tracksmith.operators.trajectory import in_time
from tracksmith.storage import materialize


def resolution_to_points(resolution: float, c_max: float, c_min: float) -> int:
    """SP9: how many edges a side has."""
    return math.ceil((c_max - c_min) / resolution + 1)


def number_rows(df: DataFrame, *order: str) -> DataFrame:
    """``number``: place of each row in the order, from 0. Sorted and counted by ranges; only their sizes reach the driver."""
    ranged = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()), "ranges")
    sizes = dict(map(tuple, ranged.groupBy("_p").count().collect()))
    before, total = {}, 0
    for p in sorted(sizes):
        before[p] = total
        total += sizes[p]
    offset = F.lit(0).cast("long") if not before else F.element_at(F.create_map(*(F.lit(x) for p, b in before.items() for x in (p, b))), F.col("_p"))
    return ranged.withColumn("number", offset + F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1).drop("_p")


def moving_average(df: DataFrame, value: str, order: str, n: int = 2, block: int = 1_000_000) -> DataFrame:
    """SP10: mean of each ``n`` successive values; rows without ``n`` values before them drop out.

    Rows are numbered by ranges and averaged in blocks, each with the last rows of the one before.
    """
    block = max(block, n)
    rows = number_rows(df.select(F.col(order).alias("_o"), F.col(value).alias("_v")), "_o")
    own = F.floor(F.col("number") / block)
    copies = F.when(F.pmod("number", F.lit(block)) >= block - (n - 1), F.array(own, own + 1)).otherwise(F.array(own))
    w = Window.partitionBy("_b").orderBy("number").rowsBetween(-(n - 1), 0)
    rows = rows.withColumns({"_own": own, "_b": F.explode(copies)}).withColumns({"value": F.avg("_v").over(w), "_n": F.count("_v").over(w)})
    return rows.where((F.col("_n") == n) & (F.col("_b") == F.col("_own"))).select(F.col("_o").alias(order), "value")


def to_labels(df: DataFrame) -> DataFrame:
    """SP8: ``labels``: number of the place by first appearance in order of user and time; null without a place."""
    seq = ["seq"] if "seq" in df.columns else []
    there = df.where(F.col("lon").isNotNull() & F.col("lat").isNotNull())
    first = there.groupBy("lon", "lat").agg(F.min(F.struct("user_id", "datetime", *seq)).alias("f"))
    places = number_rows(first.select("lon", "lat", F.col("f.user_id").alias("u"), F.col("f.datetime").alias("t"), *(F.col(f"f.{s}").alias("q") for s in seq)), "u", "t", *(["q"] if seq else []), "lon", "lat")
    return df.drop("labels").join(places.select("lon", "lat", F.col("number").cast("int").alias("labels")), ["lon", "lat"], "left").select(*(c for c in df.columns if c != "labels"), "labels")


@dataclass(frozen=True)
class GridAggregation:
    """SP1-SP3: points to the centres of a regular grid of cells no wider than ``resolution`` that just fits the extent."""

    resolution: float = 300
    x_min: float | None = None
    x_max: float | None = None
    y_min: float | None = None
    y_max: float | None = None

    def extent(self, df: DataFrame) -> tuple[float, float, float, float]:
        given = (self.x_min, self.x_max, self.y_min, self.y_max)
        if None not in given:
            return given
        found = df.agg(F.min("lon"), F.max("lon"), F.min("lat"), F.max("lat")).first()
        return tuple(f if g is None else g for g, f in zip(given, found))

    def axis(self, v: Column, lo: float | None, hi: float | None) -> Column:
        """Centre of the cell; the greatest edge belongs to the last cell, what lies outside has none."""
        if lo is None or hi is None:
            return F.lit(None).cast("double")
        if hi == lo:
            return F.when(v == lo, F.lit(float(lo)))
        m = resolution_to_points(self.resolution, hi, lo) - 1
        w = (hi - lo) / m
        k = F.least(F.floor((v - F.lit(lo)) / F.lit(w)), F.lit(m - 1))
        return F.when((v >= lo) & (v <= hi), F.lit(lo) + (k + 0.5) * F.lit(w))

    def aggregate(self, df: DataFrame, inplace: bool = True, labels: bool = True) -> DataFrame:
        x0, x1, y0, y1 = self.extent(df)
        old = {} if inplace else {"old_lon": F.col("lon"), "old_lat": F.col("lat")}
        out = df.withColumns({**old, "lon": self.axis(F.col("lon"), x0, x1), "lat": self.axis(F.col("lat"), y0, y1)})
        # a point outside on one axis has no cell
        both = F.col("lon").isNotNull() & F.col("lat").isNotNull()
        out = out.withColumns({"lon": F.when(both, F.col("lon")), "lat": F.when(both, F.col("lat"))})
        return to_labels(out) if labels else out


#: The same under its other name.
GridAggregator = GridAggregation


def create_grid(df: DataFrame, resolution: float) -> DataFrame:
    """SP4: all cells over the extent, by x and then y: ``cell_id, xmin, ymin, xmax, ymax, cx, cy``."""
    x0, x1, y0, y1 = df.agg(F.min("lon"), F.max("lon"), F.min("lat"), F.max("lat")).first()
    nx, ny = (max(1, resolution_to_points(resolution, hi, lo) - 1) for lo, hi in ((x0, x1), (y0, y1)))
    wx, wy = (x1 - x0) / nx, (y1 - y0) / ny
    cells = df.sparkSession.range(nx * ny).select(F.col("id").alias("cell_id"), F.floor(F.col("id") / ny).alias("i"), F.pmod(F.col("id"), F.lit(ny)).alias("j"))
    edge = lambda lo, w, k: F.lit(lo) + k * F.lit(w)
    return cells.select(
        "cell_id", edge(x0, wx, F.col("i")).alias("xmin"), edge(y0, wy, F.col("j")).alias("ymin"), edge(x0, wx, F.col("i") + 1).alias("xmax"), edge(y0, wy, F.col("j") + 1).alias("ymax"),
        edge(x0, wx, F.col("i") + 0.5).alias("cx"), edge(y0, wy, F.col("j") + 0.5).alias("cy"),
    )


def box_wkt(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    a, b, c, d = (v.cast("string") for v in (xmin, ymin, xmax, ymax))
    return F.concat(F.lit("POLYGON (("), a, F.lit(" "), b, F.lit(", "), c, F.lit(" "), b, F.lit(", "), c, F.lit(" "), d, F.lit(", "), a, F.lit(" "), d, F.lit(", "), a, F.lit(" "), b, F.lit("))"))


def locate(df: DataFrame, layer: DataFrame, cell_id: str = "cell_id", geometry: str = "geometry") -> DataFrame:
    """G6: ``lon, lat, cell_id`` of every distinct place inside a cell of a polygon layer (see ``near_and_within``)."""
    places = df.select("lon", "lat").where(F.col("lon").isNotNull() & F.col("lat").isNotNull()).distinct()
    # only planar tests are made; the distance plays no part
    found = matches(places.select(F.lit(0).cast("long").alias("id"), F.col("lat").cast("double").alias("la"), F.col("lon").cast("double").alias("lo")), triangles(layer, cell_id, geometry), 0.0, key=("lo", "la"))
    return found.select(F.col("lo").alias("lon"), F.col("la").alias("lat"), F.col("target").alias(cell_id))


@dataclass(frozen=True)
class LayerAggregator:
    """SP7: points to the centres of the polygons that contain them; ``layer`` has ``cell_id, geometry, cx, cy``."""

    layer: DataFrame

    def aggregate(self, df: DataFrame, drop_unmatched: bool = True, labels: bool = False) -> DataFrame:
        places = locate(df, self.layer).join(self.layer.select("cell_id", "cx", "cy"), "cell_id")
        out = df.join(places, ["lon", "lat"], "inner" if drop_unmatched else "left")
        out = out.select("user_id", "datetime", F.col("cx").alias("lon"), F.col("cy").alias("lat"), *(c for c in df.columns if c not in ("user_id", "datetime", "lon", "lat", "cell_id")), "cell_id")
        return to_labels(out) if labels else out


def filter_layer(layer: DataFrame, df: DataFrame) -> DataFrame:
    """SP11: cells of a layer with at least one record."""
    return layer.join(locate(df, layer).select("cell_id").distinct(), "cell_id", "left_semi")


def dbscan(x: np.ndarray, y: np.ndarray, eps: float = 0.5, min_samples: int = 5) -> np.ndarray:
    """Density clusters of points, numbered as they are met; -1 is noise. Neighbours come from a grid of cells of side ``eps``."""
    n = len(x)
    labels = np.full(n, -1)
    cells: dict[tuple[int, int], list[int]] = {}
    cx, cy = np.floor(x / eps).astype(np.int64), np.floor(y / eps).astype(np.int64)
    for i, c in enumerate(zip(cx.tolist(), cy.tolist())):
        cells.setdefault(c, []).append(i)
    held = {c: np.array(m) for c, m in cells.items()}

    def near(i: int) -> np.ndarray:
        at = np.concatenate([m for a in (-1, 0, 1) for b in (-1, 0, 1) if (m := held.get((cx[i] + a, cy[i] + b))) is not None])
        return at[(x[at] - x[i]) ** 2 + (y[at] - y[i]) ** 2 <= eps * eps]

    number, done = 0, np.zeros(n, bool)
    for i in range(n):
        if done[i]:
            continue
        around = near(i)
        if len(around) < min_samples:
            continue
        todo = [i]
        done[i] = True
        labels[i] = number
        while todo:
            around = near(todo.pop())
            if len(around) < min_samples:
                continue
            labels[around[labels[around] < 0]] = number
            fresh = around[~done[around]]
            done[fresh] = True
            todo += fresh.tolist()
        number += 1
    return labels


@dataclass(frozen=True)
class ClusteringAggregator:
    """SP5, SP6: each user's points clustered, and points put to the mean of their cluster.

    ``algorithm`` gets arrays x and y and the keywords and returns labels (-1 is noise); ``dbscan`` by default. It may also
    be a class with ``fit(array)`` and ``labels_``. Labels are numbered within the user. A user's points are held in one
    task, two doubles each.
    """

    algorithm: Callable = dbscan
    kwargs: dict | None = None

    def aggregate(self, df: DataFrame, drop_noise: bool = False, centres_as_geometry: bool = True, compat: bool = False) -> DataFrame:
        """With ``compat`` the records of noise stay with nothing but user and time."""
        algorithm, kwargs = self.algorithm, dict(self.kwargs or {})
        rows = df.drop("labels").withColumn("_n", F.row_number().over(in_time(df)))
        slim = rows.where(F.col("lon").isNotNull() & F.col("lat").isNotNull()).select("user_id", "_n", "lon", "lat")

        def fit(pdf):
            pdf = pdf.sort_values("_n")
            x, y = pdf["lon"].to_numpy(), pdf["lat"].to_numpy()
            found = algorithm(**kwargs).fit(np.column_stack([x, y])).labels_ if isinstance(algorithm, type) else algorithm(x, y, **kwargs)
            return pdf.assign(labels=found)[["user_id", "_n", "labels"]]

        labelled = rows.join(slim.groupBy("user_id").applyInPandas(fit, f"user_id {dict(df.dtypes)['user_id']}, _n int, labels int"), ["user_id", "_n"], "left")
        if drop_noise:
            labelled = labelled.where(F.col("labels") >= 0)
        if centres_as_geometry:
            w = Window.partitionBy("user_id", "labels")
            labelled = labelled.withColumns({c: F.when(F.col("labels") >= 0, F.avg(c).over(w)).otherwise(F.col(c)) for c in ("lon", "lat")})
        if compat:
            noise = F.coalesce(F.col("labels") < 0, F.lit(False))
            labelled = labelled.withColumns({c: F.when(~noise, F.col(c)) for c in labelled.columns if c not in ("user_id", "datetime", "_n")})
        return labelled.drop("_n")


def centroid(ring: Column) -> Column:
    """G4: centre of area of an open ring ``array<struct<x,y>>``."""
    pairs = F.arrays_zip(ring.alias("p"), F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1)).alias("q"))
    parts = F.transform(pairs, lambda e: F.struct((e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"]).alias("a"), (e["p"]["x"] + e["q"]["x"]).alias("sx"), (e["p"]["y"] + e["q"]["y"]).alias("sy")))
    add = lambda f: F.aggregate(parts, F.lit(0.0), lambda s, e: s + f(e))
    area = add(lambda e: e["a"])
    return F.struct((add(lambda e: e["sx"] * e["a"]) / (3 * area)).alias("x"), (add(lambda e: e["sy"] * e["a"]) / (3 * area)).alias("y"))


def in_annulus(distance: Column, around: Column, spread: float | None) -> Column:
    """G7: at a distance within ``spread`` of ``around``; without spread at most 1.01 times as far."""
    return distance <= 1.01 * around if spread is None else distance.between(around * (1 - spread), around * (1 + spread))


def in_ellipse(x: Column, y: Column, home_x: Column, home_y: Column, work_x: Column, work_y: Column, spread: float) -> Column:
    """G8: inside the ellipse around home whose long half-axis reaches to work and whose short one is ``spread`` times that."""
    a = F.hypot(work_x - home_x, work_y - home_y)
    u = ((x - home_x) * (work_x - home_x) + (y - home_y) * (work_y - home_y)) / a
    v = ((y - home_y) * (work_x - home_x) - (x - home_x) * (work_y - home_y)) / a
    return F.when(a == 0, (x == home_x) & (y == home_y)).otherwise(F.pow(u / a, 2) + F.pow(v / (a * spread), 2) <= 1)
