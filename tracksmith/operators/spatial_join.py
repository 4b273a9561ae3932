"""Problem 7: points joined to the regions that contain them and to the other points near them."""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracksmith.functions.geo import EARTH_RADIUS_M, haversine_np
from tracksmith.storage import materialize

#: Regions and targets are sent to all executors only up to this many triangles and discs together.
BROADCAST_ITEMS = 100_000
#: Items aimed at in a tile of the top of the hierarchy, least and greatest number of tiles, boxes sampled for each to lay
#: them and greatest number of those.
TILE_ITEMS, TILES, SAMPLED_BOXES = 2_000, (1024, 65_536), (48, 1_000_000)
#: Points and items of a tile handled at once.
TILE_POINTS, TILE_BLOCK = 200_000, 50_000
#: Reflex vertices beyond which an ear is tested with arrays.
MANY_REFLEX = 48

_RING = re.compile(r"\(([^()]+)\)")


def rings_of(wkt: str | None) -> list[list[list[tuple[float, float]]]]:
    """Polygons of a WKT polygon or multipolygon, each a list of rings without the closing point; none for other text."""
    if not wkt or not re.match(r"\s*(SRID=\d+;)?\s*(MULTI)?POLYGON", wkt, re.IGNORECASE):
        return []
    bodies = re.findall(r"\(\s*\([^()]+\)(?:\s*,\s*\([^()]+\))*\s*\)", wkt)
    out = []
    for body in bodies:
        rings = []
        for ring in _RING.findall(body):
            points = [tuple(map(float, p.split()[:2])) for p in ring.split(",")]
            points = [p for i, p in enumerate(points) if p != points[i - 1]] if len(points) > 1 else points
            if len(points) >= 3:
                rings.append(points)
        if rings:
            out.append(rings)
    return out


def _cross(o, a, b) -> float:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def _area(ring) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1])) / 2


def _edges(rings) -> np.ndarray:
    """Edges x1, y1, x2, y2 of all rings."""
    return np.array([(*p, *q) for r in rings for p, q in zip(r, r[1:] + r[:1])], float)


def _turns(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """On which sides of each edge of ``a`` the ends of each edge of ``b`` lie, and the other way round."""
    a = a[:, None, :]
    side = lambda e, x, y: (e[..., 2] - e[..., 0]) * (y - e[..., 1]) - (e[..., 3] - e[..., 1]) * (x - e[..., 0])
    return side(a, b[:, 0], b[:, 1]), side(a, b[:, 2], b[:, 3]), side(b, a[..., 0], a[..., 1]), side(b, a[..., 2], a[..., 3])


def crossings(edges: np.ndarray) -> np.ndarray:
    """Heights at which edges properly cross, found block by block in order of their left ends."""
    edges = edges[np.argsort(np.minimum(edges[:, 0], edges[:, 2]), kind="stable")]
    left, right = np.minimum(edges[:, 0], edges[:, 2]), np.maximum(edges[:, 0], edges[:, 2])
    out = []
    for s in range(0, len(edges), 256):
        block = edges[s : s + 256]
        others = edges[s : np.searchsorted(left, right[s : s + 256].max(), "right")]
        d1, d2, d3, d4 = _turns(block, others)
        i, j = np.nonzero((d1 * d2 < 0) & (d3 * d4 < 0))
        share = d3[i, j] / (d3[i, j] - d4[i, j])
        out.append(block[i, 1] + share * (block[i, 3] - block[i, 1]))
    return np.unique(np.concatenate(out)) if out else np.zeros(0)


def slabs(rings, heights: np.ndarray) -> list[tuple]:
    """Triangles of what lies inside of an odd number of rings, cut at the heights of all vertices and crossings."""
    edges = _edges(rings)
    edges = edges[edges[:, 1] != edges[:, 3]]
    x1, y1, x2, y2 = np.where((edges[:, 1] < edges[:, 3])[:, None], edges, edges[:, [2, 3, 0, 1]]).T
    levels = np.unique(np.concatenate([y1, y2, heights]))
    out = []
    for lo, hi in zip(levels, levels[1:]):
        at = np.nonzero((y1 <= lo) & (y2 >= hi))[0]
        x = lambda y: x1[at] + (y - y1[at]) / (y2[at] - y1[at]) * (x2[at] - x1[at])  # noqa: B023, E731
        order = np.argsort(x((lo + hi) / 2), kind="stable")
        low, high = x(lo)[order].tolist(), x(hi)[order].tolist()
        for k in range(0, len(order) - 1, 2):
            a, b, c, d = (low[k], lo), (low[k + 1], lo), (high[k + 1], hi), (high[k], hi)
            out += [t for t in ((a, b, c), (a, c, d)) if _cross(*t) > 0]
    return [tuple((float(u), float(v)) for u, v in t) for t in out]


def _in_sight(outer, hole, edges: np.ndarray) -> tuple[int, int] | None:
    """Places of the nearest vertices of an outline and a hole whose segment meets no edge and no other vertex."""
    p, q = np.array(outer), np.array(hole)
    far = ((p[:, None, :] - q) ** 2).sum(2).ravel()
    for at in np.argsort(far, kind="stable"):
        i, j = divmod(int(at), len(q))
        a, b = outer[i], hole[j]
        ends = [(edges[:, k] == v[0]) & (edges[:, k + 1] == v[1]) for k in (0, 2) for v in (a, b)]
        touches = ends[0] | ends[1] | ends[2] | ends[3]
        d1, d2, d3, d4 = (v[0] for v in _turns(np.array([[*a, *b]]), edges))
        crossed = (d1 * d2 <= 0) & (d3 * d4 <= 0) & ((d1 != 0) | (d2 != 0))
        lies = lambda k: (_cross(a, b, (edges[:, k], edges[:, k + 1])) == 0) & ((edges[:, k] - a[0]) * (edges[:, k] - b[0]) + (edges[:, k + 1] - a[1]) * (edges[:, k + 1] - b[1]) < 0)  # noqa: B023, E731
        if not ((crossed & ~touches) | lies(0) | lies(2)).any():
            return i, j
    return None


def _clip(ring: list[tuple[float, float]]) -> list[tuple] | None:
    """Ear clipping of a ring that runs to the left; nothing if no ear is left."""
    ring, out, at, tried = list(ring), [], 0, 0
    turn_at = lambda k: _cross(ring[k - 1], ring[k], ring[(k + 1) % len(ring)])
    # an ear holds no vertex but its own if it holds none at which the ring does not turn left
    bent = [turn_at(k) <= 0 for k in range(len(ring))]
    reflex, known = None, 0
    while len(ring) > 3:
        n = len(ring)
        a, b, c = ring[at - 1], ring[at], ring[(at + 1) % n]
        turn = _cross(a, b, c)
        ear = turn == 0
        if turn > 0:
            if reflex is None:
                points = [p for p, r in zip(ring, bent) if r]
                known = len(points)
                reflex = np.array(points, float).reshape(-1, 2).T if known > MANY_REFLEX else points
            if known > MANY_REFLEX:
                p = reflex
                inside = (_cross(a, b, p) >= 0) & (_cross(b, c, p) >= 0) & (_cross(c, a, p) >= 0)
                for v in (a, b, c):
                    inside &= (p[0] != v[0]) | (p[1] != v[1])
                ear = not inside.any()
            else:
                ear = not any(p not in (a, b, c) and _cross(a, b, p) >= 0 and _cross(b, c, p) >= 0 and _cross(c, a, p) >= 0 for p in reflex)
        if ear:
            if turn > 0:
                out.append((a, b, c))
            ring.pop(at)
            bent.pop(at)
            at, tried = at % len(ring), 0
            for k in (at - 1, at):
                now = turn_at(k % len(ring)) <= 0
                if now != bent[k]:
                    bent[k], reflex = now, None
        elif tried > n:
            return None
        else:
            at, tried = (at + 1) % n, tried + 1
    if _cross(*ring) > 0:
        out.append(tuple(ring))
    return out


def triangulate(rings: list[list[tuple[float, float]]]) -> list[tuple]:
    """Triangles that cover a polygon, its holes left out, by ear clipping.

    Every hole is first joined to the outline by a bridge to the nearest vertex in sight. Rings may run either way.
    Rings that cross themselves or each other, and those that cannot be clipped whole (the triangles' area is compared
    with the polygon's), are cut into slabs instead; then what lies inside of an odd number of rings is inside.
    """
    heights = crossings(_edges(rings))
    if len(heights):
        return slabs(rings, heights)
    outer = list(rings[0]) if _area(rings[0]) > 0 else list(rings[0])[::-1]
    holes = [list(h) if _area(h) < 0 else list(h)[::-1] for h in rings[1:]]
    area = _area(outer) + sum(map(_area, holes))
    waiting = sorted(holes, key=lambda h: -max(p[0] for p in h))
    while waiting:
        hole = waiting.pop(0)
        bridge = _in_sight(outer, hole, _edges([outer, hole, *waiting]))
        if bridge is None:
            return slabs(rings, heights)
        i, j = bridge
        outer = outer[: i + 1] + hole[j:] + hole[: j + 1] + outer[i:]
    out = _clip(outer)
    if out is None or abs(sum(_cross(*t) for t in out) / 2 - area) > 1e-9 * max(abs(area), 1e-300):
        return slabs(rings, heights)
    return out


class BoxTree:
    """A bounding-volume hierarchy over boxes (x0, y0, x1, y1), split at the median of the longer side."""

    def __init__(self, boxes: np.ndarray, leaf: int = 8) -> None:
        self.boxes, self.leaf = boxes, leaf
        self.root = self._build(np.arange(len(boxes))) if len(boxes) else None

    def _build(self, items: np.ndarray):
        b = self.boxes[items]
        box = (b[:, 0].min(), b[:, 1].min(), b[:, 2].max(), b[:, 3].max())
        if len(items) <= self.leaf:
            return box, items, None
        middle = b[:, :2] + b[:, 2:]
        order = np.argsort(middle[:, int(np.ptp(middle[:, 1]) > np.ptp(middle[:, 0]))], kind="stable")
        half = len(items) // 2
        return box, self._build(items[order[:half]]), self._build(items[order[half:]])

    def pairs(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of points and boxes such that the box holds the point."""
        points, boxes = [], []
        todo = [(self.root, np.arange(len(x)))] if self.root and len(x) else []
        while todo:
            (box, left, right), at = todo.pop()
            at = at[(x[at] >= box[0]) & (x[at] <= box[2]) & (y[at] >= box[1]) & (y[at] <= box[3])]
            if not len(at):
                continue
            if right is not None:
                todo += [(left, at), (right, at)]
                continue
            b = self.boxes[left]
            px, py = x[at][:, None], y[at][:, None]
            i, j = np.nonzero((px >= b[:, 0]) & (px <= b[:, 2]) & (py >= b[:, 1]) & (py <= b[:, 3]))
            points.append(at[i])
            boxes.append(left[j])
        none = np.zeros(0, np.int64)
        return (np.concatenate(points), np.concatenate(boxes)) if points else (none, none)


def _side(ax, ay, bx, by, px, py) -> np.ndarray:
    """On which side of a-b a point lies. The ends are put in order first, so both triangles of an edge agree."""
    swap = (ax > bx) | ((ax == bx) & (ay > by))
    lx, ly, hx, hy = np.where(swap, bx, ax), np.where(swap, by, ay), np.where(swap, ax, bx), np.where(swap, ay, by)
    d = (hx - lx) * (py - ly) - (hy - ly) * (px - lx)
    return np.where(swap, -d, d)


class Targets:
    """Triangles of regions and discs around points in one hierarchy; ``match`` tests candidates exactly."""

    def __init__(self, items: np.ndarray, distance: float) -> None:
        # items: kind (0 triangle, 1 disc), id, ax, ay, bx, by, cx, cy (a disc: its middle in ax, ay)
        self.kind, self.id, self.at, self.distance = items["kind"], items["id"], items["at"], distance
        self.tree = BoxTree(item_boxes(self.kind, self.at, distance))

    def match(self, lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of points, kinds and ids, each once: the region of the smallest id where several hold a point."""
        p, i = self.tree.pairs(lon, lat)
        tri = self.kind[i] == 0
        tp, ti = p[tri], i[tri]
        ax, ay, bx, by, cx, cy = self.at[ti].T
        x, y = lon[tp], lat[tp]
        inside = (_side(ax, ay, bx, by, x, y) >= 0) & (_side(bx, by, cx, cy, x, y) >= 0) & (_side(cx, cy, ax, ay, x, y) >= 0)
        tp, tid = tp[inside], self.id[ti[inside]]
        order = np.lexsort((tid, tp))
        tp, tid = tp[order], tid[order]
        first = np.concatenate([[True], tp[1:] != tp[:-1]])[: len(tp)]
        dp, di = p[~tri], i[~tri]
        close = haversine_np(lat[dp], lon[dp], self.at[di, 1], self.at[di, 0]) <= self.distance
        dp, did = dp[close], self.id[di[close]]
        return np.concatenate([tp[first], dp]), np.concatenate([np.zeros(first.sum(), np.int8), np.ones(len(dp), np.int8)]), np.concatenate([tid[first], did])


def item_boxes(kind: np.ndarray, at: np.ndarray, distance: float) -> np.ndarray:
    """Boxes of triangles and discs; the disc that reaches (nearly) to a pole has all longitudes."""
    xs, ys = at[:, 0::2], at[:, 1::2]
    boxes = np.stack([xs.min(1), ys.min(1), xs.max(1), ys.max(1)], 1)
    disc = kind == 1
    dy = math.degrees(distance / EARTH_RADIUS_M) * (1 + 1e-9)
    reach = np.abs(ys[disc, 0]) + dy
    dx = np.degrees(np.arcsin(np.minimum(1.0, math.sin(math.radians(min(dy, 90.0))) / np.cos(np.radians(np.minimum(reach, 89.9)))))) * (1 + 1e-9)
    dx = np.where(reach >= 89.9, 540.0, dx)
    boxes[disc] += np.stack([-dx, np.full(len(dx), -dy), dx, np.full(len(dx), dy)], 1)
    return boxes


def _discs(others: DataFrame, other_id: str, other_lat: str, other_lon: str, distance: float) -> DataFrame:
    """Discs around points. One that passes the 180th meridian is there twice, 360 degrees apart."""
    x, y = F.col(other_lon).cast("double"), F.col(other_lat).cast("double")
    there = others.select(F.col(other_id).cast("long").alias("id"), x.alias("x"), y.alias("ay")).where(F.col("id").isNotNull() & F.col("ay").between(-90, 90) & F.col("x").between(-180, 180))
    dy = math.degrees(distance / EARTH_RADIUS_M) * (1 + 1e-6)
    width = F.degrees(F.asin(F.least(F.lit(1.0), F.lit(math.sin(math.radians(min(dy, 90.0)))) / F.cos(F.radians(F.abs("ay") + dy))))) * (1 + 1e-6)
    # near a pole the box has all longitudes anyway
    passes = (F.abs("ay") + dy < 89.9) & (F.abs("x") + width > 180)
    shifts = F.when(passes, F.array(F.lit(0.0), -F.signum("x") * 360.0)).otherwise(F.array(F.lit(0.0)))
    there = there.withColumn("s", F.explode(shifts)).select("id", "ay", (F.col("x") + F.col("s")).alias("ax"))
    return there.select(F.lit(1).cast("byte").alias("kind"), "id", "ax", "ay", F.col("ax").alias("bx"), F.col("ay").alias("by"), F.col("ax").alias("cx"), F.col("ay").alias("cy"))


_ITEM = np.dtype([("kind", np.int8), ("id", np.int64), ("at", np.float64, (6,))])
_ITEM_SCHEMA = "kind byte, id long, ax double, ay double, bx double, by double, cx double, cy double"
_ITEM_ARROW = pa.schema([("kind", pa.int8()), ("id", pa.int64()), *((c, pa.float64()) for c in ("ax", "ay", "bx", "by", "cx", "cy"))])


def _to_items(columns: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(columns[0]), _ITEM)
    out["kind"], out["id"] = columns[0], columns[1]
    out["at"] = np.stack([c.astype(float) for c in columns[2:]], 1) if len(out) else np.zeros((0, 6))
    return out


def triangles(regions: DataFrame, region_id: str, geometry: str) -> DataFrame:
    """Triangles of all regions, clipped in parallel; a region whose text is no polygon has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(0, i, *a, *b, *c) for i, wkt in zip(*(c.to_pylist() for c in batch.columns)) for rings in rings_of(wkt) for a, b, c in triangulate(rings)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ITEM_ARROW.types)], schema=_ITEM_ARROW)

    there = regions.select(F.col(region_id).cast("long").alias("id"), F.col(geometry).alias("g")).where(F.col("id").isNotNull() & F.col("g").isNotNull())
    return there.mapInArrow(run, _ITEM_SCHEMA)


def near_and_within(
    points: DataFrame, point_id: str, lat: Column, lon: Column, regions: DataFrame, region_id: str, geometry: str,
    others: DataFrame, other_id: str, other_lat: str, other_lon: str, distance: float = 100.0, broadcast_items: int = BROADCAST_ITEMS, planar: bool = False,
) -> DataFrame:
    """For every point the region that contains it and the other points at most ``distance`` metres away.

    ``point_id, target_kind ("region" | "point"), target_id``. Holes are outside; a point on a border shared by several
    regions belongs to the one of the smallest id. Distances are great-circle and know no edge: discs pass the 180th
    meridian and the poles; regions are planar in longitude and latitude. A region whose rings cross is what lies
    inside of an odd number of them. Points without id or coordinates match nothing; others without
    coordinates are not near anything; repeated rows give one row. Empty tables on either side give no rows for it.
    Other columns are ignored, whatever their names. Ids are integers. With ``planar`` coordinates may be of any size; others
    then must be empty.

    Regions are cut into triangles (ear clipping, in parallel). Their count and that of the others are checked: up to
    ``broadcast_items`` together, a bounding-volume hierarchy over them goes to every executor and the points are not
    moved at all. Beyond that, triangles are kept in a table and the top of a hierarchy divides the plane into tiles, as
    many as the items ask for, from a bounded sample of boxes; every item goes to all tiles that it meets, every point to
    its one tile, and a tile with many points or items is divided further by hashes of both. Candidates are tested exactly.
    """
    pts = points.select(F.col(point_id).cast("long").alias("id"), lat.cast("double").alias("la"), lon.cast("double").alias("lo"))
    far = (1e300, 1e300) if planar else (90, 180)
    pts = pts.where(F.col("id").isNotNull() & F.col("la").between(-far[0], far[0]) & F.col("lo").between(-far[1], far[1]))
    items = triangles(regions, region_id, geometry).unionByName(_discs(others, other_id, other_lat, other_lon, distance))
    found = matches(pts, items, distance, broadcast_items)
    return found.select(F.col("id").alias(point_id), F.when(F.col("kind") == 0, "region").otherwise("point").alias("target_kind"), F.col("target").alias("target_id"))


#: Hierarchies kept by a Python worker for its next tasks, by token.
_KEPT: dict[str, Targets] = {}


def _kept(token: str, items, distance: float) -> Targets:
    if token not in _KEPT:
        while len(_KEPT) > 3:
            _KEPT.pop(next(iter(_KEPT)))
        _KEPT[token] = Targets(items.value, distance)
    return _KEPT[token]


def matches(pts: DataFrame, items: DataFrame, distance: float, broadcast_items: int = BROADCAST_ITEMS, key: tuple[str, ...] = ("id",)) -> DataFrame:
    """``key, kind, target`` for points ``id, la, lo`` and items; ``key`` is ``id``, or ``la, lo`` where places are asked for."""
    keys = "".join(f"{c} {'long' if c == 'id' else 'double'}, " for c in key)
    head = items.limit(broadcast_items + 1).toArrow()
    if head.num_rows <= broadcast_items:
        token, targets = uuid.uuid4().hex, pts.sparkSession.sparkContext.broadcast(_to_items([c.to_numpy() for c in head.columns]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = _kept(token, targets, distance)
            for b in batches:
                p, kinds, ids = known.match(b.column("lo").to_numpy(), b.column("la").to_numpy())
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(p)) for c in key), pa.array(kinds), pa.array(ids)], names=[*key, "kind", "target"])

        found = pts.mapInArrow(run, f"{keys}kind byte, target long")
    else:
        found = _by_tiles(pts, materialize(items, "items"), distance, key, keys)
    # each pair once, and of the regions that hold a point (found in different blocks) the one of the smallest id
    point = F.when(F.col("kind") == 1, F.col("target")).alias("point")
    return found.groupBy(*key, "kind", point).agg(F.min("target").alias("target")).select(*key, "kind", "target")


class Tiles:
    """A division of the plane by median planes: every point lies in one tile, a box meets one or more."""

    def __init__(self, middles: np.ndarray, tiles: int) -> None:
        self.count = 0
        self.root = self._build(middles, max(1, tiles))

    def _build(self, m: np.ndarray, tiles: int):
        if tiles < 2 or len(m) < 2:
            self.count += 1
            return self.count - 1
        axis = int(np.ptp(m[:, 1]) > np.ptp(m[:, 0]))
        plane = float(np.median(m[:, axis]))
        left = m[:, axis] < plane
        if not left.any() or left.all():
            self.count += 1
            return self.count - 1
        return axis, plane, self._build(m[left], tiles // 2), self._build(m[~left], tiles // 2)

    def meet(self, boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, tile, todo = [], [], [(self.root, np.arange(len(boxes)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if isinstance(node, int):
                at.append(rows)
                tile.append(np.full(len(rows), node))
                continue
            axis, plane, left, right = node
            todo += [(left, rows[boxes[rows, axis] < plane]), (right, rows[boxes[rows, axis + 2] >= plane])]
        none = np.zeros(0, np.int64)
        return (np.concatenate(at), np.concatenate(tile)) if at else (none, none)


def _by_tiles(pts: DataFrame, items: DataFrame, distance: float, key: tuple[str, ...], keys: str) -> DataFrame:
    """The way beyond the broadcast bound."""
    n = items.count()
    count = 2 ** math.ceil(math.log2(min(max(n / TILE_ITEMS, TILES[0]), TILES[1])))
    wanted = min(count * SAMPLED_BOXES[0], SAMPLED_BOXES[1])
    sample = items.sample(min(1.0, wanted / max(n, 1)), seed=7).limit(2 * wanted).toArrow()
    known = _to_items([c.to_numpy() for c in sample.columns])
    boxes = item_boxes(known["kind"], known["at"], distance)
    # the planes go out once to each worker
    tiles = pts.sparkSession.sparkContext.broadcast(Tiles((boxes[:, :2] + boxes[:, 2:]) / 2, count))

    def place_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _to_items([c.to_numpy() for c in b.columns])
            rows, tile = tiles.value.meet(item_boxes(x["kind"], x["at"], distance))
            yield pa.RecordBatch.from_arrays([pa.array(tile), *(c.take(pa.array(rows)) for c in b.columns)], names=["tile", *_ITEM_ARROW.names])

    def place_points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b.column(2).to_numpy(), b.column(1).to_numpy()
            rows, tile = tiles.value.meet(np.stack([x, y, x, y], 1))
            yield pa.RecordBatch.from_arrays([pa.array(tile), *(c.take(pa.array(rows)) for c in b.columns)], names=["tile", "id", "la", "lo"])

    placed = pts.select("id", "la", "lo").mapInArrow(place_points, "tile long, id long, la double, lo double")
    laid = items.mapInArrow(place_items, f"tile long, {_ITEM_SCHEMA}")
    # a row per tile: how many parts its points and its items have
    split = lambda df, name, most: df.groupBy("tile").count().select("tile", F.ceil(F.col("count") / most).cast("long").alias(name))
    parts = materialize(split(placed, "parts", TILE_POINTS).join(split(laid, "blocks", TILE_BLOCK), "tile"), "tiles")
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    placed = placed.join(F.broadcast(parts), "tile").withColumn("part", F.pmod(F.xxhash64("id", "la", "lo"), "parts")).withColumn("block", every("blocks"))
    laid = laid.join(F.broadcast(parts), "tile").withColumn("block", F.pmod(F.xxhash64("kind", "id", "ax", "ay", "bx", "by"), "blocks")).withColumn("part", every("parts"))

    def test(left: pa.Table, right: pa.Table) -> pa.Table:
        x = _to_items([right.column(c).to_numpy() for c in _ITEM_ARROW.names])
        p, kinds, ids = Targets(x, distance).match(left.column("lo").to_numpy(), left.column("la").to_numpy())
        return pa.table({**{c: left.column(c).take(pa.array(p)) for c in key}, "kind": pa.array(kinds), "target": pa.array(ids)})

    by = ["tile", "part", "block"]
    return placed.select(*by, "id", "la", "lo").groupBy(*by).cogroup(laid.select(*by, *_ITEM_ARROW.names).groupBy(*by)).applyInArrow(test, T.StructType.fromDDL(f"{keys}kind byte, target long"))
