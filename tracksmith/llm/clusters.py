"""Problem 5: records grouped into clusters of mutually similar ones."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracksmith.functions.geo import EARTH_RADIUS_M, STUDY_AREA, haversine
from tracksmith.storage import materialize, release

DEGREE_M = math.pi / 180 * EARTH_RADIUS_M
#: Parts of a cell's side at the last step but the points themselves.
FINEST = 256
#: Random permutations of the MinHash, and how often a code counts in a set.
BANDS, CODE_WEIGHT = 16, 3


def connected_components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """The least node that each node is linked to through others: ``node, component`` (integers).

    ``nodes`` has ``node``; ``edges`` has ``a, b`` in either direction; a node without edge is its own component.
    Star contraction: in turns every node hands its larger and its smaller neighbours to the least of them, until
    nothing changes, which takes about the logarithm of the longest path. All of it stays in tables; a number to tell
    whether something changed is all that comes to the driver.
    """
    links = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where(F.col("u") != F.col("v")).distinct(), "links")
    # u > v throughout
    mark = None
    for _ in range(max_rounds):
        both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        before, links = links, materialize(small.where(F.col("u") != F.col("v")).distinct(), "links")
        release(before)
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components not found in {max_rounds} rounds")
    return nodes.select("node").join(links.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node"), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


class Cells:
    """A grid of cells so small that any two points of one are within ``reach`` metres of each other."""

    def __init__(self, reach: float, area: tuple[float, float, float, float]) -> None:
        self.area, self.reach = area, reach
        side = reach / math.sqrt(2) * 0.99
        near, far = min(abs(area[0]), abs(area[1])) if area[0] * area[1] > 0 else 0.0, max(abs(area[0]), abs(area[1]))
        self.dy = side / DEGREE_M
        self.dx = side / (DEGREE_M * math.cos(math.radians(near)))
        narrow = self.dx * DEGREE_M * math.cos(math.radians(far))
        #: Points within reach lie at most so many cells apart on either axis.
        self.span = max(math.ceil(reach / side), math.ceil(reach / narrow))

    def _place(self, offset: Column, size: float, parts: int) -> Column:
        # always from the finest parts, so that a point on an edge lies in one cell at every size
        return F.floor(F.floor(offset / (size / FINEST)) / (FINEST // parts)).cast("long")

    def x(self, lon: Column, parts: int = 1) -> Column:
        return self._place(lon - self.area[2], self.dx, parts)

    def y(self, lat: Column, parts: int = 1) -> Column:
        return self._place(lat - self.area[0], self.dy, parts)

    def apart(self, ax: Column, ay: Column, bx: Column, by: Column, parts: int) -> Column:
        """No two points of two cells are nearer than this (metres; a little less to be safe)."""
        gx, gy = F.greatest(F.abs(ax - bx) - 1, F.lit(0)), F.greatest(F.abs(ay - by) - 1, F.lit(0))
        narrow = self.dx * DEGREE_M * math.cos(math.radians(max(abs(self.area[0]), abs(self.area[1]))))
        return F.hypot(gx * F.lit(narrow / parts), gy * F.lit(self.dy * DEGREE_M / parts)) * 0.999


def _mix(v: np.ndarray) -> np.ndarray:
    """Scatters 64-bit numbers; a bijection."""
    with np.errstate(over="ignore"):
        v = v ^ (v >> np.uint64(33))
        v = v * np.uint64(0xFF51AFD7ED558CCD)
        v = v ^ (v >> np.uint64(33))
        v = v * np.uint64(0xC4CEB9FE1A85EC53)
        return v ^ (v >> np.uint64(33))


def tokens_of(x: np.ndarray, y: np.ndarray, code: list[str | None], span: int) -> np.ndarray:
    """The sets of cells, a row each: the cells up to ``span`` around, and CODE_WEIGHT times the code in its neighbourhood.

    A code counts only within a square of as many cells as a set has, so that a code that is written everywhere brings
    no more cells together than a token of a place. A cell without code has tokens of its own instead.
    """
    side = 2 * span + 1
    cell = lambda a, b: _mix(_mix(a.astype(np.int64).view(np.uint64)) ^ b.astype(np.int64).view(np.uint64))
    d = np.arange(-span, span + 1)
    around = cell(x[:, None] + np.repeat(d, side), y[:, None] + np.tile(d, side))
    named = np.array([xxhash.xxh64_intdigest(c) if c is not None else 0 for c in code], np.uint64)
    there = np.array([c is not None for c in code], bool)
    named = np.where(there, _mix(named ^ cell(x // side, y // side)), ~cell(x, y))
    return np.concatenate([around, _mix(named[:, None] ^ _mix(np.arange(1, CODE_WEIGHT + 1).astype(np.uint64) << np.uint64(56)))], 1)


def _bands(span: int, drawn: int, chosen: bool):
    """For every cell its key in each band: what its set has least in that band's permutation."""
    schema = pa.schema([("band", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64()), ("x", pa.int64()), ("y", pa.int64())])
    side = 2 * span + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            tokens = tokens_of(x, y, batch.column(2).to_pylist(), span)
            keys = [(b, _mix(tokens ^ _mix(np.array([b + 1], np.uint64))).min(1).view(np.int64), np.zeros(len(x), np.int64)) for b in range(drawn)]
            first = lambda c, r: c - span + (r - (c - span)) % side
            if chosen:
                keys += [(drawn + i, first(x, rx), first(y, ry)) for i, (rx, ry) in enumerate([(0, 0), (0, span), (span, 0), (span, span)])]
            for b, k1, k2 in keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), b, np.int32)), pa.array(k1), pa.array(k2), batch.column(0), batch.column(1)], schema=schema)

    return run


def candidate_cells(cells: DataFrame, span: int, drawn: int = BANDS, chosen: bool = True) -> DataFrame:
    """Pairs of occupied cells (``x, y, code``) that may hold linked points: ``ax, ay, bx, by``.

    The set of a cell carries its place and its code (see ``tokens_of``). MinHash with ``drawn`` random permutations, one to
    a band, finds nearly all pairs. As no link may be missed, four ``chosen`` permutations complete them: each ranks first
    the cells of one residue class modulo the side of a set, so the least cell of a set is the only one of that class in
    it. Two sets of cells at most ``span`` apart share at least ``span + 1`` rows and columns, and the residues 0 and
    ``span`` are never both outside those, so such cells agree in at least one of the four. A bucket of any band holds at
    most as many cells as a set. The exact Jaccard similarity of the places of candidates is verified.
    """
    side = 2 * span + 1
    keyed = cells.select(F.col("x"), F.col("y"), F.col("code")).mapInArrow(_bands(span, drawn, chosen), "band int, k1 long, k2 long, x long, y long")
    buckets = keyed.groupBy("band", "k1", "k2").agg(F.collect_list(F.struct("x", "y")).alias("all")).where(F.size("all") > 1)
    pairs = buckets.select(F.explode("all").alias("a"), "all").select("a", F.explode("all").alias("b")).where(F.col("a") < F.col("b"))
    pairs = pairs.select(F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("b.x").alias("bx"), F.col("b.y").alias("by"))
    over = lambda a, b: F.greatest(F.lit(side) - F.abs(a - b), F.lit(0))
    shared = over(F.col("ax"), F.col("bx")) * over(F.col("ay"), F.col("by"))
    least = (span + 1) ** 2
    return pairs.where(shared * F.lit(2 * side * side - least) >= F.lit(least) * (F.lit(2 * side * side) - shared)).distinct()


def linked_cells(points: DataFrame, cells: Cells, occupied: DataFrame) -> DataFrame:
    """Pairs of different cells with two points at most ``reach`` apart: ``ax, ay, bx, by``; exact.

    ``points`` has ``lat, lon``, ``occupied`` their cells ``x, y, code``. Candidates are decided from coarse to fine: in each part of a cell one point stands as a
    witness. Two witnesses within reach link the cells; parts too far apart for any point of theirs drop out; cells with
    neither go on with finer parts of the parts still open, and at last with the points of those, which are a
    1/FINEST of a cell wide (0.3 m for a reach of 100 m). So of a cell with very many points only few are looked at, and
    the points of a cell never meet those of another one all at once.
    """
    points = materialize(points.select("lat", "lon").distinct(), "points")
    cell = lambda parts: (cells.x(F.col("lon"), parts), cells.y(F.col("lat"), parts))
    key = ["ax", "ay", "bx", "by"]
    open_parts = candidate_cells(occupied, cells.span).where(cells.apart(*map(F.col, key), 1) <= cells.reach)
    # the parts still open: the pair of cells and the pair of parts, which at first are the cells themselves
    open_parts = open_parts.select(*key, *(F.col(c).alias(f"p{c}") for c in key))
    linked, coarse = [], 1
    for parts in (4, 16, FINEST):
        finer = parts // coarse
        seen = points.groupBy(cell(parts)[0].alias("x"), cell(parts)[1].alias("y")).agg(F.min(F.struct("lat", "lon")).alias("w"))
        side = lambda s: seen.select(F.floor(F.col("x") / finer).cast("long").alias(f"p{s}x"), F.floor(F.col("y") / finer).cast("long").alias(f"p{s}y"), F.col("x").alias(f"q{s}x"), F.col("y").alias(f"q{s}y"), F.col("w").alias(f"{s}w"))  # noqa: B023, E731
        both = open_parts.join(side("a"), ["pax", "pay"]).join(side("b"), ["pbx", "pby"]).where(cells.apart(F.col("qax"), F.col("qay"), F.col("qbx"), F.col("qby"), parts) <= cells.reach)
        near = haversine(F.col("aw.lat"), F.col("aw.lon"), F.col("bw.lat"), F.col("bw.lon")) <= cells.reach
        both = both.select(*key, *(F.col(f"q{c}").alias(f"p{c}") for c in key), near.alias("near"))
        if parts == 4:
            # most pairs of parts are made here and nearly all cells decided, by the map side's maximum
            decided = materialize(both.groupBy(*key).agg(F.max("near").alias("near")), "decided")
            linked.append(decided.where("near").select(*key))
            open_parts = decided.where(~F.col("near")).select(*key, *(F.col(c).alias(f"p{c}") for c in key))
            continue
        # a pair of cells that is linked is said once; of the others all parts go on
        by_cells = Window.partitionBy(*key)
        both = both.withColumns({"found": F.max("near").over(by_cells), "r": F.row_number().over(by_cells.orderBy(F.desc("near")))})
        kept = materialize(both.where(~F.col("found") | (F.col("r") == 1)).drop("near", "r"), "open")
        linked.append(kept.where("found").select(*key))
        open_parts = kept.where(~F.col("found")).drop("found")
        coarse = parts
    mine = lambda s: points.select(cell(FINEST)[0].alias(f"p{s}x"), cell(FINEST)[1].alias(f"p{s}y"), F.col("lat").alias(f"{s}la"), F.col("lon").alias(f"{s}lo"))
    last = open_parts.join(mine("a"), ["pax", "pay"]).join(mine("b"), ["pbx", "pby"]).where(haversine(F.col("ala"), F.col("alo"), F.col("bla"), F.col("blo")) <= cells.reach)
    return reduce(DataFrame.unionByName, [*linked, last.select(*key).distinct()])


def clean_code(code: Column) -> Column:
    """A place code without case, prefix (``name:``), blanks and dots; null if nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(code), r"^\s*[a-z_]+\s*:", ""), r"[\s. …]+", "")
    return F.when(F.length(bare) > 0, bare)


def full_codes(codes: DataFrame, least: int = 12) -> DataFrame:
    """What each code stands for: ``code, full``.

    ``codes`` has ``code, n``, one row per code. A code of ``least`` or more characters stands for the longer one that
    begins with it and is itself the beginning of no other; if there are several, for the most frequent, then the least.
    """
    start = F.substring("code", 1, least)
    known = codes.where(F.length("code") >= least).select("code", "n", start.alias("head"))
    longer = known.select(F.col("code").alias("full"), F.col("n").alias("full_n"), "head")
    pairs = known.select("code", "head").join(longer, "head").where((F.length("full") > F.length("code")) & F.startswith("full", "code"))
    pairs = pairs.join(pairs.select(F.col("code").alias("full")).distinct(), "full", "left_anti")
    best = pairs.groupBy("code").agg(F.min(F.struct((-F.col("full_n")).alias("n"), "full")).alias("b"))
    return codes.select("code").join(best, "code", "left").select("code", F.coalesce("b.full", "code").alias("full"))


def similarity_clusters(
    df: DataFrame, record_id: str, lat: Column, lon: Column, code: Column, reach: float = 100.0, least: int = 3,
    area: tuple[float, float, float, float] = STUDY_AREA, split: bool = True,
) -> dict[str, DataFrame]:
    """Clusters of records of one place: tables ``members`` and, with ``split``, ``cells``.

    Records with coordinates at most ``reach`` metres apart are in one cluster, and so are records joined through
    others; clusters of fewer than ``least`` such records do not count. A record without coordinates but with a code
    belongs to the cluster whose records carry that code most often (a tie: the smaller cluster id); see ``clean_code``
    and ``full_codes`` for how codes are compared. ``members``: ``record_id, cluster_id, has_position``; ``cluster_id`` is the
    smallest id of the cluster's records with coordinates. Rows of equal id are one record, rows without id are left
    out; an empty table gives no rows. Coordinates must lie in ``area`` (latitude from, to, longitude from, to), not
    across the 180th meridian. Other columns are ignored, whatever their names.

    ``cells`` describes clusters: ``x, y, cluster_id, n, record, part, attached``: the occupied grid cells (any two records
    of a cell are within reach), how many records, the smallest id, and the part of the cluster that a cell falls into when
    loose clusters are split around the cells of the highest degree. ``attached``, at the cell that names a part, counts the
    records without coordinates: each goes to the part of its cluster that carries its code most often (a tie: the smaller).

    Links are found between cells, not records: banded MinHash over the cells' surroundings and codes for candidates,
    exact Jaccard similarity and exact distances to verify them, star contraction for the components. A cell with a third of
    all records is one node.
    """
    grid = Cells(reach, area)
    la0, la1, lo0, lo1 = area
    rows = df.select(F.col(record_id).cast("long").alias("id"), lat.cast("double").alias("lat"), lon.cast("double").alias("lon"), clean_code(code).alias("code")).where(F.col("id").isNotNull())
    rows = rows.withColumn("there", F.coalesce(F.col("lat").between(la0, la1) & F.col("lon").between(lo0, lo1), F.lit(False))).where(F.col("there") | F.col("code").isNotNull())
    rows = rows.select("id", "there", F.when(F.col("there"), F.col("lat")).alias("lat"), F.when(F.col("there"), F.col("lon")).alias("lon"), "code").dropDuplicates(["id"])
    rows = materialize(rows.select("id", "there", "lat", "lon", "code", grid.x(F.col("lon")).alias("x"), grid.y(F.col("lat")).alias("y")), "records")
    placed = rows.where("there")
    cells = materialize(placed.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("record"), F.min("code").alias("code")), "cells")
    pairs = materialize(linked_cells(placed, grid, cells), "pairs")
    # a cell's node is its smallest record id, so a component's name is that of the cluster
    node = lambda side: cells.select(F.col("x").alias(f"{side}x"), F.col("y").alias(f"{side}y"), F.col("record").alias(side))
    edges = materialize(pairs.join(node("a"), ["ax", "ay"]).join(node("b"), ["bx", "by"]).select("a", "b"), "edges")
    labels = connected_components(cells.select(F.col("record").alias("node")), edges).select(F.col("node").alias("record"), F.col("component").alias("cluster_id"))
    labelled = cells.drop("code").join(labels, "record")
    sizes = labelled.groupBy("cluster_id").agg(F.sum("n").alias("size")).where(F.col("size") >= least)
    labelled = materialize(labelled.join(sizes.select("cluster_id"), "cluster_id", "left_semi"), "labelled")
    members = placed.join(labelled.select("x", "y", "cluster_id"), ["x", "y"]).select("id", "cluster_id", "code")
    full = full_codes(rows.where(F.col("code").isNotNull()).groupBy("code").agg(F.count(F.lit(1)).alias("n")))
    carried = members.where(F.col("code").isNotNull()).groupBy("code", "cluster_id").agg(F.count(F.lit(1)).alias("n")).join(full, "code")
    carried = carried.groupBy("full", "cluster_id").agg(F.sum("n").alias("n"))
    home = carried.groupBy("full").agg(F.min(F.struct((-F.col("n")).alias("n"), "cluster_id")).alias("h")).select("full", F.col("h.cluster_id").alias("cluster_id"))
    homes = full.join(home, "full").select("code", "cluster_id")
    attached = rows.where(~F.col("there")).select("id", "code").join(homes, "code").select("id", "cluster_id", F.lit(False).alias("has_position"))
    members = members.select("id", "cluster_id", F.lit(True).alias("has_position")).unionByName(attached).withColumnRenamed("id", record_id)
    if not split:
        return {"members": members}
    cells = labelled.join(_parts(labelled.select("record", "n"), edges), "record")
    by_part = placed.where(F.col("code").isNotNull()).join(cells.select("x", "y", "cluster_id", "part"), ["x", "y"]).groupBy("code", "cluster_id", "part").agg(F.count(F.lit(1)).alias("n"))
    by_part = by_part.join(full, "code").groupBy("full", "cluster_id", "part").agg(F.sum("n").alias("n"))
    part_of = by_part.join(home, ["full", "cluster_id"]).groupBy("full").agg(F.min(F.struct((-F.col("n")).alias("n"), "part")).alias("p")).select("full", F.col("p.part").alias("record"))
    unplaced = rows.where(~F.col("there")).groupBy("code").agg(F.count(F.lit(1)).alias("n")).join(full, "code").join(part_of, "full")
    cells = cells.join(unplaced.groupBy("record").agg(F.sum("n").alias("attached")), "record", "left")
    return {"members": members, "cells": cells.withColumn("attached", F.coalesce("attached", F.lit(0)))}


def _parts(nodes: DataFrame, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Every node goes to the best of its neighbours and itself, by degree, records and then least id, and on from there."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = nodes.join(both.groupBy("a").count().withColumnRenamed("a", "record"), "record", "left").select("record", F.struct(F.coalesce("count", F.lit(0)).alias("d"), "n", (-F.col("record")).alias("r")).alias("rank"))
    best = both.join(degree.select(F.col("record").alias("b"), "rank"), "b").groupBy("a").agg(F.max("rank").alias("best")).withColumnRenamed("a", "record")
    to = degree.join(best, "record", "left").select("record", F.when(F.col("best") > F.col("rank"), -F.col("best.r")).otherwise(F.col("record")).alias("part"))
    to = materialize(to, "parts")
    for _ in range(max_rounds):
        on = to.join(to.select(F.col("record").alias("part"), F.col("part").alias("next")), "part")
        on = materialize(on.select("record", F.col("next").alias("part"), (F.col("next") != F.col("part")).alias("moved")), "parts")
        if not on.where("moved").limit(1).count():
            break
        to = on.select("record", "part")
    return to.select("record", "part")


def describe_clusters(cells: DataFrame) -> DataFrame:
    """Size and most typical member of each part of a cluster: ``cluster_id, medoid, n_records, n_cells``.

    ``n_records`` counts all members: those with coordinates in the part, and those without that are attached to it by
    their code. One typical member is listed for each part: the medoid, the smallest record id of the cell with the most
    linked cells around it (on a tie, with the most records, then the smallest id). Other typical members are not listed.
    """
    return cells.groupBy("cluster_id", F.col("part").alias("medoid")).agg(F.sum(F.col("n") + F.col("attached")).alias("n_records"), F.count(F.lit(1)).alias("n_cells"))
