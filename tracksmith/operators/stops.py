"""Problem 6: stops and trips from location pings."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tracksmith.functions.arrow import changes, whole_groups
from tracksmith.functions.geo import EARTH_RADIUS_M, haversine, haversine_np
from tracksmith.functions.timebins import micros, micros_of
from tracksmith.storage import materialize

#: Metres of a degree of latitude.
DEGREE_M = math.pi / 180 * EARTH_RADIUS_M
#: Pings of a rest from which it is folded, its width as a share of the distance, and the mark of a ping in no rest.
FOLD, FOLD_WIDTH, MOVING = 64, 1 / 3, -(2**63)


def plateau_knots(values: list[float], weight: float, sizes: list[int] | None = None) -> list[int]:
    """Where the total-variation denoised form of ``values`` changes: ascending positions, 0 and the length included.

    Minimising half the squared error plus ``weight`` times the total variation is the same as pulling a string taut
    through the tube of radius ``weight`` around the running sum: the slopes of the string are the denoised values and
    its bends the ends of the plateaus. The string is found with a funnel: from its last fixed bend run the upper
    chain, convex, below the tube's ceiling, and the lower one, concave, above its floor; where one crosses the other,
    the string is fixed along it. A value of size k counts as k equal ones.
    """
    n = len(values)
    at = list(range(n + 1)) if sizes is None else [0, *accumulate(sizes)]
    knots = [0]
    up: list[tuple[int, float]] = [(0, 0.0)]
    lo: list[tuple[int, float]] = [(0, 0.0)]
    hu = hl = 0  # the chains begin at these places of their lists; both then hold the last bend
    total = 0.0
    for i in range(1, n + 1):
        here = at[i]
        total += values[i - 1] * (here - at[i - 1])
        slack = weight if i < n else 0.0
        u, f = total + slack, total - slack
        while len(up) - hu > 1:
            (ai, av), (bi, bv) = up[-2], up[-1]
            if (bv - av) * (here - at[bi]) < (u - bv) * (at[bi] - at[ai]):
                break
            up.pop()
        if len(up) - hu == 1:
            ai, av = up[-1]
            while len(lo) - hl > 1 and (lo[hl + 1][1] - av) * (here - at[ai]) >= (u - av) * (at[lo[hl + 1][0]] - at[ai]):
                hl += 1
                ai, av = lo[hl]
                knots.append(ai)
                up, hu = [(ai, av)], 0
        up.append((i, u))
        while len(lo) - hl > 1:
            (ai, av), (bi, bv) = lo[-2], lo[-1]
            if (bv - av) * (here - at[bi]) > (f - bv) * (at[bi] - at[ai]):
                break
            lo.pop()
        if len(lo) - hl == 1:
            ai, av = lo[-1]
            while len(up) - hu > 1 and (up[hu + 1][1] - av) * (here - at[ai]) <= (f - av) * (at[up[hu + 1][0]] - at[ai]):
                hu += 1
                ai, av = up[hu]
                if ai == i:
                    break
                knots.append(ai)
                lo, hl = [(ai, av)], 0
        lo.append((i, f))
    if knots[-1] != n:
        knots.append(n)
    return knots


class _Spot:
    """Pings within ``reach`` of each other."""

    def __init__(self, lat: list[float], lon: list[float], reach: float, members: list[int]) -> None:
        self.lat, self.lon, self.reach = lat, lon, reach
        self.members = members
        a, o = [lat[m] for m in members], [lon[m] for m in members]
        self.s, self.n, self.w, self.e = min(a), max(a), min(o), max(o)
        self.scale = math.cos(math.radians(a[0])) * DEGREE_M

    def fits(self, j: int) -> bool:
        """Within reach of every member: told from the box around them where that is clear, else from each."""
        la, lo = self.lat[j], self.lon[j]
        dy = max(abs(la - self.s), abs(la - self.n)) * DEGREE_M
        dx = max(abs(lo - self.w), abs(lo - self.e)) * self.scale
        if dy * dy + dx * dx < (0.99 * self.reach) ** 2:
            return True
        ny = max(self.s - la, la - self.n, 0.0) * DEGREE_M
        nx = max(self.w - lo, lo - self.e, 0.0) * self.scale
        if ny * ny + nx * nx > (1.01 * self.reach) ** 2:
            return False
        m = self.members
        return bool((haversine_np(np.array([self.lat[k] for k in m]), np.array([self.lon[k] for k in m]), la, lo) <= self.reach).all())

    def add(self, j: int) -> None:
        self.members.append(j)
        self.s, self.n = min(self.s, self.lat[j]), max(self.n, self.lat[j])
        self.w, self.e = min(self.w, self.lon[j]), max(self.e, self.lon[j])


def plateaus_of(t, x, y, sizes, reach: float, least: int, strays: int, is_quiet, share: float) -> list[list[int]]:
    """Plateaus of the denoised coordinates that last long enough, as lists of places in the sequence.

    A plateau is a stretch on which a denoised coordinate is constant for two or more pings. Stray pings and noise break
    the plateau of one spot into several, so those at one level (means at most half of ``reach`` apart), and single pings
    at that level, with no silence and at most ``strays`` others between them, are one. It must last ``share`` of ``least``.
    """
    n = len(t)
    knots = [plateau_knots(v, reach, sizes) for v in (x, y)]
    flat = bytearray(n)
    for k in knots:
        for a, b in zip(k, k[1:]):
            if b - a > 1 or sizes[a] > 1:
                flat[a:b] = b"\1" * (b - a)
    knots = sorted({*knots[0], *knots[1], *(i for i in range(1, n) if is_quiet[i])})
    parts = list(zip(knots, knots[1:]))
    wx, wy, w = ([0.0, *accumulate(v * k for v, k in zip(c, sizes))] for c in (x, y, [1.0] * n))
    level = [((wx[b] - wx[a]) / (w[b] - w[a]), (wy[b] - wy[a]) / (w[b] - w[a])) for a, b in parts]
    used, out = [False] * len(parts), []
    for seed in sorted(range(len(parts)), key=lambda s: (t[parts[s][0]] - t[parts[s][1] - 1], s)):
        if used[seed] or not flat[parts[seed][0]]:
            continue
        used[seed] = True
        one = [seed]
        for step in (1, -1):
            k, missed = seed + step, 0
            while 0 <= k < len(parts) and not used[k] and not is_quiet[parts[k][0] if step == 1 else parts[k][1]]:
                if (level[k][0] - level[seed][0]) ** 2 + (level[k][1] - level[seed][1]) ** 2 <= (reach / 2) ** 2:
                    one.append(k)
                    used[k], missed = True, 0
                else:
                    missed += int(w[parts[k][1]] - w[parts[k][0]])
                    if missed > strays:
                        break
                k += step
        places = [i for s in sorted(one) for i in range(*parts[s])]
        if t[places[-1]] - t[places[0]] >= least * share:
            out.append(places)
    return out


def stops_of(
    t: list[int], lat: list[float], lon: list[float], reach: float, least: int, silence: int, strays: int, sizes: list[int] | None = None, rests: list[int] | None = None,
    share: float = 0.5,
) -> list[tuple[int, int, list[int]]]:
    """Stops of one sequence in order of time: first and last place, and the members.

    The plateaus of the denoised coordinates become stops, the longest first; nothing else does. The exact rule then
    settles their ends: the pings of a plateau around its middle are the core, which takes in neighbours on both sides
    while they are within ``reach`` of all members, passing over at most ``strays`` others in a row and no silence. What
    a stop leaves of a plateau is a plateau again. A stop must last ``least``.

    ``sizes`` tells for how many pings one stands, ``rests`` to which folded rest it belongs (``MOVING``: none); a rest belongs
    to a stop as a whole or not at all.
    """
    n = len(t)
    sizes, rests = sizes or [1] * n, rests or [MOVING] * n
    scale = math.cos(math.radians(lat[0])) * DEGREE_M
    x, y = [(v - lon[0]) * scale for v in lon], [(v - lat[0]) * DEGREE_M for v in lat]
    is_quiet, taken = bytearray(n + 1), bytearray(n)
    for i in range(1, n):
        is_quiet[i] = t[i] - t[i - 1] > silence
    # a rest's places lie side by side
    spans: dict[int, tuple[int, int]] = {}
    for i, r in enumerate(rests):
        if r != MOVING:
            spans[r] = (spans.get(r, (i,))[0], i + 1)
    long_enough = lambda m: len(m) > 1 and t[m[-1]] - t[m[0]] >= least * share
    waiting = [(t[m[0]] - t[m[-1]], m[0], m) for m in plateaus_of(t, x, y, sizes, reach, least, strays, is_quiet, share)]
    heapq.heapify(waiting)

    def again(parts: list[list[int]]) -> None:
        for m in parts:
            if long_enough(m):
                heapq.heappush(waiting, (t[m[0]] - t[m[-1]], m[0], m))

    def grow(spot: _Spot, j: int, step: int) -> int:
        """Takes in pings from place ``j`` on, and gives the last one."""
        end, missed = j - step, 0
        while 0 <= j < n and not taken[j] and not is_quiet[j if step == 1 else j + 1] and missed <= strays:
            if rests[j] != MOVING:
                a, b = spans[rests[j]]
                if not all(spot.fits(i) for i in range(a, b)):
                    break
                for i in range(a, b):
                    spot.add(i)
                j = b - 1 if step == 1 else a
                end, missed = j, 0
            elif spot.fits(j):
                spot.add(j)
                end, missed = j, 0
            else:
                missed += 1
            j += step
        return end

    found = []
    while waiting:
        _, _, m = heapq.heappop(waiting)
        free = [i for i in m if not taken[i]]
        if len(free) < len(m):
            parts: list[list[int]] = []
            for i in free:
                if parts and taken.find(1, parts[-1][-1], i) < 0:
                    parts[-1].append(i)
                else:
                    parts.append([i])
            again(parts)
            continue
        mx, my = sorted(x[i] for i in m)[len(m) // 2], sorted(y[i] for i in m)[len(m) // 2]
        close = lambda i: (x[i] - mx) ** 2 + (y[i] - my) ** 2 <= (0.49 * reach) ** 2  # noqa: B023, E731
        near = [i for i in m if (close(i) if rests[i] == MOVING else all(map(close, range(*spans[rests[i]]))))] or m[:1]
        # the part that lasts longest without too many others in a row
        parts, run = [], [near[0]]
        for i in near[1:]:
            if i - run[-1] > strays + 1:
                parts.append(run)
                run = []
            run.append(i)
        parts.append(run)
        core = max(parts, key=lambda p: (t[p[-1]] - t[p[0]], -p[0]))
        spot = _Spot(lat, lon, reach, list(core))
        last, first = grow(spot, core[-1] + 1, 1), grow(spot, core[0] - 1, -1)
        if t[last] - t[first] >= least:
            taken[first : last + 1] = b"\1" * (last + 1 - first)
            inside = set(spot.members)
            found.append((first, last, sorted(inside | {i for i in range(first, last + 1) if i not in inside and spot.fits(i)})))
            again([[i for i in m if i < first], [i for i in m if i > last]])
    return sorted(found)


def stops_and_trips(
    df: DataFrame, key: str, time: str, lat: Column, lon: Column, order: str | None = None, distance: float = 300.0, duration: str = "10 min",
    silence: str = "3 hours", strays: int = 2, chunk: str = "1 day",
) -> DataFrame:
    """Stops and trips of each ``key``: ``key, kind, start, end, duration_s, n_pings, lat, lon, distance_m``.

    A ``stop`` is a longest stretch of pings within ``distance`` metres of each other that lasts at least ``duration``;
    up to ``strays`` pings in a row elsewhere do not end it, a silence longer than ``silence`` does. Its ``lat, lon`` are
    the mean of its pings and ``distance_m`` is 0. A ``trip`` runs from the last ping of a stop to the first of the next
    one unless a silence lies between; its ``distance_m`` is the length of the original path. Pings without key, time or
    coordinates are left out; rows equal in key, time and ``order`` (or place, where that is null) are one ping; pings of equal time are taken in
    ``order``. An empty table gives no rows. Other columns are ignored, whatever their names.

    Stops come from total-variation denoising (see ``stops_of``). The table is read and shuffled once, by key and ``chunk`` of
    time. There a rest, i.e. FOLD or more pings in a row in a box of FOLD_WIDTH times ``distance`` that last ``duration``, is
    folded into its first and last ping and the corners of the hull of all of them, which decide who is within reach of
    all; so a device that rests for long leaves few rows of each chunk. A key's pings are then cut where no stop can span:
    at silences, and where the three pings before and after are too far apart for any of them to be neighbours in a stop.
    One cut is taken in each chunk, so the pieces of a key with very many pings go to many tasks. Path lengths and
    silences across pieces are summed from one row per piece.
    """
    kind = df.schema[key].dataType
    least, quiet = micros_of(duration), micros_of(silence)
    size = micros_of(chunk)
    rows = df.select(F.col(key).alias("k"), micros(F.col(time)).alias("t"), (F.col(order) if order else F.lit(0)).cast("long").alias("o"), lat.alias("la"), lon.alias("lo"))
    rows = rows.where(F.col("k").isNotNull() & F.col("t").isNotNull() & F.col("la").between(-90, 90) & F.col("lo").between(-180, 180))
    rows = rows.select("k", F.floor(F.col("t") / size).cast("long").alias("c"), "t", F.coalesce("o", F.xxhash64("la", "lo")).alias("o"), "la", "lo")
    field = T.StructField("k", kind)
    longs, doubles = ("c", "t", "o", "n", "rest", "cut"), ("la", "lo", "sla", "slo")
    schema = T.StructType([field, *(T.StructField(c, T.LongType()) for c in longs), *(T.StructField(c, T.DoubleType()) for c in doubles)])
    arrow = pa.schema([("k", to_arrow_type(kind)), *((c, pa.int64()) for c in longs), *((c, pa.float64()) for c in doubles)])
    chunked = rows.repartition("k", "c").sortWithinPartitions("k", "c", "t", "o", "la", "lo")
    rows = materialize(chunked.mapInArrow(_chunks(arrow, distance, least, quiet, strays, order is None), schema), "pings")
    by_key = Window.partitionBy("k").orderBy("c")
    carried = rows.groupBy("k", "c").agg(F.first("cut").alias("x")).select("k", "c", F.last("x", ignorenulls=True).over(by_key.rowsBetween(Window.unboundedPreceding, -1)).alias("carry"))
    whole = F.lit(-(2**63)).cast("long")
    values = ["t", "o", "la", "lo", "n", "rest", "sla", "slo"]
    pieces = rows.join(carried, ["k", "c"]).select("k", F.when(F.col("t") >= F.col("cut"), F.col("cut")).otherwise(F.coalesce("carry", whole)).alias("u"), *values)
    longs, doubles = ("u", "stop", "t0", "t1", "n", "q0", "q1"), ("la", "lo", "la1", "lo1", "d0", "d1")
    schema = T.StructType([field, *(T.StructField(c, T.LongType()) for c in longs), *(T.StructField(c, T.DoubleType()) for c in doubles)])
    arrow = pa.schema([("k", to_arrow_type(kind)), *((c, pa.int64()) for c in longs), *((c, pa.float64()) for c in doubles)])
    found = pieces.repartition("k", "u").sortWithinPartitions("k", "u", "t", "o", "la", "lo").select("k", "u", *(c for c in values if c != "o")).mapInArrow(_pieces(arrow, distance, least, quiet, strays), schema)
    # one row for the piece (stop = 0) goes before its stops
    order_by = Window.partitionBy("k").orderBy("u", "stop", "t0")
    piece = F.col("stop") == 0
    prev = F.last(F.when(piece, F.struct("t1", "la1", "lo1", "d1", "q1")), ignorenulls=True).over(order_by.rowsBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("prev", F.when(piece, prev))
    far_on = F.col("prev.d1") + haversine(F.col("prev.la1"), F.col("prev.lo1"), F.col("la"), F.col("lo"))
    quiet_on = F.col("prev.q1") + (F.col("t0") - F.col("prev.t1") > quiet).cast("long")
    upto = order_by.rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumns({"dd": F.coalesce(F.sum(far_on).over(upto), F.lit(0.0)), "qq": F.coalesce(F.sum(quiet_on).over(upto), F.lit(0))}).where(~piece)
    following = lambda c: F.lead(c).over(Window.partitionBy("k").orderBy("t0"))
    found = found.select(
        "k", "t0", "t1", "n", "la", "lo", (F.col("dd") + F.col("d1")).alias("out_d"), (F.col("qq") + F.col("q1")).alias("out_q"),
        following("t0").alias("next_t"), (following("dd") + following("d0")).alias("in_d"), (following("qq") + following("q0")).alias("in_q"),
    )
    row = lambda kind, a, b, n, la, lo, d: F.struct(F.lit(kind).alias("kind"), F.timestamp_micros(a).alias("start"), F.timestamp_micros(b).alias("end"), ((b - a) / 1_000_000).alias("duration_s"), n.alias("n_pings"), la.alias("lat"), lo.alias("lon"), d.alias("distance_m"))
    no_n, no_x = F.lit(None).cast("long"), F.lit(None).cast("double")
    both = F.array(
        row("stop", F.col("t0"), F.col("t1"), F.col("n"), F.col("la"), F.col("lo"), F.lit(0.0)),
        F.when(F.col("in_q") == F.col("out_q"), row("trip", F.col("t1"), F.col("next_t"), no_n, no_x, no_x, F.greatest(F.col("in_d") - F.col("out_d"), F.lit(0.0)))),
    )
    return found.select(F.col("k").alias(key), F.explode(F.filter(both, lambda x: x.isNotNull())).alias("x")).select(key, "x.*")


def _hull(x: np.ndarray, y: np.ndarray) -> list[int]:
    """Places of the corners of the convex hull."""
    order = np.lexsort((y, x)).tolist()
    out: list[int] = []
    for way in (order, order[::-1]):
        side: list[int] = []
        for i in way:
            while len(side) > 1 and (x[side[-1]] - x[side[-2]]) * (y[i] - y[side[-2]]) <= (y[side[-1]] - y[side[-2]]) * (x[i] - x[side[-2]]):
                side.pop()
            side.append(i)
        out += side
    return sorted(set(out))


def _rests(t: np.ndarray, lat: np.ndarray, lon: np.ndarray, width: float, least: int, silence: int) -> list[tuple[int, int]]:
    """Spans of FOLD or more pings in a row in a box of ``width`` metres across, which last ``least`` without a silence."""
    scale = math.cos(math.radians(float(lat[0]))) * DEGREE_M
    xs, ys, ts = (lon * scale).tolist(), (lat * DEGREE_M).tolist(), t.tolist()
    out, start, n = [], 0, len(ts)
    x0 = x1 = xs[0]
    y0 = y1 = ys[0]
    for i in range(1, n + 1):
        if i < n:
            a, b, c, d = min(x0, xs[i]), max(x1, xs[i]), min(y0, ys[i]), max(y1, ys[i])
            if (b - a) ** 2 + (d - c) ** 2 <= width * width and ts[i] - ts[i - 1] <= silence:
                x0, x1, y0, y1 = a, b, c, d
                continue
        if i - start >= FOLD and ts[i - 1] - ts[start] >= least:
            out.append((start, i))
        if i < n:
            start = i
            x0 = x1 = xs[i]
            y0 = y1 = ys[i]
    return out


def _chunks(arrow: pa.Schema, distance: float, least: int, quiet: int, strays: int, by_place: bool):
    """Rows sorted by key, chunk and time: repeated ones dropped, rests folded, and the time of a cut where there is one."""
    reach = strays + 1

    def of(table: pa.Table) -> pa.RecordBatch:
        k = table.column(0).combine_chunks()
        c, t, o, la, lo = (table.column(i).to_numpy() for i in range(1, 6))
        new = changes(table.columns[:2])
        same = ~new
        for v in (t, o, *((la, lo) if by_place else ())):
            same[1:] &= v[1:] == v[:-1]
        kept = np.nonzero(~same)[0]
        c, t, o, la, lo, new = c[kept], t[kept], o[kept], la[kept], lo[kept], new[kept]
        n = len(kept)
        starts = np.nonzero(new)[0]
        ends = np.append(starts[1:], n)
        group = np.cumsum(new) - 1
        cut = np.zeros(n, bool)
        cut[1:] = (t[1:] - t[:-1] > quiet) & ~new[1:]
        at = np.arange(n)
        whole = (at - reach >= starts[group]) & (at + reach <= ends[group])
        at = at[whole]
        for a in range(1, reach + 1):
            for b in range(reach - a + 1):
                if len(at):
                    at = at[haversine_np(la[at - a], lo[at - a], la[at + b], lo[at + b]) > distance]
        cut[at] = True
        cut[1:] &= t[1:] != t[:-1]
        none = np.iinfo(np.int64).max
        first = np.minimum.reduceat(np.where(cut, t, none), starts)[group] if n else np.zeros(0, np.int64)
        size, rest, sla, slo, left = np.ones(n, np.int64), np.full(n, MOVING, np.int64), la.copy(), lo.copy(), np.ones(n, bool)
        for s, e in zip(starts[ends - starts >= FOLD], ends[ends - starts >= FOLD]):
            for a, b in _rests(t[s:e], la[s:e], lo[s:e], distance * FOLD_WIDTH, least, quiet):
                a, b = a + s, b + s
                corners = np.array(sorted({0, b - a - 1, *_hull(lo[a:b], la[a:b])})) + a
                left[a:b] = False
                left[corners] = True
                rest[a:b] = t[a]
                others = corners[1:]
                size[a], sla[a], slo[a] = b - a - len(others), la[a:b].sum() - la[others].sum(), lo[a:b].sum() - lo[others].sum()
        at = np.nonzero(left)[0]
        values = [k.take(pa.array(kept[at])), c[at], t[at], o[at], size[at], rest[at], pa.array(first[at], mask=first[at] == none), la[at], lo[at], sla[at], slo[at]]
        return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, ty) for v, ty in zip(values, arrow.types)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return map(of, whole_groups(batches, 2))

    return run


def _pieces(arrow: pa.Schema, distance: float, least: int, quiet: int, strays: int):
    """Rows sorted by key, piece and time: a row for each piece, then one for each of its stops."""

    def rows_of(k, u, t, la, lo, n, rest, sla, slo) -> list[tuple]:
        way = np.concatenate([[0.0], np.cumsum(haversine_np(la[:-1], lo[:-1], la[1:], lo[1:]))])
        silences = np.concatenate([[0], np.cumsum(np.diff(t) > quiet)])
        out = [(k, u, 0, int(t[0]), int(t[-1]), int(n.sum()), 0, int(silences[-1]), la[0], lo[0], la[-1], lo[-1], 0.0, float(way[-1]))]
        for i, j, members in stops_of(t.tolist(), la.tolist(), lo.tolist(), distance, least, quiet, strays, n.tolist(), rest.tolist()):
            count = int(n[members].sum())
            y, x = float(sla[members].sum() / count), float(slo[members].sum() / count)
            out.append((k, u, 1, int(t[i]), int(t[j]), count, int(silences[i]), int(silences[j]), y, x, y, x, float(way[i]), float(way[j])))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, 2):
            starts = np.append(np.nonzero(changes(table.columns[:2]))[0], table.num_rows)
            k, u = (table.column(i).take(pa.array(starts[:-1])).to_pylist() for i in (0, 1))
            values = [table.column(i).to_numpy() for i in range(2, table.num_columns)]
            done = [row for i, (a, b) in enumerate(zip(starts, starts[1:])) for row in rows_of(k[i], u[i], *(v[a:b] for v in values))]
            yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(zip(*done), arrow.types)], schema=arrow)

    return run
