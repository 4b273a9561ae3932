"""The mobility model (MM1-MM16, MM18): significant places, daily rhythm, densities, agents, and simulated movement."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracksmith.functions.geo import planar
from tracksmith.functions.timebins import micros
from tracksmith.operators.density import density_labels
from tracksmith.operators.prediction import uniform
from tracksmith.operators.spatial import box_wkt, create_grid, filter_layer, in_annulus, locate
from tracksmith.operators.spatial_join import rings_of
from tracksmith.operators.statistics import with_bins
from tracksmith.storage import materialize

HOUR = 3_600_000_000


def rank_freq(df: DataFrame, quantity: int = 2) -> DataFrame:
    """MM1: each user's ``quantity`` most frequent places: ``user_id, rank, labels, lon, lat, n``; a tie goes to the smaller label."""
    there = df.where(F.col("labels").isNotNull() & F.col("lon").isNotNull() & F.col("lat").isNotNull())
    counts = there.groupBy("user_id", "labels", "lon", "lat").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "labels", "lon", "lat")) - 1
    return counts.select("user_id", rank.alias("rank"), "labels", "lon", "lat", "n").where(F.col("rank") < quantity)


def significant_places(ranked: DataFrame, quantity: int = 2) -> DataFrame:
    """MM1, pivoted: one row per user with ``lon_<rank>, lat_<rank>``."""
    return ranked.groupBy("user_id").agg(*(F.max(F.when(F.col("rank") == r, F.col(c))).alias(f"{c}_{r}") for r in range(quantity) for c in ("lon", "lat")))


def commute_distances(ranked: DataFrame) -> DataFrame:
    """MM3: distances between a user's significant places: ``user_id, rank_a, rank_b, distance`` with rank_a < rank_b."""
    a = ranked.select("user_id", F.col("rank").alias("rank_a"), F.col("lon").alias("xa"), F.col("lat").alias("ya"))
    b = ranked.select("user_id", F.col("rank").alias("rank_b"), F.col("lon").alias("xb"), F.col("lat").alias("yb"))
    both = a.join(b, "user_id").where(F.col("rank_a") < F.col("rank_b"))
    return both.select("user_id", "rank_a", "rank_b", planar(F.col("xa"), F.col("ya"), F.col("xb"), F.col("yb")).alias("distance"))


def commute_distances_to_2d_distribution(ranked: DataFrame, layer: DataFrame) -> DataFrame:
    """MM4: median distance from home (rank 0) to work (rank 1) of those who live in a cell: ``cell_id, cx, cy, value``; 0 without any."""
    homes = ranked.where("rank = 0").select("user_id", "lon", "lat")
    far = commute_distances(ranked).where("rank_a = 0 and rank_b = 1").select("user_id", "distance")
    cells = homes.join(far, "user_id").join(locate(homes, layer), ["lon", "lat"]).groupBy("cell_id").agg(F.median("distance").alias("m"))
    return layer.select("cell_id", "cx", "cy").join(cells, "cell_id", "left").select("cell_id", "cx", "cy", F.coalesce("m", F.lit(0.0)).alias("value"))


def convert_to_2d_distribution(ranked: DataFrame, layer: DataFrame, rank: int = 0) -> DataFrame:
    """MM2, MM5: share of the users whose place of that rank lies in a cell: ``cell_id, cx, cy, value``."""
    places = ranked.where(F.col("rank") == rank).select("lon", "lat")
    cells = places.join(locate(places, layer), ["lon", "lat"]).groupBy("cell_id").agg(F.count(F.lit(1)).alias("n"))
    total = cells.agg(F.sum("n")).scalar()
    return layer.select("cell_id", "cx", "cy").join(cells, "cell_id", "left").select("cell_id", "cx", "cy", F.coalesce(F.col("n") / total, F.lit(0.0)).alias("value"))


def _draws(cells: pd.DataFrame, amount: int, rng: np.random.Generator) -> list[int]:
    """Cells drawn by weight; a drawn one loses 1/amount."""
    weight, out = cells["value"].to_numpy(float).clip(0).copy(), []
    for _ in range(amount):
        if weight.sum() <= 0:
            break
        k = int(rng.choice(len(weight), p=weight / weight.sum()))
        weight[k] = max(weight[k] - 1 / amount, 0.0)
        out.append(k)
    return out


def generate_points_from_distribution(dist: DataFrame, amount: int | Column, seed: int = 0) -> DataFrame:
    """MM6: ``amount`` cells drawn by weight with depletion: ``cluster, agent_id, cell_id, lon, lat``.

    With a column ``cluster`` each cluster has its own draws, and ``amount`` may be a column. Every draw depends on those
    before it, so the cells of the layer, which are few, go through one task per cluster. Agents are numbered from
    ``cluster`` times 10^9.
    """
    rows = dist.select(F.col("cluster") if "cluster" in dist.columns else F.lit(0).alias("cluster"), "cell_id", "cx", "cy", "value", (F.lit(amount) if isinstance(amount, int) else amount).cast("int").alias("amount"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cell_id")
        cluster = int(pdf["cluster"].iloc[0])
        at = _draws(pdf, int(pdf["amount"].iloc[0]), np.random.default_rng([seed, cluster]))
        cells, x, y = (pdf[c].to_numpy()[at] for c in ("cell_id", "cx", "cy"))
        return pd.DataFrame({"cluster": cluster, "agent_id": cluster * 10**9 + np.arange(len(at)), "cell_id": cells, "lon": x, "lat": y})

    return rows.groupBy("cluster").applyInPandas(run, "cluster int, agent_id long, cell_id long, lon double, lat double")


def select_points_with_commuting(homes: DataFrame, works: DataFrame, commuting: DataFrame, spread: float | None = 0.05, seed: int = 0) -> DataFrame:
    """MM7: for every home a work cell about the median commute of its cell away: ``cluster, agent_id, cell_id, lon, lat``; null if there is none.

    ``homes`` as from MM6; ``works`` and ``commuting`` may have a column ``cluster``. Drawn by weight; a drawn cell loses
    1/number of homes, so homes are served in order, in one task per cluster.
    """
    own = lambda df: F.col("cluster") if "cluster" in df.columns else F.lit(0).alias("cluster")
    around = commuting.select(own(commuting), F.col("cell_id").alias("home"), F.col("value").alias("around"))
    asked = homes.select("cluster", "agent_id", F.col("cell_id").alias("home"), F.col("lon").alias("hx"), F.col("lat").alias("hy")).join(around, ["cluster", "home"], "left")
    target = works.where("value > 0").select(own(works), "cell_id", "cx", "cy", "value")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({"cluster": [], "agent_id": [], "cell_id": [], "lon": [], "lat": []})
        cluster = int(left["cluster"].iloc[0])
        rng, right = np.random.default_rng([seed, cluster]), right.sort_values("cell_id")
        x, y, weight = (right[c].to_numpy(float) for c in ("cx", "cy", "value"))
        weight, out = weight.copy(), []
        for agent, hx, hy, d in left.sort_values("agent_id")[["agent_id", "hx", "hy", "around"]].itertuples(index=False):
            far = np.hypot(x - hx, y - hy)
            near = far <= 1.01 * d if spread is None else (far >= d * (1 - spread)) & (far <= d * (1 + spread))
            w = np.where(near, weight, 0.0)
            if not w.sum() > 0:
                out.append((cluster, agent, None, None, None))
                continue
            k = int(rng.choice(len(w), p=w / w.sum()))
            weight[k] = max(weight[k] - 1 / len(left), 0.0)
            out.append((cluster, agent, int(right["cell_id"].iloc[k]), x[k], y[k]))
        return pd.DataFrame(out, columns=["cluster", "agent_id", "cell_id", "lon", "lat"]).astype({"cell_id": "Int64"})

    left, right = (df.select(*(F.col(c).alias(c) for c in df.columns)) for df in (asked, target))
    return left.groupBy("cluster").cogroup(right.groupBy("cluster")).applyInPandas(run, "cluster int, agent_id long, cell_id long, lon double, lat double")


def _within_reach(asked: DataFrame, x: str, y: str, reach: Column, cells: DataFrame) -> DataFrame:
    """Rows of ``asked`` with the cells (``cell_id, cx, cy``) that may lie within ``reach`` of (x, y): an equi-join over squares.

    The squares of a row have the side 2^k that its reach just fits in, so 3 x 3 of them hold what is within reach.
    """
    sized = asked.where(reach.isNotNull()).withColumn("_k", F.ceil(F.log2(F.greatest(reach, F.lit(1e-9)))).cast("int"))
    sizes = [r[0] for r in sized.select("_k").distinct().collect()]  # one per power of two
    square = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("_k"))).cast("long")
    around = F.explode(F.array(*(F.struct((square(x) + a).alias("i"), (square(y) + b).alias("j")) for a in (-1, 0, 1) for b in (-1, 0, 1))))
    sizes_array = F.array(*map(F.lit, sizes)) if sizes else F.array().cast("array<int>")
    laid = cells.select("cell_id", "cx", "cy", F.explode(sizes_array).alias("_k")).withColumns({"_i": square("cx"), "_j": square("cy")})
    return sized.withColumn("_s", around).withColumns({"_i": F.col("_s.i"), "_j": F.col("_s.j")}).join(laid, ["_k", "_i", "_j"]).drop("_k", "_i", "_j", "_s")


def commuting_candidates(homes: DataFrame, works: DataFrame, commuting: DataFrame, spread: float | None = 0.05) -> DataFrame:
    """MM7 without the draw: the weighted cells that each home could commute to: ``agent_id, work_id``.

    ``homes`` has ``agent_id, cell_id, lon, lat``; ``works`` and ``commuting`` have ``cell_id, value``.
    """
    around = commuting.select(F.col("cell_id").alias("home"), F.col("value").alias("around"))
    asked = homes.select("agent_id", F.col("cell_id").alias("home"), F.col("lon").alias("hx"), F.col("lat").alias("hy")).join(around, "home")
    reach = F.col("around") * (1.01 if spread is None else 1 + spread)
    near = _within_reach(asked, "hx", "hy", reach, works.where("value > 0"))
    return near.where(in_annulus(planar(F.col("hx"), F.col("hy"), F.col("cx"), F.col("cy")), F.col("around"), spread)).select("agent_id", F.col("cell_id").alias("work_id"))


def sides_of(wkt: Column) -> Column:
    """Sides of all rings of a WKT polygon: ``array<struct<x1, y1, x2, y2>>``."""

    @F.pandas_udf("array<struct<x1:double,y1:double,x2:double,y2:double>>")
    def read(wkt: pd.Series) -> pd.Series:
        side = lambda p, q: {"x1": p[0], "y1": p[1], "x2": q[0], "y2": q[1]}
        return wkt.map(lambda text: [side(p, q) for rings in rings_of(text) for ring in rings for p, q in zip(ring, ring[1:] + ring[:1])])

    return read(wkt)


def meets_ellipse(sides: Column, home_x: Column, home_y: Column, work_x: Column, work_y: Column, spread: float) -> Column:
    """Whether a polygon (an array of sides, holes included) meets the ellipse of ``in_ellipse``.

    In coordinates in which the ellipse is the unit circle, a side comes as near to the middle as 1, or the middle is
    inside. Where home is work the ellipse is that point.
    """
    dx, dy = work_x - home_x, work_y - home_y
    a2 = dx * dx + dy * dy
    wide = a2 > 0
    dx, dy, a2, reach = F.when(wide, dx).otherwise(1.0), F.when(wide, dy).otherwise(0.0), F.when(wide, a2).otherwise(1.0), F.when(wide, 1.0).otherwise(0.0)
    u = lambda x, y: ((x - home_x) * dx + (y - home_y) * dy) / a2
    v = lambda x, y: ((y - home_y) * dx - (x - home_x) * dy) / (a2 * spread)
    at = F.transform(sides, lambda s: F.struct(u(s["x1"], s["y1"]).alias("u"), v(s["x1"], s["y1"]).alias("v"), u(s["x2"], s["y2"]).alias("p"), v(s["x2"], s["y2"]).alias("q")))

    def near(s: Column) -> Column:
        du, dv = s["p"] - s["u"], s["q"] - s["v"]
        size = du * du + dv * dv
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(size == 0, 0.0).otherwise(-(s["u"] * du + s["v"] * dv) / F.when(size != 0, size))))
        return F.pow(s["u"] + t * du, 2) + F.pow(s["v"] + t * dv, 2) <= reach

    crossed = lambda s: ((s["v"] > 0) != (s["q"] > 0)) & (F.lit(0.0) < (s["p"] - s["u"]) * (0 - s["v"]) / F.when(s["q"] != s["v"], s["q"] - s["v"]) + s["u"])
    return F.exists(at, near) | (F.size(F.filter(at, lambda s: F.coalesce(crossed(s), F.lit(False)))) % 2 == 1)


def generate_activity_areas(agents: DataFrame, layer: DataFrame, spread: float = 0.5, kind: str = "ellipse") -> DataFrame:
    """MM8: the cells that meet the ellipse of home and work: ``agent_id, cells`` (array).

    ``agents`` has ``agent_id, home_lon, home_lat, work_lon, work_lat``; without work there are no cells. ``layer`` has ``cell_id,
    geometry``. Agents and cells have sizes, powers of two; for each pair of sizes that occur they are brought together in
    squares of the larger one, where an ellipse takes 3 x 3 squares and a cell at most 2 x 2.
    """
    if kind != "ellipse":
        raise ValueError("only 'ellipse' is known")
    ends = [F.col(c) for c in ("home_lon", "home_lat", "work_lon", "work_lat")]
    size = lambda c: F.ceil(F.log2(F.greatest(c, F.lit(1e-9)))).cast("int")
    asked = agents.select("agent_id", *ends).where(planar(*ends).isNotNull()).withColumn("_k", size(planar(*ends) * max(1.0, spread)))
    least, most = (lambda c: F.array_min(F.transform("sides", lambda s: F.least(s[f"{c}1"], s[f"{c}2"])))), (lambda c: F.array_max(F.transform("sides", lambda s: F.greatest(s[f"{c}1"], s[f"{c}2"]))))
    cells = layer.select("cell_id", sides_of(F.col("geometry")).alias("sides")).where(F.size("sides") > 0)
    cells = cells.select("*", least("x").alias("x0"), most("x").alias("x1"), least("y").alias("y0"), most("y").alias("y1"))
    cells = materialize(cells.withColumn("_c", size(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))), "cells")
    # one number per power of two
    agent_sizes, cell_sizes = (F.array(*map(F.lit, v)) if (v := [r[0] for r in df.select(c).distinct().collect()]) else F.array().cast("array<int>") for df, c in ((asked, "_k"), (cells, "_c")))
    square = lambda v: F.floor(v / F.pow(F.lit(2.0), F.greatest("_k", "_c"))).cast("long")
    around = F.explode(F.array(*(F.struct((square(F.col("home_lon")) + a).alias("i"), (square(F.col("home_lat")) + b).alias("j")) for a in (-1, 0, 1) for b in (-1, 0, 1))))
    asked = asked.withColumn("_c", F.explode(cell_sizes)).withColumn("_s", around).select("*", "_s.i", "_s.j")
    laid = cells.withColumn("_k", F.explode(agent_sizes)).withColumn("i", F.explode(F.sequence(square(F.col("x0")), square(F.col("x1"))))).withColumn("j", F.explode(F.sequence(square(F.col("y0")), square(F.col("y1")))))
    found = asked.join(laid, ["_k", "_c", "i", "j"]).where(meets_ellipse(F.col("sides"), *ends, spread)).groupBy("agent_id").agg(F.array_sort(F.collect_set("cell_id")).alias("cells"))
    return agents.select("agent_id").join(found, "agent_id", "left")


def circadian_profiles(df: DataFrame, ranked: DataFrame, weights: bool = True, quantity: int = 2, length: int = 24, aux_cols: tuple[str, ...] = ()) -> DataFrame:
    """MM9, first half: ``user_id, slot, hod, share`` for the ``quantity`` significant places, the rest, and all hours.

    Slots are 0 home, 1 work and so on, the last one other places. ``length`` is the cycle in hours (24: hours of the day,
    168: of the week from Thursday, the first day of the epoch). The share of an hour's records at each slot, or with
    ``weights=False`` 1 for the slot with most and 0 for the others. With ``aux_cols`` there is a column ``combo`` besides:
    every combination of their values that the table has (texts, joined by ``|``; rows with a null in one are left out),
    and shares are over slots and combinations; then ``weights`` is always true.
    """
    slots = df.join(ranked.where(F.col("rank") < quantity).select("user_id", "labels", "lon", "lat", "rank"), ["user_id", "labels", "lon", "lat"], "left").where(F.col("labels").isNotNull())
    hod = F.pmod(F.floor(micros(F.col("datetime")) / HOUR), F.lit(length)).cast("int")
    combo = F.concat_ws("|", *(F.col(c).cast("string") for c in aux_cols)) if aux_cols else F.lit("")
    for c in aux_cols:
        slots = slots.where(F.col(c).isNotNull())
    counts = slots.groupBy("user_id", hod.alias("hod"), combo.alias("combo"), F.coalesce("rank", F.lit(quantity)).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("user_id", "hod")
    counts = counts.withColumn("share", F.col("n") / F.sum("n").over(by) if weights or aux_cols else (F.row_number().over(by.orderBy(F.desc("n"), "slot")) == 1).cast("double"))
    hours, places = F.sequence(F.lit(0), F.lit(length - 1)), F.sequence(F.lit(0), F.lit(quantity))
    # a row for every cell of the profile; the combinations are few
    combos = F.explode(counts.agg(F.collect_set("combo")).scalar()) if aux_cols else F.lit("")
    grid = counts.select("user_id").distinct().select("user_id", combos.alias("combo"))
    grid = grid.select("user_id", "combo", F.explode(places).alias("slot")).select("*", F.explode(hours).alias("hod"))
    out = grid.join(counts.select("user_id", "slot", "hod", "combo", "share"), ["user_id", "slot", "hod", "combo"], "left").withColumn("share", F.coalesce("share", F.lit(0.0)))
    return out.select("user_id", "slot", "hod", *(["combo"] if aux_cols else []), "share")


def cluster_trajectories(profiles: DataFrame, min_samples: int = 4, weights: bool = True) -> DataFrame:
    """MM9, second half: ``user_id, cluster``: users of like rhythm; -1 is noise.

    Two users are as far apart as the earth mover's distance between the values of their profiles: the mean difference of
    the sorted values. With ``weights=False`` the values are the leading slots of the hours (0 for an hour without records)
    instead of the shares. Density clusters are formed over all users at the radius of the best silhouette (if none gives
    two clusters, at the widest); see ``density_labels``. Users of equal values are one row with their count. Clusters are
    numbered by the least hash of their core users.
    """
    if not weights:
        profiles = profiles.groupBy("user_id", "hod").agg(F.max_by("slot", F.struct("share", -F.col("slot"))).cast("double").alias("share"))
    vectors = materialize(profiles.groupBy("user_id").agg(F.array_sort(F.collect_list("share")).alias("v")), "vectors")
    merged = vectors.groupBy("v").agg(F.count(F.lit(1)).alias("w"), F.min(F.struct(F.xxhash64("user_id").alias("hash"), "user_id")).alias("first"))
    rows = merged.orderBy("first").select("v", "w").toArrow()
    if not rows.num_rows:
        return vectors.select("user_id", F.lit(-1).alias("cluster"))
    v = np.stack([np.asarray(x, float) for x in rows.column("v").to_pylist()])
    spark = profiles.sparkSession
    labels = density_labels(spark, v, rows.column("w").to_numpy(), min_samples)
    known = spark.sparkContext.broadcast({row.tobytes(): int(label) for row, label in zip(v, labels)})

    @F.pandas_udf("int")
    def cluster_of(v: pd.Series) -> pd.Series:
        return pd.Series([known.value[np.asarray(row, float).tobytes()] for row in v], dtype="int32")

    return vectors.select("user_id", cluster_of("v").alias("cluster"))


def cluster_shares(clusters: DataFrame) -> DataFrame:
    """MM9: share of the users in each cluster, noise left out."""
    counts = clusters.where("cluster >= 0").groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("cluster", (F.col("n") / counts.agg(F.sum("n")).scalar()).alias("share"))


def circadian_rhythm_extraction(profiles: DataFrame, clusters: DataFrame, weights: bool = True) -> DataFrame:
    """MM10: rhythm of each cluster: mean share of each slot and hour, or 1 for the slot that leads for most users."""
    rows = profiles.join(clusters.where("cluster >= 0"), "user_id")
    mean = rows.groupBy("cluster", "slot", "hod").agg(F.avg("share").alias("share"))
    if weights:
        return mean
    leads = F.row_number().over(Window.partitionBy("cluster", "hod").orderBy(F.desc("share"), "slot")) == 1
    return mean.withColumn("share", leads.cast("double"))


def generate_agents(homes: DataFrame, works: DataFrame, spread: float, layer: DataFrame) -> DataFrame:
    """MM11, MM12: ``agent_id, cluster, home_lon, home_lat, work_lon, work_lat, cells``."""
    at_work = works.select("agent_id", F.col("lon").alias("work_lon"), F.col("lat").alias("work_lat"))
    agents = materialize(homes.select("agent_id", "cluster", F.col("lon").alias("home_lon"), F.col("lat").alias("home_lat")).join(at_work, "agent_id", "left"), "agents")
    return materialize(agents.join(generate_activity_areas(agents, layer, spread), "agent_id", "left"), "agents")


@dataclass(frozen=True)
class MobilityModel:
    """What ``fit_mobility_model`` learns: agents, rhythm by cluster, and the polygon layer."""

    agents: DataFrame
    rhythm: DataFrame
    layer: DataFrame

    def generate(self, start: str, days: int | None = None, seed: int = 0, weighted: bool = True, end: str | None = None) -> DataFrame:
        return data_generator(self.agents, self.rhythm, self.layer, start, days, seed, weighted, end)


def fit_mobility_model(df: DataFrame, layer: DataFrame, agents: int = 217, weighted: bool = True, spread: float = 0.05, seed: int = 0) -> MobilityModel:
    """MM13: significant places, clusters of rhythm, home and work densities and commutes of each cluster, and its agents.

    ``df`` has ``labels``; ``layer`` has ``cell_id, geometry, cx, cy``. Each cluster gets its share of the agents, rounded up.
    """
    ranked = rank_freq(df, 2)
    profiles = materialize(circadian_profiles(df, ranked, weighted), "profiles")
    clusters = materialize(cluster_trajectories(profiles, weights=weighted), "clusters")
    located = materialize(ranked.join(locate(ranked, layer), ["lon", "lat"]).join(clusters.where("cluster >= 0"), "user_id").select("user_id", "cluster", "rank", "lon", "lat", "cell_id"), "places")

    def density(rank: int) -> DataFrame:
        counts = located.where(F.col("rank") == rank).groupBy("cluster", "cell_id").agg(F.count(F.lit(1)).alias("n"))
        return counts.join(layer.select("cell_id", "cx", "cy"), "cell_id").withColumn("value", F.col("n") / F.sum("n").over(Window.partitionBy("cluster")))

    far = commute_distances(located).where("rank_a = 0 and rank_b = 1").select("user_id", "distance")
    commutes = located.where("rank = 0").join(far, "user_id").groupBy("cluster", "cell_id").agg(F.median("distance").alias("value"))
    amounts = cluster_shares(clusters).select("cluster", F.ceil(F.round(F.col("share") * agents, 9)).alias("amount"))
    homes = materialize(generate_points_from_distribution(density(0).join(amounts, "cluster"), F.col("amount"), seed), "homes")
    works = select_points_with_commuting(homes, density(1), commutes, spread, seed)
    return MobilityModel(generate_agents(homes, works, spread, layer), materialize(circadian_rhythm_extraction(profiles, clusters, weighted), "rhythm"), layer)


def data_sampler(t, aggregation: int | float | DataFrame, weighted: bool = True, agents: int = 217, spread: float = 0.05, seed: int = 0) -> MobilityModel:
    """MM13 from a ``Trajectories``: its layer is a grid of that resolution in metres, or a polygon layer (``cell_id, geometry, cx, cy``).

    Geographic coordinates become EPSG:3857 first; the layer must be in the system of the result. Only cells with records count.
    """
    if t.crs == "EPSG:4326":
        t = t.to_crs("EPSG:3857")
    layer = aggregation
    if not isinstance(aggregation, DataFrame):
        layer = create_grid(t.df, aggregation).withColumn("geometry", box_wkt(*(F.col(c) for c in ("xmin", "ymin", "xmax", "ymax"))))
    return fit_mobility_model(t.df, materialize(filter_layer(layer, t.df), "layer"), agents, weighted, spread, seed)


def when(rhythm: DataFrame) -> DataFrame:
    """MM15, the table to draw from: ``cluster, hod, s0, s1, s2``: shares of home, work and other."""
    pick = lambda s: F.coalesce(F.max(F.when(F.col("slot") == s, F.col("share"))), F.lit(0.0)).alias(f"s{s}")
    return rhythm.groupBy("cluster", "hod").agg(*map(pick, range(3)))


def where(slot: Column, home: Column, work: Column, other: Column) -> Column:
    """MM16: home, work, or an activity cell; home if the agent has no such place."""
    return F.coalesce(F.when(slot == 0, home).when(slot == 1, work).otherwise(other), home)


def data_generator(agents: DataFrame, rhythm: DataFrame, layer: DataFrame, start: str, days: int | None = None, seed: int = 0, weighted: bool = True, end: str | None = None) -> DataFrame:
    """MM14: hourly places of all agents: ``agent_id, datetime, slot, lon, lat``, from ``start`` for ``days`` days and one slot.

    Without ``days`` they are the whole days from ``start`` to ``end``.
    """
    t0 = micros(F.lit(start).cast("timestamp"))
    if days is None:
        if end is None:
            raise ValueError("give days or end")
        days = F.floor((micros(F.lit(end).cast("timestamp")) - t0) / (24 * HOUR))
    slots = agents.withColumn("_t", F.explode(F.sequence(t0, t0 + days * 24 * HOUR, F.lit(HOUR)))).withColumn("hod", F.pmod(F.floor(F.col("_t") / HOUR), F.lit(24)).cast("int"))
    drawn = slots.join(F.broadcast(when(rhythm)), ["cluster", "hod"], "left")
    total = F.col("s0") + F.col("s1") + F.col("s2")
    u = uniform(seed, "agent_id", "_t") * total
    slot = F.when(u < F.col("s0"), 0).when(u < F.col("s0") + F.col("s1"), 1).otherwise(2)
    if not weighted:
        slot = F.when((F.col("s0") >= F.col("s1")) & (F.col("s0") >= F.col("s2")), 0).when(F.col("s1") >= F.col("s2"), 1).otherwise(2)
    slot = F.when(total > 0, slot).otherwise(0)
    n = F.size("cells")
    cell = F.when(n > 0, F.element_at("cells", (F.floor(uniform(seed + 1, "agent_id", "_t") * n) + 1).cast("int")))
    drawn = drawn.select("agent_id", F.timestamp_micros("_t").cast("timestamp_ntz").alias("datetime"), slot.alias("slot"), "home_lon", "home_lat", "work_lon", "work_lat", cell.alias("cell_id"))
    placed = drawn.join(layer.select("cell_id", "cx", "cy"), "cell_id", "left")
    return placed.select("agent_id", "datetime", "slot", where(F.col("slot"), F.col("home_lon"), F.col("work_lon"), F.col("cx")).alias("lon"), where(F.col("slot"), F.col("home_lat"), F.col("work_lat"), F.col("cy")).alias("lat"))


def best_window(df: DataFrame, hours: int = 168) -> DataFrame:
    """MM18: the ``hours`` successive hours of each user with the fewest empty ones: ``user_id, end, empty``.

    Only windows that lie whole between the first and last record count; a tie goes to the earliest.
    """
    seen = with_bins(df, "1H").select("user_id", "bin").distinct()
    w = Window.partitionBy("user_id").orderBy("bin")
    dense = seen.select("user_id", "bin", F.lead("bin").over(w).alias("n"))
    dense = dense.select("user_id", F.explode(F.transform(F.sequence("bin", F.coalesce(F.col("n") - HOUR, F.col("bin")), F.lit(HOUR)), lambda b: F.struct(b.alias("b"), (b != F.col("bin")).cast("int").alias("e")))).alias("x")).select("user_id", "x.*")
    by = Window.partitionBy("user_id").orderBy("b").rowsBetween(-(hours - 1), 0)
    rolled = dense.select("user_id", "b", F.avg("e").over(by).alias("empty"), F.count("e").over(by).alias("k")).where(F.col("k") == hours)
    best = rolled.groupBy("user_id").agg(F.min(F.struct("empty", "b")).alias("m"))
    return best.select("user_id", F.timestamp_micros("m.b").cast("timestamp_ntz").alias("end"), F.col("m.empty").alias("empty"))
