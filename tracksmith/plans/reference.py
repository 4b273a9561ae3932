"""Queries of the mobility operators over the driver tables, and their SQL.

One planar trajectory is made from ``events`` in the same way on both sides: the number k in ``props`` is a place on a
lattice of 10 x 10 points 1000 m apart. It is clean; the dirty tables are in ``plans.dirty``, which runs the same
queries over them: a folder of the class ``Binned`` or ``Symbols`` stands for ``aggregated_trajectory`` or ``symbol_sequences``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracksmith.operators import measures as m
from tracksmith.operators import preparing as pr
from tracksmith.operators import spatial as sp
from tracksmith.operators import statistics as us
from tracksmith.operators.temporal import TemporalAggregator
from tracksmith.operators.trajectory import Trajectories, in_time, up_to_now
from tracksmith.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The trajectory in SQL; ``gaps`` has no label and no place where k is a multiple of 7.
TRAJ = """with traj as (select user_id, ts as datetime, event_id as seq, cast(regexp_extract(props, '[0-9]+') as integer) as labels,
  (cast(regexp_extract(props, '[0-9]+') as integer) % 10) * 1000.0::double as lon, (cast(regexp_extract(props, '[0-9]+') as integer) // 10) * 1000.0::double as lat, value as v from events),
gaps as (select user_id, datetime, seq, nullif(labels, (labels // 7) * 7) as labels, case when labels % 7 <> 0 then lon end as lon, case when labels % 7 <> 0 then lat end as lat, v from traj),
coarse as (select user_id, datetime, seq, labels % 4 as labels, (labels % 4) * 1000.0::double as lon, 0.0::double as lat, v from traj),
stays as (select user_id, datetime, seq, labels, lon, lat, datetime as "start", datetime + to_microseconds(cast(round(v * 60000000) as bigint)) as "end" from traj)
"""


class Binned(str):
    """A data folder whose trajectory is ``aggregated_trajectory``: hourly bins, a fifth of them without place."""

    def trajectory(self, spark: SparkSession) -> DataFrame:
        df = table(spark, self, "aggregated_trajectory")
        at = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
        rows = df.select("user_id", at("datetime"), F.floor(F.unix_micros("datetime") / 3_600_000_000).cast("long").alias("seq"), "labels", "lon", "lat", F.col("temp").alias("v"), at("start"), at("end"))
        return rows.distinct()


class Symbols(str):
    """A data folder whose trajectory is ``symbol_sequences``: labels without places, some missing."""

    def trajectory(self, spark: SparkSession) -> DataFrame:
        df = table(spark, self, "symbol_sequences")
        rows = df.select("user_id", F.col("datetime").cast("timestamp_ntz").alias("datetime"), F.floor(F.unix_micros("datetime") / 3_600_000_000).cast("long").alias("seq"), "labels")
        return rows.distinct().withColumns({"lon": F.lit(0.0), "lat": F.lit(0.0)})


def traj(spark: SparkSession, folder: str) -> DataFrame:
    if isinstance(folder, (Binned, Symbols)):
        return folder.trajectory(spark)
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    df = table(spark, folder, "events").select("user_id", F.col("ts").alias("datetime"), F.col("event_id").alias("seq"), k.alias("labels"), F.col("value").alias("v"))
    return df.select("user_id", "datetime", "seq", "labels", (F.col("labels") % 10 * 1000.0).alias("lon"), (F.floor(F.col("labels") / 10) * 1000.0).alias("lat"), "v")


def gaps(spark: SparkSession, folder: str) -> DataFrame:
    if isinstance(folder, (Binned, Symbols)):
        return folder.trajectory(spark)
    there = F.col("labels") % 7 != 0
    return traj(spark, folder).select("user_id", "datetime", "seq", *(F.when(there, F.col(c)).alias(c) for c in ("labels", "lon", "lat")), "v")


def coarse(spark: SparkSession, folder: str) -> DataFrame:
    if isinstance(folder, (Binned, Symbols)):
        return folder.trajectory(spark)
    return traj(spark, folder).withColumn("labels", F.col("labels") % 4).withColumns({"lon": F.col("labels") * 1000.0, "lat": F.lit(0.0)})


def stays(spark: SparkSession, folder: str) -> DataFrame:
    if isinstance(folder, (Binned, Symbols)):
        return folder.trajectory(spark)
    df = traj(spark, folder)
    end = F.timestamp_micros(F.unix_micros(F.col("datetime").cast("timestamp")) + F.round(F.col("v") * 60000000).cast("long")).cast("timestamp_ntz")
    return df.select("user_id", "datetime", "seq", "labels", "lon", "lat", F.col("datetime").alias("start"), end.alias("end"))


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns or ("value",)})


def add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None, base: str = TRAJ) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = base + sql


def mobility_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Places, entropy and radius of gyration per user after grid aggregation and removal of repeated places."""
    grid = sp.GridAggregation(2000.0).aggregate(traj(spark, folder), labels=False)
    moves = pr.next_location_sequence(grid).withColumn("labels", F.xxhash64("lon", "lat"))
    parts = [m.num_of_distinct_locations(moves).withColumnRenamed("value", "n_places"), m.unc_entropy(moves).withColumnRenamed("value", "entropy"), m.radius_of_gyration(moves, False).withColumnRenamed("value", "radius")]
    return rounded(parts[0].join(parts[1], "user_id").join(parts[2], "user_id"), "entropy", "radius")


_CELLS = """, e as (select min(lon) x0, max(lon) x1, min(lat) y0, max(lat) y1 from traj),
n as (select *, ceil((x1 - x0) / 2000.0 + 1) - 1 nx, ceil((y1 - y0) / 2000.0 + 1) - 1 ny from e),
grid as (select user_id, datetime, seq, v, x0 + (least(floor((lon - x0) / ((x1 - x0) / nx)), nx - 1) + 0.5) * ((x1 - x0) / nx) as lon,
  y0 + (least(floor((lat - y0) / ((y1 - y0) / ny)), ny - 1) + 0.5) * ((y1 - y0) / ny) as lat from traj, n)
"""
add("mobility_profile", mobility_profile, _CELLS + """, moves as (select * from (select *, lag(lon) over w plon, lag(lat) over w plat from grid window w as (partition by user_id order by datetime, seq)) where lon is distinct from plon or lat is distinct from plat),
f as (select user_id, lon, lat, count(*) c, sum(count(*)) over (partition by user_id) n from moves group by 1, 2, 3),
centre as (select user_id, avg(lon) cx, avg(lat) cy from f group by 1)
select user_id, n_places, round(entropy, 6) as entropy, round(radius, 6) as radius from
(select user_id, count(*) n_places, sum(-(c / n) * log2(c / n)) entropy from f group by 1) join
(select user_id, sqrt(avg((lon - cx) * (lon - cx) + (lat - cy) * (lat - cy))) radius from moves join centre using (user_id) group by 1) using (user_id)""")  # fmt: skip

# sources and selection
add("sc4_uloc", lambda s, d: Trajectories.from_df(traj(s, d)).uloc([3, 5, 8]).df.select("user_id", "datetime", "labels"), "select user_id, datetime, labels from traj where user_id in (3, 5, 8)")
add("sc5_users", lambda s, d: Trajectories.from_df(traj(s, d)).get_users(), "select distinct user_id from traj")
add("sc7_quality_filter", lambda s, d: Trajectories.from_df(traj(s, d)).uloc(us.user_quality(traj(s, d), "1D").where("n_records >= 60 and duration > 20")).df.select("user_id", "datetime"),
    "select user_id, datetime from traj where user_id in (select user_id from traj group by 1 having count(*) >= 60 and date_diff('day', min(datetime), max(datetime)) + 1 > 20)")
add("sc8_drop_duplicates", lambda s, d: Trajectories.from_df(coarse(s, d)).df.select("user_id", "lon", "lat").distinct(), "select distinct user_id, lon, lat from coarse")
add("sc9_dropna", lambda s, d: Trajectories.from_df(gaps(s, d)).dropna().df.select("user_id", "datetime", "labels"), "select user_id, datetime, labels from gaps where lon is not null")
add("sc11_inner_records", lambda s, d: Trajectories.from_df(traj(s, d)).nth(1, -2).df.select("user_id", "datetime", "labels"),
    "select user_id, datetime, labels from traj qualify row_number() over (partition by user_id order by datetime, seq) > 1 and row_number() over (partition by user_id order by datetime desc, seq desc) > 1")
add("g1_to_crs", lambda s, d: rounded(Trajectories.from_df(table(s, d, "landmarks").select("landmark_id", F.lit("2024-01-01").alias("datetime"), "lon", "lat"), user="landmark_id").to_crs("EPSG:3857").df.select("user_id", "lon", "lat"), "lon", "lat"),
    "select landmark_id as user_id, round(6378137.0 * radians(lon), 6) as lon, round(6378137.0 * ln(tan(pi() / 4 + radians(lat) / 2)), 6) as lat from landmarks", "")

# statistics
add("us1_fraction_empty", lambda s, d: rounded(us.fraction_of_empty_records(traj(s, d), "1H")),
    "select user_id, round(1 - count(distinct h) / (max(h) - min(h) + 1), 6) as value from (select user_id, epoch_us(datetime) // 3600000000 h from traj) group by 1")
add("us2_count_records", lambda s, d: us.count_records(traj(s, d)), "select user_id, count(*) as value from traj group by 1")
add("us3_records_per_frame", lambda s, d: us.count_records_per_time_frame(traj(s, d), "7D"),
    ", o as (select date_trunc('day', min(datetime)) o from traj) select user_id, time_bucket(interval 7 days, datetime, o) as bin_start, count(*) as n_records from traj, o group by 1, 2")
add("us4_duration", lambda s, d: us.user_trajectories_duration(traj(s, d), "5H"),
    ", o as (select *, epoch_us(date_trunc('day', min(datetime) over (partition by user_id))) o from traj) select user_id, max((epoch_us(datetime) - o) // 18000000000) - min((epoch_us(datetime) - o) // 18000000000) + 1 as value from o group by 1")
add("us4_occupied", lambda s, d: us.user_trajectories_duration(traj(s, d), "1D", False), "select user_id, count(distinct datetime::date) as value from traj group by 1")
add("us5_consecutive", lambda s, d: us.consecutive_record(traj(s, d), "1D"),
    ", b as (select distinct user_id, datetime::date - date '1970-01-01' b from traj), i as (select user_id, b - row_number() over (partition by user_id order by b) i from b) select user_id, max(c) as value from (select user_id, count(*) c from i group by user_id, i) group by 1")
for _name, _how in (("us6_max", "max"), ("us7_min", "min"), ("us8_mean", "avg")):
    add(_name, lambda s, d, how=_how: rounded(us.per_user(traj(s, d), "v", how)), f"select user_id, round({_how}(v), 6) as value from traj group by 1")
add("pr1_top_time", lambda s, d: pr.top_time(coarse(s, d), "1D").select("user_id", "datetime", "lon"), """
, b as (select *, datetime::date b, coalesce(epoch_us(lead(datetime) over (partition by user_id, datetime::date order by datetime, seq)) - epoch_us(datetime), 0) w from coarse),
p as (select user_id, b, lon, sum(w) w, min((datetime, seq)) f from b group by 1, 2, 3),
r as (select user_id, b, lon from p qualify row_number() over (partition by user_id, b order by w desc, f) = 1)
select b.user_id, b.datetime, b.lon from b semi join r on b.user_id = r.user_id and b.b = r.b and b.lon = r.lon""")
add("pr2_mode", lambda s, d: pr.mode_of(gaps(s, d), "labels"), "select user_id, labels as value from (select user_id, labels, row_number() over (partition by user_id order by count(*) desc, labels) r from gaps where labels is not null group by 1, 2) where r = 1")
add("pr3_rowwise_average", lambda s, d: rounded(us.rowwise_average(traj(s, d), "v"), "mean"), "select n, round(avg(v), 6) as mean from (select v, cast(row_number() over (partition by user_id order by datetime, seq) - 1 as integer) n from traj) group by 1")
add("pr5_normalise", lambda s, d: rounded(us.groupwise_normalise(traj(s, d), "v")).select("user_id", "seq", "value"), "select user_id, seq, round(v / sum(v) over (partition by user_id), 6) as value from traj")
add("pr6_expansion", lambda s, d: us.groupwise_expansion(traj(s, d), "v").withColumn("value", F.round("value", 9)).select("user_id", "seq", "value"), "select user_id, seq, round(avg(v) over (partition by user_id order by datetime, seq rows between unbounded preceding and current row), 9) as value from traj")
_HIST = """, e as (select min(v) lo, max(v) hi from traj), i as (select {index} i, lo, hi from traj, e), c as (select i, count(*) c from i where i between 1 and {n} group by 1)
select round(lo + (b - 1) * {w}, 6) as bin_lo, round(lo + b * {w}, 6) as bin_hi, round(coalesce(c, 0) / (select sum(c) from c), 6) as share from e, (select unnest(range(1, {n} + 1)) b) left join c on i = b"""
add("pr7_distribution", lambda s, d: rounded(us.convert_to_distribution(traj(s, d), "v", num_of_classes=15), "bin_lo", "bin_hi", "share"), _HIST.format(index="least(ceil((v - lo) / ((hi - lo) / 15)), 15)::bigint", n=15, w="((hi - lo) / 15)"))
add("pr8_normalize", lambda s, d: rounded(us.normalize(us.count_records(traj(s, d)), "value", "share"), "share"), "select user_id, count(*) as value, round(count(*) / (select count(*) from traj), 6) as share from traj group by 1")
add("pr9_total_normalise", lambda s, d: us.total_normalise(us.count_records(traj(s, d)), "value").withColumn("value", F.round("value", 9)), "select user_id, round(count(*) / (select count(*) from traj), 9) as value from traj group by 1")
add("pr10_start_end", lambda s, d: pr.start_end(coarse(s, d)).select("user_id", "datetime", "labels", "start", "end"), """
, c as (select *, case when labels is distinct from lag(labels) over (partition by user_id order by datetime, seq) then 1 else 0 end f from coarse),
r as (select *, sum(f) over (partition by user_id order by datetime, seq) r from c)
select user_id, min(datetime) as datetime, any_value(labels) as labels, min(datetime) as "start", max(datetime) as "end" from r group by user_id, r having min(datetime) <> max(datetime)""")
for _how, _f, _o in (("ffill", "last_value", "unbounded preceding and current row"), ("bfill", "first_value", "current row and unbounded following")):
    add(f"fi1_{_how}", lambda s, d, how=_how: pr.fill_gaps(gaps(s, d), how).select("user_id", "seq", "lon", "lat"),
        f"select user_id, seq, {_f}(lon ignore nulls) over w as lon, {_f}(lat ignore nulls) over w as lat from gaps window w as (partition by user_id order by datetime, seq rows between {_o})")
_MOVES = """, moves as (select * from (select *, lag(lon) over w plon, lag(lat) over w plat, row_number() over w rn from {t} where lon is not null window w as (partition by user_id order by datetime, seq)) where rn = 1 or lon is distinct from plon or lat is distinct from plat)
"""
add("fi2_next_location", lambda s, d: pr.next_location_sequence(coarse(s, d)).select("user_id", "datetime", "labels"), _MOVES.format(t="coarse") + "select user_id, datetime, labels from moves")
add("fi4_stop_detection", lambda s, d: pr.stop_detection(traj(s, d), 3000, "10 min", crs="EPSG:3857").where("is_stop").select("user_id", "seq", "stop_id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat")), """
, n as (select *, row_number() over (partition by user_id order by datetime, seq) i from traj),
a as (with recursive a as (select user_id, i, i as anchor, lon as ax, lat as ay from n where i = 1
  union all select n.user_id, n.i, case when sqrt((n.lon - ax) * (n.lon - ax) + (n.lat - ay) * (n.lat - ay)) > 3000 then n.i else anchor end,
    case when sqrt((n.lon - ax) * (n.lon - ax) + (n.lat - ay) * (n.lat - ay)) > 3000 then n.lon else ax end, case when sqrt((n.lon - ax) * (n.lon - ax) + (n.lat - ay) * (n.lat - ay)) > 3000 then n.lat else ay end
  from a join n on n.user_id = a.user_id and n.i = a.i + 1) select * from a),
g as (select n.user_id, anchor, count(*) c, max(datetime) - min(datetime) d, max(anchor) over (partition by n.user_id) top, avg(n.lon) x, avg(n.lat) y from a join n using (user_id, i) group by 1, 2),
k as (select *, row_number() over (partition by user_id order by anchor) stop_id from g where c > 1 and d > interval 10 minutes and anchor < top)
select n.user_id, n.seq, stop_id, round(x, 6) as lon, round(y, 6) as lat from n join a using (user_id, i) join k on k.user_id = n.user_id and k.anchor = a.anchor""")

# space and time
_FIRST = """, p as (select lon, lat, min((user_id, datetime, seq)) f from {t} where lon is not null group by 1, 2), l as (select lon, lat, cast(row_number() over (order by f) - 1 as integer) labels from p)
"""
add("sp1_grid", lambda s, d: sp.GridAggregation(2000.0).aggregate(traj(s, d)).select("user_id", "seq", "lon", "lat", "labels"), _CELLS + _FIRST.format(t="grid") + "select user_id, seq, lon, lat, l.labels from grid join l using (lon, lat)")
add("sp4_create_grid", lambda s, d: sp.create_grid(traj(s, d), 2000.0), """, e as (select min(lon) x0, max(lon) x1, min(lat) y0, max(lat) y1 from traj), n as (select *, ceil((x1 - x0) / 2000.0 + 1)::bigint - 1 nx, ceil((y1 - y0) / 2000.0 + 1)::bigint - 1 ny from e),
w as (select *, (x1 - x0) / nx wx, (y1 - y0) / ny wy from n)
select i * ny + j as cell_id, x0 + i * wx as xmin, y0 + j * wy as ymin, x0 + (i + 1) * wx as xmax, y0 + (j + 1) * wy as ymax, x0 + (i + 0.5) * wx as cx, y0 + (j + 0.5) * wy as cy
from w, (select unnest(range(0, 1000)) i), (select unnest(range(0, 1000)) j) where i < nx and j < ny""")
add("sp5_dbscan", lambda s, d: sp.ClusteringAggregator(kwargs={"eps": 500.0, "min_samples": 3}).aggregate(coarse(s, d).withColumns({"lon": F.col("lon")})).select("user_id", "seq", "lon", "lat", "labels"), """
, c as (select user_id, lon, count(*) c, min((datetime, seq)) f from coarse group by 1, 2), k as (select user_id, lon, cast(row_number() over (partition by user_id order by f) - 1 as integer) k from c where c >= 3)
select user_id, seq, lon, lat, coalesce(k, -1) as labels from coarse left join k using (user_id, lon)""")


def _layer(s: SparkSession, d: str) -> DataFrame:
    cells = sp.create_grid(traj(s, d), 2000.0)
    return cells.where("cell_id % 4 <> 1").withColumn("geometry", sp.box_wkt(*(F.col(c) for c in ("xmin", "ymin", "xmax", "ymax"))))


_LAYER = """, layer as (select i * 5 + j as cell_id, i * 1800.0::double as xmin, j * 1800.0::double as ymin, (i + 1) * 1800.0::double as xmax, (j + 1) * 1800.0::double as ymax, (i + 0.5) * 1800.0::double as cx, (j + 0.5) * 1800.0::double as cy
  from (select unnest(range(0, 5)) i), (select unnest(range(0, 5)) j) where (i * 5 + j) % 4 <> 1),
inside as (select lon, lat, min(cell_id) cell_id from (select distinct lon, lat from traj) join layer on lon between xmin and xmax and lat between ymin and ymax group by 1, 2)
"""
add("sp7_layer", lambda s, d: sp.LayerAggregator(_layer(s, d)).aggregate(traj(s, d)).select("user_id", "seq", "cell_id", "lon", "lat"), _LAYER + "select user_id, seq, cell_id, cx as lon, cy as lat from traj join inside using (lon, lat) join layer using (cell_id)")
add("sp7_layer_left", lambda s, d: sp.LayerAggregator(_layer(s, d)).aggregate(traj(s, d), drop_unmatched=False).select("user_id", "seq", "cell_id", "lon", "lat"), _LAYER + "select user_id, seq, cell_id, cx as lon, cy as lat from traj left join inside using (lon, lat) left join layer using (cell_id)")
add("sp8_labels", lambda s, d: sp.to_labels(gaps(s, d)).select("user_id", "seq", "labels"), _FIRST.format(t="gaps") + "select user_id, seq, l.labels from gaps left join l using (lon, lat)")
add("sp10_moving_average", lambda s, d: rounded(sp.moving_average(us.count_records_per_time_frame(traj(s, d), "1D").groupBy("bin_start").agg(F.sum("n_records").alias("n")), "n", "bin_start", 3)),
    "select bin_start, round(value, 6) as value from (select datetime::date::timestamp as bin_start, avg(count(*)) over w as value, count(*) over w as k from traj group by 1 window w as (order by datetime::date::timestamp rows between 2 preceding and current row)) where k = 3")
add("sp11_filter_layer", lambda s, d: sp.filter_layer(_layer(s, d), traj(s, d)).select("cell_id", "cx", "cy"), _LAYER + "select cell_id, cx, cy from layer where cell_id in (select cell_id from inside)")
_BINS = """, x as (select *, unnest(range(epoch_us("start") // 3600000000 * 3600000000, epoch_us("end") // 3600000000 * 3600000000 + 1, 3600000000)) b, epoch_us("start") s, epoch_us("end") e from stays),
w as (select *, {rule} w from x), r as (select * from w qualify row_number() over (partition by user_id, b order by w desc, s, seq) = 1)
"""
_OVERLAP = "least(e, b + 3600000000) - greatest(s, b)"
_REFERENCE = "case when e < b + 3600000000 and s > b then e - s when e > b + 3600000000 then b + 3600000000 - s else s - b end"
_TA = ("user_id", "datetime", "labels", "lon", "lat", "start", "end")
add("ta1_overlap", lambda s, d: TemporalAggregator("1H").aggregate(stays(s, d)).select(*_TA), _BINS.format(rule=_OVERLAP) + """, u as (select user_id, unnest(range(min(b), max(b) + 1, 3600000000)) b from r group by 1)
select u.user_id, make_timestamp(u.b) as datetime, labels, lon, lat, "start", "end" from u left join r using (user_id, b)""")
add("ta1_reference_rule", lambda s, d: TemporalAggregator("1H", "reference").aggregate(stays(s, d), drop_empty=True).select(*_TA), _BINS.format(rule=_REFERENCE) + """select user_id, make_timestamp(b) as datetime, labels, lon, lat, "start", "end" from r""")
add("ta1_filled", lambda s, d: TemporalAggregator("1H").aggregate(stays(s, d), fill_method="ffill").select("user_id", "datetime", "labels"), _BINS.format(rule=_OVERLAP) + """, u as (select user_id, unnest(range(min(b), max(b) + 1, 3600000000)) b from r group by 1)
select u.user_id, make_timestamp(u.b) as datetime, last_value(labels ignore nulls) over (partition by u.user_id order by u.b) as labels from u left join r using (user_id, b)""")

# measures
add("im1_distinct_locations", lambda s, d: m.num_of_distinct_locations(gaps(s, d)), "select user_id, count(distinct labels) + max((labels is null)::int) as value from gaps group by 1")
add("im2_visitation_frequency", lambda s, d: rounded(m.visitation_frequency(gaps(s, d)), "freq"), "select user_id, lon, lat, round(count(*) / sum(count(*)) over (partition by user_id), 6) as freq from gaps where lon is not null group by 1, 2, 3")
add("im3_distinct_over_time", lambda s, d: m.distinct_locations_over_time(traj(s, d), "1D"), """, f as (select user_id, labels, min(datetime)::date b from traj group by 1, 2), c as (select user_id, b, count(*) c from f group by 1, 2),
u as (select user_id, unnest(generate_series(min(b)::timestamp, max(b)::timestamp, interval 1 day)) b from c group by 1)
select u.user_id, u.b as bin_start, cast(sum(coalesce(c, 0)) over (partition by u.user_id order by u.b) as bigint) as n_distinct from u left join c on c.user_id = u.user_id and c.b = u.b::date""")
add("im4_first_visits", lambda s, d: m.first_visits(traj(s, d)).select("user_id", "lon", "lat", "datetime"), "select user_id, lon, lat, min(datetime) as datetime from traj group by 1, 2, 3")
_LAG = "(select *, lag(lon) over w plon, lag(lat) over w plat, lag(datetime) over w pt from {t} where lon is not null window w as (partition by user_id order by datetime, seq))"
_HOP = "sqrt((lon - plon) * (lon - plon) + (lat - plat) * (lat - plat))"
add("im5_jump_lengths", lambda s, d: rounded(m.jump_lengths(gaps(s, d))), f"select user_id, datetime, round({_HOP}, 6) as value from {_LAG.format(t='gaps')}")
add("im6_nonzero_trips", lambda s, d: m.nonzero_trips(coarse(s, d)), f"select user_id, count(*) as value from {_LAG.format(t='coarse')} where {_HOP} <> 0 group by 1")
add("im7_self_transitions", lambda s, d: m.self_transitions(traj(s, d)), f"select user_id, count(*) filter (lon = plon and lat = plat) as value from {_LAG.format(t='traj')} group by 1")
add("im8_waiting_times", lambda s, d: m.waiting_times(coarse(s, d)), """, k as (select * from (select *, lead(lon) over (partition by user_id order by datetime, seq) nl from coarse) where nl is distinct from lon)
select user_id, datetime, (epoch_us(datetime) - epoch_us(lag(datetime) over (partition by user_id order by datetime, seq))) // 3600000000 as value from k""")
_CENTRE = """, centre as (select user_id, avg(lon) cx, avg(lat) cy from (select distinct user_id, lon, lat from traj) group by 1), far as (select *, sqrt((lon - cx) * (lon - cx) + (lat - cy) * (lat - cy)) d from traj join centre using (user_id))
"""
_RUNNING = "over (partition by user_id order by datetime, seq rows between unbounded preceding and current row)"
add("im9_center_of_mass", lambda s, d: rounded(m.center_of_mass(traj(s, d)), "lon", "lat"), _CENTRE + "select user_id, round(cx, 6) as lon, round(cy, 6) as lat from centre")
add("im10_radius", lambda s, d: rounded(m.radius_of_gyration(traj(s, d), False)), _CENTRE + "select user_id, round(sqrt(avg(d * d)), 6) as value from far group by 1")
add("im10_radius_evolution", lambda s, d: rounded(m.radius_of_gyration(traj(s, d))), _CENTRE + f"select user_id, datetime, round(sqrt(avg(d * d) {_RUNNING}), 6) as value from far")
add("im10_radius_compat", lambda s, d: rounded(m.radius_of_gyration(traj(s, d), compat=True)), _CENTRE + f"select user_id, datetime, round(avg(d) {_RUNNING}, 6) as value from far")
add("im11_msd_first", lambda s, d: rounded(m.mean_square_displacement(traj(s, d), time_evolution=False)), """, f as (select *, first_value(lon) over w fx, first_value(lat) over w fy from traj window w as (partition by user_id order by datetime, seq))
select user_id, round(avg((lon - fx) * (lon - fx) + (lat - fy) * (lat - fy)), 6) as value from f group by 1""")
add("im11_msd_center", lambda s, d: m.mean_square_displacement(traj(s, d), from_center=True).withColumn("value", F.round("value", 2)), _CENTRE + f"select user_id, datetime, round(avg(d * d) {_RUNNING}, 2) as value from far")
_RETURN = ", b as (select *, (epoch_us(datetime) - epoch_us(lag(datetime) over (partition by user_id, labels order by datetime, seq))) // 3600000000 as value from traj)\n"
add("im12_return_time", lambda s, d: m.return_time(traj(s, d)), _RETURN + "select user_id, datetime, value from b")
add("im12_return_time_by_place", lambda s, d: rounded(m.return_time(traj(s, d), by_place=True), "mean"), _RETURN + "select user_id, lon, lat, count(*) as n, round(avg(value), 6) as mean from b where value is not null group by 1, 2, 3")
add("im13_random_entropy", lambda s, d: rounded(m.random_entropy(traj(s, d))), "select user_id, round(log2(count(distinct labels)), 6) as value from traj group by 1")
add("im14_unc_entropy", lambda s, d: rounded(m.unc_entropy(traj(s, d))), "select user_id, round(sum(-p * log2(p)), 6) as value from (select user_id, count(*) / sum(count(*)) over (partition by user_id) p from traj group by user_id, labels) group by 1")
add("im24_stationarity", lambda s, d: rounded(m.stationarity(coarse(s, d))), "select user_id, round(avg((labels is not distinct from p)::int), 6) as value from (select *, lag(labels) over (partition by user_id order by datetime, seq) p from coarse) group by 1")
add("im25_regularity", lambda s, d: rounded(m.regularity(gaps(s, d))), "select user_id, round(count(*) / (count(distinct labels) + max((labels is null)::int)), 6) as value from gaps group by 1")
add("cm1_distances", lambda s, d: rounded(m.dist_travelling_distance(traj(s, d), n_bins=20), "bin_lo", "bin_hi", "share"),
    f", j as (select {_HOP} v from {_LAG.format(t='traj')} where {_HOP} <> 0)" + _HIST.replace("from traj", "from j").format(index="least(ceil((v - lo) / ((hi - lo) / 20)), 20)::bigint", n=20, w="((hi - lo) / 20)"))
for _how, _c in (("incoming", "i"), ("outgoing", "o"), ("all", "i + o")):
    add(f"cm2_flows_{_how}", lambda s, d, how=_how: m.flows(traj(s, d), how), _MOVES.format(t="traj") + f", f as (select lon, lat, (row_number() over (partition by user_id order by datetime, seq) > 1)::bigint i, (row_number() over (partition by user_id order by datetime desc, seq desc) > 1)::bigint o from moves) select lon, lat, cast(sum({_c}) as bigint) as flow from f group by 1, 2")

# sources
from tracksmith.sources.checkins import clean_checkins  # noqa: E402

add("io1_checkins", lambda s, d: clean_checkins(table(s, d, "raw_checkins")).select("user_id", F.unix_seconds("datetime").alias("t"), "lon", "lat", "place"), """
with t as (select id, case when regexp_full_match(trim(datetime), '[0-9]{9,11}') then try_cast(trim(datetime) as bigint)
  when datetime like '____-__-__T__:__:__Z' then epoch_us(try_strptime(datetime, '%Y-%m-%dT%H:%M:%SZ')) // 1000000
  when datetime like '____-__-__T__:__:__+__:__' or datetime like '____-__-__T__:__:__-__:__' then epoch_us(try_strptime(datetime[:19], '%Y-%m-%dT%H:%M:%S')) // 1000000 - cast(datetime[20] || '1' as integer) * (cast(datetime[21:22] as integer) * 3600 + cast(datetime[24:25] as integer) * 60)
  when datetime like '____-__-__ __:__:__' then epoch_us(try_strptime(datetime, '%Y-%m-%d %H:%M:%S')) // 1000000
  when datetime like '__/__/____ __:__' then epoch_us(try_strptime(datetime, '%d/%m/%Y %H:%M')) // 1000000 end as t,
  case when not (lat = 0 and lon = 0) and not isnan(lon) then lon end as lon, case when not (lat = 0 and lon = 0) and not isnan(lat) then lat end as lat, place from raw_checkins)
select distinct id as user_id, t, lon, lat, place from t where id is not null and t is not null""", "")

# sequences
from tracksmith.operators import generators as gn  # noqa: E402
from tracksmith.operators import model as mm  # noqa: E402
from tracksmith.operators import prediction as pd_  # noqa: E402
from tracksmith.operators import sequences as sq  # noqa: E402

_LZ = """, p as (select user_id, labels, cast(row_number() over (partition by user_id order by datetime, seq) as integer) i from coarse),
x as (select a.user_id, a.i, a.i - b.i d from p a join p b on a.user_id = b.user_id and a.labels = b.labels and b.i < a.i),
r as (select *, i - row_number() over (partition by user_id, d order by i) g from x), e as (select *, max(i) over (partition by user_id, d, g) z from r),
l as (select user_id, i, max(least(z - i + 1, d)) m from e group by 1, 2),
lz as (select p.user_id, p.i, 1 + coalesce(m, 0) as length from p left join l using (user_id, i)),
ent as (select user_id, log2(count(*)) / avg(length) s from lz group by 1)
"""
add("im17_match_lengths", lambda s, d: sq.match_lengths(coarse(s, d)), _LZ + "select user_id, i, length from lz")
add("im17_match_lengths_kernel", lambda s, d: sq.match_lengths(coarse(s, d), max_pairs=0), _LZ + "select user_id, i, length from lz")
add("im15_lz_entropy", lambda s, d: rounded(sq.lz_entropy(coarse(s, d))), _LZ + "select user_id, round(s, 6) as value from ent")
add("im19_real_entropy", lambda s, d: rounded(sq.real_entropy(coarse(s, d))), _LZ + "select user_id, round(s, 6) as value from ent")
add("im16_scaled_entropy", lambda s, d: rounded(sq.real_entropy(table(s, d, "symbol_sequences"))))
_FANO = """, q as (select n.user_id, n_locations, entropy from ({n}) n join ({s}) s on n.user_id = s.user_id),
f as (with recursive f as (select user_id, n_locations::double n, entropy s, 1.0::double / n_locations lo, 1.0::double hi, 0 k from q union all
  select user_id, n, s, case when g > s then x else lo end, case when g > s then hi else x end, k + 1 from (select *, (lo + hi) / 2 x,
    -((lo + hi) / 2 * log2((lo + hi) / 2) + case when (lo + hi) / 2 < 1 then (1 - (lo + hi) / 2) * log2(1 - (lo + hi) / 2) else 0 end) + (1 - (lo + hi) / 2) * log2(greatest(n - 1, 1)) g from f where k < 60))
  select user_id, (lo + hi) / 2 x from f where k = 60)
select user_id, n_locations, round(entropy, 6) as entropy, round(case when n_locations <= 1 or entropy <= 0 then 1 when entropy >= log2(n_locations) then 1.0 / n_locations else x end, 6) as predictability from q join f using (user_id)"""
_P = "select user_id, {e} entropy from ({i}) group by 1"
_N = "select user_id, count(distinct labels) n_locations from coarse group by 1"
_UNC = "select user_id, sum(-p * log2(p)) entropy from (select user_id, count(*) / sum(count(*)) over (partition by user_id) p from coarse group by user_id, labels) group by 1"
add("im21_random_predictability", lambda s, d: rounded(sq.random_predictability(coarse(s, d)), "entropy", "predictability"), _FANO.format(n=_N, s="select user_id, log2(count(distinct labels)) entropy from coarse group by 1"))
add("im22_unc_predictability", lambda s, d: rounded(sq.unc_predictability(coarse(s, d)), "entropy", "predictability"), _FANO.format(n=_N, s=_UNC))
add("im23_real_predictability", lambda s, d: rounded(sq.real_predictability(coarse(s, d)), "entropy", "predictability"), _LZ + _FANO.format(n=_N, s="select user_id, s entropy from ent"))


def halves(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The first 70 % of every sequence, and the rest."""
    return pd_.split(coarse(s, d).drop("seq"), 0.7)


_SEQ = """, sq as (select user_id, datetime, labels, cast(row_number() over (partition by user_id order by datetime, seq) as integer) i, count(*) over (partition by user_id) n from coarse)
"""
_HALVES = _SEQ + """, tr as (select user_id, i, labels from sq where i <= round_even(n * 0.7::double, 0)), te as (select user_id, labels, row_number() over (partition by user_id order by i) i from sq where i > round_even(n * 0.7::double, 0)),
dg as (select te.user_id, te.i, te.i - tr.i d from te join tr on te.user_id = tr.user_id and te.labels = tr.labels), tn as (select user_id, count(*) n from te group by 1)
"""
_DENSE = """, ru as (select user_id, d, i - row_number() over (partition by user_id, d order by i) r from dg), cc as (select user_id, max(c) c from (select user_id, count(*) c from ru group by user_id, d, r) group by 1)
"""
add("im26_dense", lambda s, d: rounded(sq.repeatability_dense(*halves(s, d))), _HALVES + _DENSE + "select user_id, round(greatest(coalesce(c, 0) - 1, 0) / (n - 1), 6) as value from tn left join cc using (user_id)")
add("im26_dense_kernel", lambda s, d: rounded(sq.repeatability_dense(*halves(s, d), max_pairs=0)), _HALVES + _DENSE + "select user_id, round(greatest(coalesce(c, 0) - 1, 0) / (n - 1), 6) as value from tn left join cc using (user_id)")
add("im26_dense_compat", lambda s, d: rounded(sq.repeatability_dense(*halves(s, d), compat=True)), _HALVES + _DENSE + "select user_id, round(coalesce(c, 0) - 1 / n - 1, 6) as value from tn left join cc using (user_id)")
add("im27_sparse", lambda s, d: rounded(sq.repeatability_sparse(*halves(s, d))), _HALVES + """, ab as (select user_id, a, b, len(b) m from (select user_id, list(labels order by i) a from tr group by 1) join (select user_id, list(labels order by i) b from te group by 1) using (user_id)),
lc as (with recursive lc as (select user_id, a, b, m, 0 i, list_transform(b, lambda s: 0) as r from ab union all
  select user_id, a, b, m, i + 1, list_transform(range(1, m + 1), lambda k: list_max(c[1:k])) from (select *, list_transform(range(1, m + 1), lambda j: greatest(r[j], case when b[j] = a[i + 1] then case when j = 1 then 0 else r[j - 1] end + 1 else 0 end)) c from lc where i < len(a)))
  select user_id, r[m] c from lc where i = len(a))
select user_id, round(greatest(coalesce(c, 0) - 1, 0) / (n - 1), 6) as value from tn left join lc using (user_id)""")
add("im28_equally_sparse", lambda s, d: rounded(sq.repeatability_equally_sparse(*halves(s, d))), _HALVES + "select user_id, round(greatest(coalesce(c, 0) - 1, 0) / (n - 1), 6) as value from tn left join (select user_id, max(c) c from (select user_id, count(*) c from dg group by user_id, d) group by 1) using (user_id)")
add("im29_global_alignment", lambda s, d: rounded(sq.global_alignment(*halves(s, d))), _HALVES + """, ab as (select user_id, a, b, len(a) h, len(b) m from (select user_id, list(labels order by i) a from tr group by 1) join (select user_id, list(labels order by i) b from te group by 1) using (user_id)),
al as (with recursive al as (select user_id, a, b, h, m, 0 i, list_transform(range(0, m + 1), lambda j: case when j = 0 then 0.0 else -1e9 end::double) p, list_transform(range(0, m + 1), lambda j: -1e9::double) u, list_transform(range(0, m + 1), lambda j: case when j = 0 then -1e9 else 0.0 end::double) l from ab
  union all select user_id, a, b, h, m, i + 1, p2, u2, list_transform(range(0, m + 1), lambda j: case when j = 0 then -1e9 else list_max(x2[1:j]) - case when i + 1 = h then 0 else 1 end end::double) from
  (select *, list_transform(range(0, m + 1), lambda j: greatest(p2[j + 1], u2[j + 1])) x2 from
  (select *, list_transform(range(0, m + 1), lambda j: case when j = 0 then -1e9 else greatest(p[j], u[j], l[j]) + case when b[j] = a[i + 1] then 1 else -1 end end::double) p2,
    list_transform(range(0, m + 1), lambda j: case when j = 0 then 0.0 else greatest(greatest(p[j + 1], l[j + 1]) - case when j = m then 0 else 1 end, u[j + 1]) end::double) u2 from al where i < h)))
  select user_id, greatest(p[m + 1], u[m + 1], l[m + 1]) c from al where i = h)
select user_id, round(c / (n - 1), 6) as value from tn left join al using (user_id)""")
add("im30_iterative_alignment", lambda s, d: rounded(sq.iterative_global_alignment(*halves(s, d))))

# prediction
_WINDOWS = _SEQ + """, wi as (select user_id, i as w, cast(n - 2 as bigint) m, lead(datetime, 2) over u as datetime, labels as x1, lead(labels) over u as x2, lead(labels, 2) over u as y from sq window u as (partition by user_id order by i)),
ww as (select * from wi where w <= m), sp as (select *, round_even(m * 0.8::double, 0) v from ww)
"""
add("pd2_windows", lambda s, d: pd_.windows(coarse(s, d), 2).drop("m"), _WINDOWS + "select user_id, w, datetime, x1, x2, y from ww")
add("pd1_splitter", lambda s, d: pd_.splitter(coarse(s, d), 0.2, 2, 3).select("user_id", "w", "x1", "x2", "y", "role", "fold"), _WINDOWS + """select user_id, w, x1, x2, y, 'test' as role, 0 as fold from sp where w > v union all
select user_id, w, x1, x2, y, case when w <= round_even(v * k / 4::double, 0) then 'train' else 'val' end, k from sp, (select unnest([1, 2, 3]) k) where w <= v and w <= round_even(v * (k + 1) / 4, 0)""")
add("pd5_split", lambda s, d: pd_.split(coarse(s, d), 0.8, 2)[1].select("user_id", "i", "labels"), _SEQ + "select user_id, i, labels from sq where i > greatest(round_even(n * 0.8::double, 0) - 2, 0)")
_COUNTS = _SEQ + """, tr as (select * from sq where i <= round_even(n * 0.8::double, 0)),
st as (select user_id, labels as next, []::integer[] as state from tr union all select user_id, labels, [p1] from (select *, lag(labels) over (partition by user_id order by i) p1 from tr) where p1 is not null
  union all select user_id, labels, [p2, p1] from (select *, lag(labels) over (partition by user_id order by i) p1, lag(labels, 2) over (partition by user_id order by i) p2 from tr) where p2 is not null),
mc as (select user_id, state, next, count(*) cnt from st group by 1, 2, 3), bs as (select user_id, state, next from mc qualify row_number() over (partition by user_id, state order by cnt desc, next) = 1),
te as (select *, lag(labels) over u p1, lag(labels, 2) over u p2 from sq window u as (partition by user_id order by i)),
pr as (select te.user_id, te.i, te.labels truth, coalesce(b2.next, b1.next, b0.next, -1) prediction from te left join bs b2 on b2.user_id = te.user_id and b2.state = [p2, p1] left join bs b1 on b1.user_id = te.user_id and b1.state = [p1]
  left join bs b0 on b0.user_id = te.user_id and len(b0.state) = 0 where te.i > round_even(n * 0.8::double, 0))
"""
_text = lambda df: df.withColumn("state", F.concat_ws(",", F.transform("state", lambda x: x.cast("string"))))
add("pd6_markov_counts", lambda s, d: _text(pd_.markov_counts(pd_.split(coarse(s, d), 0.8)[0], 2)), _COUNTS + "select user_id, array_to_string(state, ',') as state, next, cnt from mc")
add("pd10_normalize_chain", lambda s, d: rounded(_text(pd_.normalize_chain(pd_.markov_counts(pd_.split(coarse(s, d), 0.8)[0], 2))), "prob"), _COUNTS + "select user_id, array_to_string(state, ',') as state, next, cnt, round(cnt / sum(cnt) over (partition by user_id, state), 6) as prob from mc")
add("pd7_markov_predict", lambda s, d: pd_.markov_wrapper(coarse(s, d), 0.2, 2)[0].select("user_id", "i", "truth", "prediction"), _COUNTS + "select user_id, i, truth, prediction from pr")
add("pd11_markov_accuracy", lambda s, d: rounded(pd_.markov_wrapper(coarse(s, d), 0.2, 2)[1], "accuracy"), _COUNTS + "select user_id, round(avg((truth = prediction)::int), 6) as accuracy from pr group by 1")
add("pd7_markov_sample", lambda s, d: pd_.markov_wrapper(coarse(s, d), 0.2, 2, sample=True, seed=3)[0].select("user_id", "i", "truth", "prediction"))
add("pd9_markov_rollout", lambda s, d: pd_.markov_wrapper(coarse(s, d), 0.2, 2, online=False)[0].select("user_id", "i", "truth", "prediction"), _COUNTS + """, b2 as (select user_id, state[1] s2, state[2] s1, next from bs where len(state) = 2), b1 as (select user_id, state[1] s1, next from bs where len(state) = 1), b0 as (select user_id, next from bs where len(state) = 0),
ro as (with recursive ro as (select user_id, max(n) n, cast(max(round_even(n * 0.8::double, 0)) as bigint) i, max(labels) filter (i = round_even(n * 0.8::double, 0) - 1) p2, max(labels) filter (i = round_even(n * 0.8::double, 0)) p1 from sq group by 1
  union all select ro.user_id, n, i + 1, p1, coalesce(b2.next, b1.next, b0.next, -1) from ro left join b2 on b2.user_id = ro.user_id and b2.s2 = p2 and b2.s1 = p1 left join b1 on b1.user_id = ro.user_id and b1.s1 = p1 left join b0 on b0.user_id = ro.user_id where i < n)
  select * from ro)
select ro.user_id, cast(ro.i as integer) as i, sq.labels as truth, p1 as prediction from ro join sq on sq.user_id = ro.user_id and sq.i = ro.i where ro.i > round_even(ro.n * 0.8::double, 0)""")
add("pd16_sparse", lambda s, d: rounded(pd_.sparse_wrapper(coarse(s, d))[1], "accuracy"))
add("pd17_top_loc", lambda s, d: pd_.top_loc(*pd_.split(coarse(s, d), 0.8)).select("user_id", "i", "truth", "prediction"), _COUNTS + "select sq.user_id, sq.i, sq.labels as truth, next as prediction from sq join bs on sq.user_id = bs.user_id and len(state) = 0 where i > round_even(n * 0.8::double, 0)")
add("pd18_baseline", lambda s, d: rounded(pd_.accuracy(pd_.baseline(pd_.splitter(coarse(s, d), 0.2, 2).where("role = 'test'"))), "accuracy"), _WINDOWS + "select user_id, round(avg((x2 = y)::int), 6) as accuracy from sp where w > v group by 1")
add("pd19_classifier_search", lambda s, d: rounded(pd_.classifier_search(pd_.splitter(coarse(s, d), 0.2, 2, 3))[1], "accuracy"))
add("pd21_recurrent_network", lambda s, d: rounded(pd_.deep_pred(pd_.splitter(table(s, d, "symbol_sequences"), 0.2, 4, 1))[1], "accuracy"))
add("pd23_folds", lambda s, d: pd_.folds(pd_.windows(coarse(s, d), 2), 5).select("user_id", "w", "fold"), _WINDOWS + "select user_id, w, cast(ntile(5) over (partition by user_id order by w) as integer) as fold from ww")

# generators
_GN = "select u as user_id, to_timestamp(n * 3600) at time zone 'UTC' as datetime, cast({x} as integer) as labels from (select unnest(range(0, 20)) u), (select unnest(range(0, {n})) n)"
add("gn1_markovian", lambda s, d: gn.markovian_sequences_generator(s, 20, 10, 150, 0.7, 1))
add("gn1_all_in_turn", lambda s, d: gn.markovian_sequences_generator(s, 20, 10, 150, 1.0, 1), _GN.format(x="n % 10", n=150), "")
add("gn2_random", lambda s, d: gn.random_sequences_generator(s, 20, 10, 400, 1))
add("gn3_deterministic", lambda s, d: gn.deterministic_sequences_generator(s, 20, 7, 5), _GN.format(x="n % 7", n=35), "")
add("gn4_exploratory", lambda s, d: gn.exploratory_sequences_generator(s, 20, 30, 1))
add("gn5_self_transitions", lambda s, d: gn.self_transitions_sequences_generator(s, 20, 7, 100), _GN.format(x="n // 14", n=98), "")
add("gn6_non_stationary", lambda s, d: gn.non_stationary_sequences_generator(s, 20, 6, 3, 100, 1))


def _shape(df: DataFrame) -> DataFrame:
    """What holds of drawn sequences whatever was drawn: length, hours, range of the symbols."""
    return df.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min("datetime").alias("first"), F.max("datetime").alias("last"), F.count_distinct("datetime").alias("hours"), F.min(F.col("labels") >= 0).alias("positive"), F.max("labels").alias("top"))


_SHAPE = "select u as user_id, {n}::bigint as n, timestamp '1970-01-01' as \"first\", timestamp '1970-01-01' + to_hours({n} - 1) as \"last\", {n}::bigint as hours, true as positive{top} from (select unnest(range(0, 20)) u)"
add("gn1_shape", lambda s, d: _shape(gn.markovian_sequences_generator(s, 20, 10, 150, 0.7, 1)).drop("top"), _SHAPE.format(n=150, top=""), "")
add("gn2_shape", lambda s, d: _shape(gn.random_sequences_generator(s, 20, 10, [400], 1)).drop("top"), _SHAPE.format(n=400, top=""), "")
add("gn4_shape", lambda s, d: _shape(gn.exploratory_sequences_generator(s, 20, 30, 1)).withColumn("top", F.col("top").cast("int")), _SHAPE.format(n=30, top=", 29::integer as top"), "")
add("gn6_shape", lambda s, d: _shape(gn.non_stationary_sequences_generator(s, 20, [6], [3], 100, 1)).drop("top"), _SHAPE.format(n=100, top=""), "")

# the mobility model
_RANK = ", rk as (select user_id, labels, lon, lat, count(*) n, cast(row_number() over (partition by user_id order by count(*) desc, labels) - 1 as integer) \"rank\" from traj group by 1, 2, 3, 4)\n"
_HOME = _LAYER + _RANK + """, dd as (select a.user_id, a.lon, a.lat, sqrt((a.lon - b.lon) * (a.lon - b.lon) + (a.lat - b.lat) * (a.lat - b.lat)) d from rk a join rk b using (user_id) where a."rank" = 0 and b."rank" = 1)
"""
add("mm1_rank_freq", lambda s, d: mm.rank_freq(traj(s, d), 2), _RANK + "select user_id, \"rank\", labels, lon, lat, n from rk where \"rank\" < 2")
add("mm1_significant_places", lambda s, d: mm.significant_places(mm.rank_freq(traj(s, d), 2)), _RANK + "select user_id, " + ", ".join(f'max({c}) filter ("rank" = {r}) as {c}_{r}' for r in (0, 1) for c in ("lon", "lat")) + " from rk group by 1")
add("mm3_commute_distances", lambda s, d: rounded(mm.commute_distances(mm.rank_freq(traj(s, d), 3)), "distance"), _RANK + """select a.user_id, a."rank" as rank_a, b."rank" as rank_b, round(sqrt((a.lon - b.lon) * (a.lon - b.lon) + (a.lat - b.lat) * (a.lat - b.lat)), 6) as distance from rk a join rk b using (user_id) where a."rank" < b."rank" and b."rank" < 3""")
add("mm4_commute_density", lambda s, d: rounded(mm.commute_distances_to_2d_distribution(mm.rank_freq(traj(s, d), 2), _layer(s, d))), _HOME + "select cell_id, cx, cy, round(coalesce(m, 0), 6) as value from layer left join (select cell_id, median(d) m from dd join inside using (lon, lat) group by 1) using (cell_id)")
add("mm5_home_density", lambda s, d: rounded(mm.convert_to_2d_distribution(mm.rank_freq(traj(s, d), 2), _layer(s, d), 0)), _HOME + ", h as (select cell_id, count(*) c from rk join inside using (lon, lat) where \"rank\" = 0 group by 1) select cell_id, cx, cy, round(coalesce(c / (select sum(c) from h), 0), 6) as value from layer left join h using (cell_id)")
add("mm6_draws", lambda s, d: mm.generate_points_from_distribution(mm.convert_to_2d_distribution(mm.rank_freq(traj(s, d), 2), _layer(s, d), 0), 50, 1))
_PROFILE = _RANK + """, sl as (select t.user_id, hour(datetime) hod, case when "rank" < 2 then "rank" else 2 end slot, count(*) n from traj t join rk using (user_id, labels) group by 1, 2, 3), sh as (select *, n / sum(n) over (partition by user_id, hod) s from sl),
gr as (select user_id, cast(a as integer) slot, cast(b as integer) hod from (select distinct user_id from traj), (select unnest(range(0, 3)) a), (select unnest(range(0, 24)) b)),
pf as (select user_id, slot, hod, coalesce(s, 0) share from gr left join sh using (user_id, slot, hod))
"""
_profiles = lambda s, d: mm.circadian_profiles(traj(s, d), mm.rank_freq(traj(s, d), 2))
add("mm9_profiles", lambda s, d: rounded(_profiles(s, d), "share"), _PROFILE + "select user_id, slot, hod, round(share, 6) as share from pf")
add("mm9_clusters", lambda s, d: mm.cluster_trajectories(_profiles(s, d)))
add("mm10_rhythm", lambda s, d: rounded(mm.circadian_rhythm_extraction(_profiles(s, d), us.count_records(traj(s, d)).select("user_id", (F.col("user_id") % 3).cast("int").alias("cluster"))), "share"), _PROFILE + "select cast(user_id % 3 as integer) as cluster, slot, hod, round(avg(share), 6) as share from pf group by 1, 2, 3")


def _agents(s: SparkSession, d: str) -> DataFrame:
    places = mm.significant_places(mm.rank_freq(traj(s, d), 2))
    return places.select(F.col("user_id").alias("agent_id"), F.col("lon_0").alias("home_lon"), F.col("lat_0").alias("home_lat"), F.col("lon_1").alias("work_lon"), F.col("lat_1").alias("work_lat"))


#: The cells that meet the ellipse of home and work: one of their sides comes near the middle of the unit circle, or the middle is inside.
MET = """,
ag as (select user_id, max(lon) filter ("rank" = 0) hx, max(lat) filter ("rank" = 0) hy, max(lon) filter ("rank" = 1) wx, max(lat) filter ("rank" = 1) wy from rk group by 1),
el as (select user_id, hx, hy, case when a2 > 0 then wx - hx else 1 end dx, case when a2 > 0 then wy - hy else 0 end dy, case when a2 > 0 then a2 else 1 end a2, case when a2 > 0 then 1 else 0 end r
  from (select *, (wx - hx) * (wx - hx) + (wy - hy) * (wy - hy) a2 from ag where wx is not null)),
uv as (select user_id, cell_id, r, ((x1 - hx) * dx + (y1 - hy) * dy) / a2 u1, ((y1 - hy) * dx - (x1 - hx) * dy) / (a2 * 0.5) v1, ((x2 - hx) * dx + (y2 - hy) * dy) / a2 u2, ((y2 - hy) * dx - (x2 - hx) * dy) / (a2 * 0.5) v2 from el, sides),
ts as (select *, greatest(0, least(1, coalesce(-(u1 * (u2 - u1) + v1 * (v2 - v1)) / nullif((u2 - u1) * (u2 - u1) + (v2 - v1) * (v2 - v1), 0), 0))) t from uv),
hit as (select user_id, cell_id from ts group by 1, 2 having bool_or(pow(u1 + t * (u2 - u1), 2) + pow(v1 + t * (v2 - v1), 2) <= r)
  or count(*) filter ((v1 > 0) <> (v2 > 0) and 0 < (u2 - u1) * (0 - v1) / (v2 - v1) + u1) % 2 = 1)
select user_id as agent_id, coalesce(string_agg(cell_id::varchar, ',' order by cell_id), '') as cells from ag left join hit using (user_id) group by 1"""
add("mm8_activity_areas", lambda s, d: mm.generate_activity_areas(_agents(s, d), _layer(s, d), 0.5).select("agent_id", F.coalesce(F.array_join(F.transform("cells", lambda x: x.cast("string")), ","), F.lit("")).alias("cells")), _LAYER + _RANK + """, sides as (select cell_id, unnest([xmin, xmax, xmax, xmin]) x1, unnest([ymin, ymin, ymax, ymax]) y1, unnest([xmax, xmax, xmin, xmin]) x2, unnest([ymin, ymax, ymax, ymin]) y2 from layer)""" + MET)
add("mm14_simulation", lambda s, d: mm.fit_mobility_model(traj(s, d), _layer(s, d), agents=60, spread=0.5).generate("2024-02-01", 2, 1))
add("mm18_best_week", lambda s, d: rounded(mm.best_window(traj(s, d)), "empty"), """, h as (select distinct user_id, epoch_us(datetime) // 3600000000 h from traj), g as (select user_id, unnest(range(min(h), max(h) + 1)) h from h group by 1),
r as (select g.user_id, g.h, avg((h.h is null)::int) over w e, count(*) over w k from g left join h on g.user_id = h.user_id and g.h = h.h window w as (partition by g.user_id order by g.h rows between 167 preceding and current row))
select user_id, make_timestamp(h * 3600000000) as "end", round(e, 6) as empty from r where k = 168 qualify row_number() over (partition by user_id order by e, h) = 1""")

# further shapes, sinks and helpers
from tracksmith.operators.prediction import split_input_target  # noqa: E402
from tracksmith.sources.layers import layer as polygon_layer  # noqa: E402
from tracksmith.storage import shared_dir  # noqa: E402


def _written(s: SparkSession, d: str, how: str) -> str:
    """A folder of the session that the trajectory has just been written to."""
    path = f"{shared_dir(s)}/tracksmith-{s.sparkContext.applicationId}/{how}-{uuid.uuid4().hex}"
    t = Trajectories.from_df(traj(s, d), crs="EPSG:3857")
    {"parquet": t.write_parquet, "csv": t.write_csv, "wkt": t.write_wkt}[how](path)
    return path


add("io3_io4_parquet", lambda s, d: Trajectories.read_parquet(s, _written(s, d, "parquet")).df.select("user_id", "datetime", "lon", "lat", "labels"), "select user_id, datetime, lon, lat, labels from traj")
add("io5_wkt", lambda s, d: s.read.option("header", True).schema("user_id long, datetime string, lon double, lat double, seq long, labels int, v double, geometry string").csv(_written(s, d, "wkt")).select("seq", "datetime", "geometry"),
    "select seq, strftime(datetime, '%Y-%m-%d %H:%M:%S') as datetime, 'POINT (' || lon || ' ' || lat || ')' as geometry from traj")
add("io6_csv", lambda s, d: s.read.option("header", True).schema("user_id long, datetime timestamp_ntz, lon double, lat double, seq long, labels int, v double").csv(_written(s, d, "csv")).select("user_id", "seq", "lon", "labels"), "select user_id, seq, lon, labels from traj")
add("io7_layer", lambda s, d: rounded(polygon_layer(table(s, d, "area_layer"), "cell_id", "geometry").select("cell_id", "xmin", "ymin", "xmax", "ymax", "cx", "cy"), "xmin", "ymin", "xmax", "ymax", "cx", "cy"), """
with rings as (select cell_id, regexp_extract_all(geometry, '\\(([^()]+)\\)', 1) rs from area_layer), r as (select cell_id, unnest(range(1, len(rs) + 1)) k, rs from rings),
p as (select cell_id, k, list_transform(string_split(rs[k], ','), lambda t: string_split(trim(t), ' ')) l from r), e as (select cell_id, k, unnest(range(1, len(l))) i, l from p),
q as (select cell_id, k, l[i][1]::double x1, l[i][2]::double y1, l[i + 1][1]::double x2, l[i + 1][2]::double y2 from e),
a as (select cell_id, k, sum(x1 * y2 - x2 * y1) a, sum((x1 * y2 - x2 * y1) * (x1 + x2)) sx, sum((x1 * y2 - x2 * y1) * (y1 + y2)) sy, min(x1) x0, max(x1) x9, min(y1) y0, max(y1) y9 from q group by 1, 2),
g as (select *, sign(a) * case when k = 1 then 1 else -1 end s from a)
select cell_id, round(min(x0), 6) as xmin, round(min(y0), 6) as ymin, round(max(x9), 6) as xmax, round(max(y9), 6) as ymax, round(sum(s * sx) / (3 * sum(s * a)), 6) as cx, round(sum(s * sy) / (3 * sum(s * a)), 6) as cy from g group by 1""", "")
add("sc6_mask", lambda s, d: Trajectories.from_df(traj(s, d)).where((F.col("v") > 60) & (F.col("labels") % 2 == 0)).df.select("user_id", "seq"), "select user_id, seq from traj where v > 60 and labels % 2 = 0")


def _box_ring(s: SparkSession, d: str) -> DataFrame:
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return _layer(s, d).withColumn("c", sp.centroid(F.array(corner("xmin", "ymin"), corner("xmax", "ymin"), corner("xmax", "ymax"), corner("xmin", "ymax"))))


add("g4_centroid", lambda s, d: rounded(_box_ring(s, d).select("cell_id", F.col("c.x").alias("cx"), F.col("c.y").alias("cy")), "cx", "cy"), _LAYER + "select cell_id, round(cx, 6) as cx, round(cy, 6) as cy from layer")
add("g7_annulus", lambda s, d: traj(s, d).where(sp.in_annulus(F.hypot("lon", "lat"), F.lit(5000.0), 0.2)).select("user_id", "seq"), "select user_id, seq from traj where sqrt(lon * lon + lat * lat) between 4000 and 6000")
add("g8_ellipse", lambda s, d: traj(s, d).where(sp.in_ellipse(F.col("lon"), F.col("lat"), *(F.lit(v) for v in (2000.0, 2000.0, 7000.0, 5000.0)), 0.5)).select("user_id", "seq"),
    "select user_id, seq from traj where power(((lon - 2000) * 5000 + (lat - 2000) * 3000) / 34000000.0, 2) + power(((lat - 2000) * 5000 - (lon - 2000) * 3000) / 17000000.0, 2) <= 1")
add("pr4_average", lambda s, d: rounded(us.per_user(traj(s, d), "v", "avg")), "select user_id, round(avg(v), 6) as value from traj group by 1")
add("im20_fano", lambda s, d: us.count_records(traj(s, d)).select("user_id", F.round(sq.fano(F.col("value"), F.log2(F.col("value")) / 2), 6).alias("predictability")), """
, q as (select user_id, count(*)::double n, log2(count(*)) / 2 s from traj group by 1), f as (with recursive f as (select *, 1 / n lo, 1.0::double hi, 0 k from q union all select user_id, n, s, case when g > s then x else lo end, case when g > s then hi else x end, k + 1
  from (select *, (lo + hi) / 2 x, -((lo + hi) / 2 * log2((lo + hi) / 2) + (1 - (lo + hi) / 2) * log2(greatest(1 - (lo + hi) / 2, 1e-300))) + (1 - (lo + hi) / 2) * log2(greatest(n - 1, 1)) g from f where k < 60)) select * from f where k = 60)
select user_id, round(case when n <= 1 then 1 else (lo + hi) / 2 end, 6) as predictability from f""")


def _chunks(s: SparkSession, d: str) -> DataFrame:
    arrays = pd_.sequence(coarse(s, d)).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "labels"))), lambda x: x["labels"]).alias("a"))
    first, last = split_input_target(F.col("a"))
    text = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    return arrays.select("user_id", text(first).alias("x"), text(last).alias("y"))


add("pd24_input_target", _chunks, _SEQ + "select user_id, string_agg(labels::varchar, ',' order by i) filter (i < n) as x, string_agg(labels::varchar, ',' order by i) filter (i > 1) as y from sq group by 1")
add("mm7_candidates", lambda s, d: mm.commuting_candidates(_agents(s, d).select("agent_id", F.lit(0).cast("long").alias("cell_id"), F.col("home_lon").alias("lon"), F.col("home_lat").alias("lat")),
    _layer(s, d).withColumn("value", (F.col("cell_id") % 3).cast("double")), s.range(1).select(F.col("id").alias("cell_id"), F.lit(3000.0).alias("value")), 0.3),
    _LAYER + _RANK + "select user_id as agent_id, cell_id as work_id from rk, layer where \"rank\" = 0 and cell_id % 3 > 0 and sqrt((lon - cx) * (lon - cx) + (lat - cy) * (lat - cy)) between 2100 and 3900")
add("mm15_when", lambda s, d: rounded(mm.when(mm.circadian_rhythm_extraction(_profiles(s, d), us.count_records(traj(s, d)).select("user_id", (F.col("user_id") % 3).cast("int").alias("cluster")))), "s0", "s1", "s2"), _PROFILE + "select cast(user_id % 3 as integer) as cluster, hod, " + ", ".join(f"round(avg(share) filter (slot = {k}), 6) as s{k}" for k in range(3)) + " from pf group by 1, 2")
add("mm16_where", lambda s, d: _agents(s, d).select("agent_id", F.explode(F.array(*map(F.lit, range(3)))).alias("slot"), "home_lon", "work_lon").select("agent_id", "slot", mm.where(F.col("slot"), F.col("home_lon"), F.col("work_lon"), F.lit(None).cast("double")).alias("lon")),
    _RANK + "select user_id as agent_id, slot, case slot when 1 then coalesce(max(lon) filter (\"rank\" = 1), max(lon) filter (\"rank\" = 0)) else max(lon) filter (\"rank\" = 0) end as lon from rk, (select unnest([0, 1, 2]) slot) group by 1, 2")
