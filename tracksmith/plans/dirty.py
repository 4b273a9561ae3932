"""The mobility operators over the dirty tables: hourly bins without places, sequences with missing labels, real polygons.

Most queries are those of ``plans.reference`` over another trajectory. On the Spark side they always get the table with its
repeated rows taken out and its nulls left in; the SQL says for each what nulls do: ``traj`` and ``coarse`` have all rows
for statistics of records, and only those with a place or label for measures of places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracksmith.functions.timebins import micros
from tracksmith.operators import measures as m
from tracksmith.operators import model as mm
from tracksmith.operators import sequences as sq
from tracksmith.operators import spatial as sp
from tracksmith.operators import statistics as us
from tracksmith.plans import reference as r
from tracksmith.plans.preparation import POSITIONS, SIDES, records
from tracksmith.plans.reference import Binned, Symbols, rounded
from tracksmith.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_BINNED = """with gaps as (select distinct user_id, datetime at time zone 'UTC' as datetime, epoch_us(datetime) // 3600000000 as seq, labels, lon, lat, temp as v,
  "start" at time zone 'UTC' as "start", "end" at time zone 'UTC' as "end" from aggregated_trajectory),
traj as (select * from gaps{}), coarse as (select * from traj), stays as (select * from gaps where "start" is not null)
"""
ALL, PLACED = _BINNED.format(""), _BINNED.format(" where lon is not null")
_SYMBOLS = """with gaps as (select distinct user_id, datetime at time zone 'UTC' as datetime, epoch_us(datetime) // 3600000000 as seq, labels from symbol_sequences),
coarse as (select * from gaps where labels is not null)
"""


def over(source: type, prefix: str, base: str, *names: str) -> None:
    for name in names:
        QUERIES[f"{prefix}_{name}"] = lambda s, d, query=r.QUERIES[name]: query(s, source(d))
        SQL[f"{prefix}_{name}"] = base + r.SQL[name].removeprefix(r.TRAJ)


def add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name], SQL[name] = query, sql


over(Binned, "binned", ALL, "us1_fraction_empty", "us2_count_records", "us3_records_per_frame", "us4_duration", "us4_occupied", "us5_consecutive", "us6_max", "us7_min", "us8_mean",
     "pr3_rowwise_average", "pr4_average", "pr5_normalise", "pr6_expansion", "pr8_normalize", "pr9_total_normalise", "pr10_start_end", "sc5_users", "sc6_mask", "sc7_quality_filter", "sc8_drop_duplicates",
     "sc9_dropna", "sc11_inner_records", "mm18_best_week", "sp10_moving_average", "im1_distinct_locations", "im2_visitation_frequency", "im5_jump_lengths", "im25_regularity", "pr2_mode",
     "fi1_ffill", "fi1_bfill", "sp8_labels", "ta1_overlap", "ta1_reference_rule", "ta1_filled", "io3_io4_parquet")
over(Binned, "binned", PLACED, "mobility_profile", "pr7_distribution", "fi2_next_location", "fi4_stop_detection", "sp4_create_grid", "im3_distinct_over_time", "im4_first_visits", "im6_nonzero_trips",
     "im7_self_transitions", "im9_center_of_mass", "im10_radius", "im10_radius_evolution", "im10_radius_compat", "im11_msd_first", "im11_msd_center", "im12_return_time", "im12_return_time_by_place",
     "im13_random_entropy", "im14_unc_entropy", "im24_stationarity", "cm1_distances", "cm2_flows_incoming", "cm2_flows_outgoing", "cm2_flows_all", "mm1_rank_freq", "mm1_significant_places",
     "mm3_commute_distances")
over(Symbols, "symbols", _SYMBOLS, "im17_match_lengths", "im17_match_lengths_kernel", "im24_stationarity", "im26_dense", "im26_dense_kernel", "im26_dense_compat", "im27_sparse", "im28_equally_sparse",
     "pd1_splitter", "pd2_windows", "pd5_split", "pd6_markov_counts", "pd7_markov_predict", "pd10_normalize_chain", "pd11_markov_accuracy", "pd17_top_loc", "pd18_baseline", "pd23_folds",
     "pd24_input_target", "pd9_markov_rollout", "im29_global_alignment")

add("binned_im8_waiting_times", lambda s, d: m.waiting_times(r.coarse(s, Binned(d))), PLACED + """, k as (select * from (select *, lead(lon) over w nx, lead(lat) over w ny from traj window w as (partition by user_id order by datetime)) where nx is distinct from lon or ny is distinct from lat)
select user_id, datetime, (epoch_us(datetime) - epoch_us(lag(datetime) over (partition by user_id order by datetime))) // 3600000000 as value from k""")
add("binned_sp1_grid", lambda s, d: sp.GridAggregation(2000.0).aggregate(r.traj(s, Binned(d))).select("user_id", "seq", "lon", "lat", "labels"),
    PLACED + r._CELLS + r._FIRST.format(t="grid") + "select user_id, seq, lon, lat, l.labels from grid join l using (lon, lat) union all select user_id, seq, null, null, null from gaps where lon is null")
add("binned_us2_count_labels", lambda s, d: us.count_records(r.traj(s, Binned(d)), "labels"), ALL + "select user_id, count(labels) as value from traj group by 1")
add("binned_im24_compat", lambda s, d: rounded(m.stationarity(r.traj(s, Binned(d)), compat=True)),
    PLACED + "select user_id, round(sum((labels is not distinct from p)::int) / (count(*) * 7), 6) as value from (select *, lag(labels) over (partition by user_id order by datetime) p from traj where v is not null and \"start\" is not null and \"end\" is not null) group by 1")
add("binned_sp5_compat", lambda s, d: sp.ClusteringAggregator(kwargs={"eps": 400.0, "min_samples": 4}).aggregate(r.traj(s, Binned(d)), compat=True).select("user_id", "datetime", "labels", F.round("lon", 6).alias("lon")), PLACED + """
, c as (select user_id, lon, lat, count(*) c, min(datetime) f from traj group by 1, 2, 3), k as (select user_id, lon, lat, cast(row_number() over (partition by user_id order by f) - 1 as integer) k from c where c >= 4)
select g.user_id, g.datetime, k as labels, case when k is not null then round(g.lon, 6) end as lon from gaps g left join k on k.user_id = g.user_id and k.lon = g.lon and k.lat = g.lat""")
_NULLS = "select user_id, count(distinct labels) + max((labels is null)::int) n_locations from gaps group by 1"
_SHARES = "select user_id, sum(-p * log2(p)) entropy from (select user_id, count(*) / sum(count(*)) over (partition by user_id) p from traj group by user_id, lon, lat) group by 1"
add("binned_im21_random_predictability", lambda s, d: rounded(sq.random_predictability(r.traj(s, Binned(d))), "entropy", "predictability"),
    PLACED + r._FANO.format(n=_NULLS, s="select user_id, log2(count(distinct (lon, lat))) entropy from traj group by 1"))
add("binned_im22_unc_predictability", lambda s, d: rounded(sq.unc_predictability(r.traj(s, Binned(d))), "entropy", "predictability"), PLACED + r._FANO.format(n=_NULLS, s=_SHARES))
# the length counts the missing symbols too
add("symbols_im15_lz_entropy", lambda s, d: rounded(sq.lz_entropy(r.coarse(s, Symbols(d)))),
    _SYMBOLS + r._LZ + "select user_id, round(case when count(labels) > 0 then log2(count(*)) / (select avg(length) from lz where lz.user_id = gaps.user_id) end, 6) as value from gaps group by user_id")
# up to 15 % missing the entropy is that of the symbols that are there, beyond 90 % there is none; between it is fitted (see the tests)
_DIRECT = _SYMBOLS + r._LZ + """, q as (select user_id, count(*) n, count(labels) k from gaps group by 1)
select user_id, round(log2(n) / (select avg(length) from lz where lz.user_id = q.user_id), 6) as value from q where 1 - k / n < 0.15 union all select user_id, null from q where 1 - k / n > 0.9 or k = 0"""


def _direct(s: SparkSession, d: str) -> DataFrame:
    """IM19 of the users for whom nothing is fitted: the whole table goes through the operator, the others are left out of the result."""
    df = r.coarse(s, Symbols(d))
    missing = df.groupBy("user_id").agg((1 - F.count("labels") / F.count(F.lit(1))).alias("q")).where("q < 0.15 or q > 0.9")
    return rounded(sq.real_entropy(df).join(missing.select("user_id"), "user_id", "left_semi"))


add("symbols_im19_direct", _direct, _DIRECT)

# real polygons: visits of users and the cells of area_layer, some with holes, not always boxes
_AREA = POSITIONS + """, traj as (select user_id, datetime at time zone 'UTC' as datetime, id as seq, lo as lon, la as lat from pos where is_stay and la is not null and user_id is not null and id is not null),
""" + SIDES + """,
inside as (select lon, lat, min(cell_id) cell_id from (select lon, lat, cell_id from (select distinct lon, lat from traj) join sides on lon between xmin and xmax and lat between ymin and ymax
  where (y1 > lat) <> (y2 > lat) and lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 group by 1, 2, 3 having count(*) % 2 = 1) group by 1, 2)
"""  # fmt: skip


def visits(s: SparkSession, d: str) -> DataFrame:
    rows = records(s, d).where(F.col("is_stay") & F.col("pos").isNotNull() & F.col("user_id").isNotNull() & F.col("id").isNotNull()).dropDuplicates(["id"])
    return rows.select("user_id", F.timestamp_micros(micros(F.col("datetime"))).cast("timestamp_ntz").alias("datetime"), F.col("id").alias("seq"), F.col("pos.lon").alias("lon"), F.col("pos.lat").alias("lat"))


def area(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "area_layer")


def homes(s: SparkSession, d: str) -> DataFrame:
    """Two most frequent cells of each user, at the cells' middles."""
    return mm.rank_freq(sp.LayerAggregator(area(s, d)).aggregate(visits(s, d)).withColumn("labels", F.col("cell_id")), 2)


add("area_sp7_layer", lambda s, d: sp.LayerAggregator(area(s, d)).aggregate(visits(s, d)).select("user_id", "seq", "cell_id", "lon", "lat"),
    _AREA + "select user_id, seq, cell_id, cx as lon, cy as lat from traj join inside using (lon, lat) join area_layer using (cell_id)")
add("area_sp7_layer_left", lambda s, d: sp.LayerAggregator(area(s, d)).aggregate(visits(s, d), drop_unmatched=False).select("user_id", "seq", "cell_id", "lon", "lat"),
    _AREA + "select user_id, seq, cell_id, cx as lon, cy as lat from traj left join inside using (lon, lat) left join area_layer using (cell_id)")
add("area_sp11_filter_layer", lambda s, d: sp.filter_layer(area(s, d), visits(s, d)).select("cell_id", "cx", "cy"), _AREA + "select cell_id, cx, cy from area_layer where cell_id in (select cell_id from inside)")
add("area_g6_located", lambda s, d: sp.locate(visits(s, d), area(s, d)), _AREA + "select lon, lat, cell_id from inside")
_RANKED = _AREA + """, rk as (select user_id, cell_id as labels, cx as lon, cy as lat, count(*) n, cast(row_number() over (partition by user_id order by count(*) desc, cell_id) - 1 as integer) "rank"
  from traj join inside using (lon, lat) join area_layer using (cell_id) group by 1, 2, 3, 4),
hm as (select lon, lat, min(cell_id) cell_id from (select lon, lat, cell_id from (select distinct lon, lat from rk where "rank" = 0) join sides on lon between xmin and xmax and lat between ymin and ymax
  where (y1 > lat) <> (y2 > lat) and lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 group by 1, 2, 3 having count(*) % 2 = 1) group by 1, 2)
"""
add("area_mm1_rank_freq", homes, _RANKED + "select user_id, \"rank\", labels, lon, lat, n from rk where \"rank\" < 2")
add("area_mm5_home_density", lambda s, d: rounded(mm.convert_to_2d_distribution(homes(s, d), area(s, d), 0)),
    _RANKED + ", h as (select cell_id, count(*) c from rk join hm using (lon, lat) where \"rank\" = 0 group by 1) select cell_id, cx, cy, round(coalesce(c / (select sum(c) from h), 0), 6) as value from area_layer left join h using (cell_id)")
add("area_mm4_commute_density", lambda s, d: rounded(mm.commute_distances_to_2d_distribution(homes(s, d), area(s, d))), _RANKED + """, dd as (select a.lon, a.lat, sqrt((a.lon - b.lon) * (a.lon - b.lon) + (a.lat - b.lat) * (a.lat - b.lat)) d from rk a join rk b using (user_id) where a."rank" = 0 and b."rank" = 1)
select cell_id, cx, cy, round(coalesce(m, 0), 6) as value from area_layer left join (select cell_id, median(d) m from dd join hm using (lon, lat) group by 1) using (cell_id)""")


def _agents(s: SparkSession, d: str) -> DataFrame:
    places = mm.significant_places(homes(s, d))
    return places.select(F.col("user_id").alias("agent_id"), F.col("lon_0").alias("home_lon"), F.col("lat_0").alias("home_lat"), F.col("lon_1").alias("work_lon"), F.col("lat_1").alias("work_lat"))


add("area_mm8_activity_areas", lambda s, d: mm.generate_activity_areas(_agents(s, d), area(s, d), 0.5).select("agent_id", F.coalesce(F.array_join(F.transform("cells", lambda x: x.cast("string")), ","), F.lit("")).alias("cells")), _RANKED.rstrip("\n") + r.MET)
_CLASSES = "cast(floor(hour(datetime) / 6) as integer)"
add("area_mm9_profiles_by_part_of_day", lambda s, d: rounded(mm.circadian_profiles(_labelled(s, d), homes(s, d), length=168, aux_cols=("part",)), "share"), _RANKED + f""", t as (select traj.user_id, {_CLASSES}::varchar combo, epoch_us(datetime) // 3600000000 % 168 hod, coalesce("rank", 2) slot
  from traj join inside using (lon, lat) left join (select * from rk where "rank" < 2) k on k.user_id = traj.user_id and k.labels = inside.cell_id),
c as (select user_id, hod, combo, slot, count(*) / sum(count(*)) over (partition by user_id, hod) s from t group by 1, 2, 3, 4),
g as (select user_id, combo, slot, unnest(range(168)) hod from (select distinct user_id from t), (select distinct combo from t), (select unnest([0, 1, 2]) slot))
select user_id, slot, cast(hod as integer) as hod, combo, round(coalesce(s, 0), 6) as share from g left join c using (user_id, combo, slot, hod)""")


def _labelled(s: SparkSession, d: str) -> DataFrame:
    return sp.LayerAggregator(area(s, d)).aggregate(visits(s, d)).withColumns({"labels": F.col("cell_id"), "part": F.floor(F.hour("datetime") / 6).cast("int")})
