"""Queries of the data-preparation problems 1, 2, 4, 6 and 7, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracksmith.functions.geo import position
from tracksmith.functions.timebins import micros
from tracksmith.operators.grid import regular_grid
from tracksmith.operators.hotkeys import heavy_keys, key_totals
from tracksmith.operators.intervals import merge_intervals
from tracksmith.operators.stops import stops_and_trips
from tracksmith.operators.spatial_join import near_and_within
from tracksmith.sources.tables import table

STOPS = "preprocessed_stops_sample"


def records(spark: SparkSession, folder: str) -> DataFrame:
    """Stay records and pings as they stand, with ``is_stay`` and the ``pos`` struct."""
    df = table(spark, folder, STOPS)
    return df.withColumns({"is_stay": F.col("start").isNotNull() | F.col("end").isNotNull(), "pos": position(F.col("lat"), F.col("lon"), F.col("geometry"))})


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    found = merge_intervals(table(spark, folder, STOPS), "user_id", "start", "end", max_gap="30 days")
    return found.select("user_id", "kind", F.unix_seconds("start").alias("start_s"), F.unix_seconds("end").alias("end_s"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return heavy_keys(table(spark, folder, STOPS), "user_id", 0.02).select("user_id")


def p2_user_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, stays, and span of each user, the hot ones in the same time as the others."""
    df = table(spark, folder, STOPS)
    seconds = lambda c: F.floor(micros(F.col(c)) / 1_000_000)
    out = key_totals(df, "user_id", {"t": seconds("datetime"), "stay": F.when(F.col("start").isNotNull() | F.col("end").isNotNull(), 1)})
    return out.select("user_id", "n", F.col("stay_n").alias("n_stays"), F.col("t_min").cast("long").alias("first_s"), F.col("t_max").cast("long").alias("last_s"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, STOPS)
    grid = regular_grid(df, "user_id", F.col("datetime"), "1 hour", F.col("start"), F.col("end"), max_gap=720, emit="missing")
    return grid.select("user_id", F.col("step").alias("hour"))


def p4_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Every hour of the table for every user: with data, missing, or outside of the user's readings."""
    df = table(spark, folder, STOPS)
    usable = F.coalesce(F.col("end") >= F.col("start"), F.lit(False))
    at = lambda c: micros(F.when(usable, F.col(c)).otherwise(F.col("datetime")))
    span = df.where(F.col("user_id").isNotNull()).agg(F.min(at("start")), F.max(at("end"))).first()
    bounds = tuple(F.timestamp_micros(F.lit(us).cast("long")) for us in span)
    grid = regular_grid(df, "user_id", F.col("datetime"), "1 hour", F.col("start"), F.col("end"), bounds=bounds, emit="all")
    return grid.select("user_id", F.col("step").alias("hour"), "state")


def p6_stops_and_trips(spark: SparkSession, folder: str) -> DataFrame:
    """Stops and trips with duration, number of pings, middle and length of path."""
    pings = records(spark, folder).where(~F.col("is_stay") & F.col("pos").isNotNull())
    return stops_and_trips(pings, "user_id", "datetime", F.col("pos.lat"), F.col("pos.lon"), order="id")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    found = p6_stops_and_trips(spark, folder)
    return found.select("user_id", "kind", F.unix_seconds("start").alias("start_s"), F.unix_seconds("end").alias("end_s"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    stays = records(spark, folder).where(F.col("is_stay") & F.col("pos").isNotNull())
    found = near_and_within(
        stays, "id", F.col("pos.lat"), F.col("pos.lon"), table(spark, folder, "area_layer"), "cell_id", "geometry",
        table(spark, folder, "landmarks"), "landmark_id", "lat", "lon", 100.0,
    )
    return found.replace({"region": "cell", "point": "landmark"}, subset=["target_kind"])


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_user_totals": p2_user_totals, "p4_found": p4_found, "p4_grid": p4_grid, "p6_found": p6_found, "p6_stops_and_trips": p6_stops_and_trips, "p7_found": p7_found}

#: Records with their positions (``la``, ``lo``) in SQL, each id once.
POSITIONS = r"""
with raw as (select *, try_cast(regexp_extract(geometry, '(?i)point\s*z?\s*\(\s*([-+0-9.eE]+)\s+([-+0-9.eE]+)', 1) as double) x,
  try_cast(regexp_extract(geometry, '(?i)point\s*z?\s*\(\s*([-+0-9.eE]+)\s+([-+0-9.eE]+)', 2) as double) y from preprocessed_stops_sample),
how as (select *, case when lat between 10 and 15 and lon between 139 and 144 then 1 when lon between 10 and 15 and lat between 139 and 144 then 2
  when y between 10 and 15 and x between 139 and 144 then 3 when x between 10 and 15 and y between 139 and 144 then 4 end p from raw),
pos as (select distinct on (id) id, user_id, datetime, "date", "start" is not null or "end" is not null as is_stay,
  case p when 1 then lat when 2 then lon when 3 then y when 4 then x end as la, case p when 1 then lon when 2 then lat when 3 then x when 4 then y end as lo from how)
"""
_APART = "2 * 6371008.8 * asin(least(1, sqrt(power(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * power(sin(radians({d} - {b}) / 2), 2))))"


def apart(a: str, b: str, c: str, d: str) -> str:
    """Great-circle distance in SQL between latitude a, longitude b and latitude c, longitude d."""
    return _APART.format(a=a, b=b, c=c, d=d)


#: Sides of the polygons of ``area_layer`` in SQL.
SIDES = """rings as (select cell_id, xmin, ymin, xmax, ymax, unnest(regexp_extract_all(geometry, '\\(([^()]+)\\)', 1)) ring from area_layer),
pts as (select cell_id, xmin, ymin, xmax, ymax, ring, list_transform(string_split(ring, ','), lambda t: string_split(trim(t), ' ')) l from rings),
edges as (select cell_id, xmin, ymin, xmax, ymax, unnest(range(1, len(l))) i, l from pts),
sides as (select cell_id, xmin, ymin, xmax, ymax, l[i][1]::double x1, l[i][2]::double y1, l[i + 1][1]::double x2, l[i + 1][2]::double y2 from edges)"""

SQL = {
    "p1_found": """
with u as (select distinct user_id, epoch_us("start") s, epoch_us("end") e from preprocessed_stops_sample where user_id is not null and "end" >= "start"),
m as (select *, max(e) over (partition by user_id order by s, e rows between unbounded preceding and 1 preceding) p from u),
g as (select *, sum(case when p is null or s > p then 1 else 0 end) over (partition by user_id order by s, e) r from m),
p as (select user_id, min(s) s, max(e) e from g group by user_id, r),
q as (select *, lead(s) over (partition by user_id order by s) n from p)
select user_id, 'period' as kind, s // 1000000 as start_s, e // 1000000 as end_s from p
union all select user_id, 'gap', e // 1000000, n // 1000000 from q where n - e <= 2592000000000""",
    "p2_found": """
select user_id from preprocessed_stops_sample where user_id is not null group by user_id
having count(*) >= 0.02 * (select count(*) from preprocessed_stops_sample)""",
    "p2_user_totals": """
select user_id, count(*) as n, count(coalesce("start", "end")) as n_stays, min(epoch_us(datetime)) // 1000000 as first_s, max(epoch_us(datetime)) // 1000000 as last_s
from preprocessed_stops_sample group by user_id""",
    "p4_found": """
with r as (select user_id, case when "end" >= "start" then epoch_us("start") else epoch_us(datetime) end // 3600000000 a,
  case when "end" >= "start" then epoch_us("end") else epoch_us(datetime) end // 3600000000 b from preprocessed_stops_sample where user_id is not null),
c as (select user_id, a, max(b) b from r group by 1, 2),
w as (select user_id, max(b) over (partition by user_id order by a) t, lead(a) over (partition by user_id order by a) n from c)
select user_id, unnest(range(t + 1, n)) as hour from w where n - t - 1 between 1 and 720""",
    "p4_grid": """
with r as (select user_id, case when "end" >= "start" then epoch_us("start") else epoch_us(datetime) end // 3600000000 a,
  case when "end" >= "start" then epoch_us("end") else epoch_us(datetime) end // 3600000000 b from preprocessed_stops_sample where user_id is not null),
u as (select user_id, min(a) f, max(b) l from r where a is not null group by 1), s as (select min(f) lo, max(l) hi from u),
d as (select distinct user_id, unnest(range(a, b + 1)) as hour from r where a is not null),
g as (select user_id, f, l, unnest(range(lo, hi + 1)) as hour from u, s)
select g.user_id, g.hour, case when d.hour is not null then 'reading' when g.hour between f and l then 'missing' else 'outside' end as state
from g left join d on g.user_id = d.user_id and g.hour = d.hour""",
    "p7_found": POSITIONS
    + """, st as (select id, la, lo from pos where is_stay and la is not null),
""" + SIDES + """
select id, 'cell' as target_kind, cell_id as target_id from st join sides on lo between xmin and xmax and la between ymin and ymax
where (y1 > la) <> (y2 > la) and lo < (x2 - x1) * (la - y1) / (y2 - y1) + x1 group by id, cell_id having count(*) % 2 = 1
union all select id, 'landmark', landmark_id from st join landmarks m on m.lat between la - 0.001 and la + 0.001 and m.lon between lo - 0.001 and lo + 0.001 where """
    + apart("la", "lo", "m.lat", "m.lon")
    + " <= 100",
}
