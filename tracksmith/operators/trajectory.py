"""The trajectory table: columns ``user_id, datetime, lon, lat`` and whatever else, with its coordinate system.

Covers reading, schema rules, selection and projection. x is always the longitude or easting and y the latitude or
northing, by name and never by position.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracksmith.functions.geo import from_mercator, to_mercator
from tracksmith.functions.projections import known, reprojected

KEYS = ("user_id", "datetime", "lon", "lat")


class UnsupportedCrs(ValueError):
    """A system other than EPSG:4326, EPSG:3857, UTM (326zz, 327zz) and the British grid (27700) was asked for."""


def in_time(df: DataFrame, descending: bool = False):
    """Window over a user's records in order of time; ``seq`` breaks ties where the table has it."""
    names = ["datetime", *(["seq"] if "seq" in df.columns else [])]
    return Window.partitionBy("user_id").orderBy(*(F.desc(n) if descending else F.asc(n) for n in names))


def up_to_now(df: DataFrame):
    return in_time(df).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def infer_datetime(columns: list[str], first_row: dict) -> list[str]:
    """SC1: time columns: ``datetime``, else ``time``, else by the look of the first row: a timestamp, or a date and a time of day."""
    for name in ("datetime", "time"):
        if name in columns:
            return [name]
    date = re.compile(r"\d{1,4}[/-]\d{1,2}[/-]\d{1,4}")
    clock = re.compile(r"\d{1,2}:\d{2}(:\d{2})?")
    text = {c: str(first_row.get(c)) for c in columns}
    both = [c for c in columns if date.search(text[c]) and clock.search(text[c])]
    if both:
        return both[:1]
    found = [next((c for c in columns if p.search(text[c])), None) for p in (date, clock)]
    if found[0] is None:
        raise ValueError("no time column found; name it")
    return [c for c in found if c is not None]


def infer_geometry(dtypes: list[tuple[str, str]]) -> tuple[str, str] | None:
    """SC2: longitude and latitude columns: exact names before parts of names, else the only two doubles, else none."""
    names = [n for n, _ in dtypes]
    pick = lambda part: next((n for n in names if n.lower() == part), None) or next((n for n in names if part in n.lower()), None)
    lon, lat = pick("lon"), pick("lat")
    if lon and lat:
        return lon, lat
    doubles = [n for n, t in dtypes if t == "double"]
    return (doubles[0], doubles[1]) if len(doubles) == 2 else None


def infer_id(names: list[str]) -> str:
    """SC3: the user column: exact names before the first name that contains ``id``; nothing is guessed from the data."""
    for exact in ("user_id", "userid", "uid", "user", "id"):
        for n in names:
            if n.lower() == exact:
                return n
    for n in names:
        if "id" in n.lower():
            return n
    raise ValueError("no user column found; name it")


@dataclass(frozen=True)
class Trajectories:
    """A trajectory DataFrame and its coordinate system. Every method returns a new one."""

    df: DataFrame
    crs: str = "EPSG:4326"

    @staticmethod
    def from_df(df: DataFrame, user: str | None = None, time: str | None = None, x: str | None = None, y: str | None = None, crs: str = "EPSG:4326", columns: dict[str, str] | None = None) -> Trajectories:
        """IO2, SC10: wrap a table. What is not named is found by the rules above; without coordinates they are 0."""
        for old, new in (columns or {}).items():
            df = df.withColumnRenamed(old, new)
        names = df.columns
        user = user or infer_id(names)
        if time:
            times = [time]
        else:
            found = [n for n in ("datetime", "time") if n in names]
            times = found[:1] or infer_datetime(names, (df.first() or {}) and df.first().asDict())
        geometry = (x, y) if x and y else infer_geometry([(n, t) for n, t in df.dtypes if n not in (user, *times)])
        taken = {user, *times, *(geometry or ())}
        stamp = F.col(times[0]) if len(times) == 1 else F.concat_ws(" ", *times)
        if dict(df.dtypes)[times[0]] == "string" or len(times) > 1:
            stamp = F.try_to_timestamp(stamp)
        lon, lat = (F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in geometry) if geometry else (F.lit(0.0), F.lit(0.0))
        rest = [F.col(n) for n in names if n not in taken and n not in KEYS]
        return Trajectories(df.select(F.col(user).alias("user_id"), stamp.alias("datetime"), lon.alias("lon"), lat.alias("lat"), *rest), crs)

    @staticmethod
    def read_csv(spark: SparkSession, path: str, names: list[str] | None = None, sep: str = ",", header: bool = True, schema: str | None = None, nrows: int | None = None, usecols: list[str] | None = None, **wrap) -> Trajectories:
        """IO1: a delimited file with or without header. A first column without name is the user's where no other name tells it."""
        reader = spark.read.option("sep", sep).option("header", header)
        df = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
        if header and not names and df.columns[0] in ("", "_c0") and "user" not in wrap and not any("id" in c.lower() or c.lower() == "user" for c in df.columns):
            wrap["user"] = df.columns[0]
        if names:
            df = df.toDF(*names[: len(df.columns)])
            for missing in names[len(df.columns) :]:
                df = df.withColumn(missing, F.lit(None).cast("string"))
        if usecols:
            df = df.select(*usecols)
        return Trajectories.from_df(df.limit(nrows) if nrows is not None else df, **wrap)

    @staticmethod
    def read_parquet(spark: SparkSession, path: str) -> Trajectories:
        """IO4"""
        df = spark.read.parquet(path)
        return Trajectories(df, df.schema["lon"].metadata.get("crs", "EPSG:4326"))

    def write_parquet(self, path: str, mode: str = "errorifexists") -> None:
        """IO3; the system is kept in the metadata of ``lon``."""
        self.df.withMetadata("lon", {"crs": self.crs}).write.mode(mode).parquet(path)

    def write_csv(self, path: str, mode: str = "errorifexists") -> None:
        """IO6"""
        self.df.write.mode(mode).option("header", True).csv(path)

    def write_wkt(self, path: str, mode: str = "errorifexists") -> None:
        """IO5: text with the point as WKT and the time as text, row by row; for tools that read neither Parquet nor doubles."""
        point = F.format_string("POINT (%s %s)", F.col("lon").cast("string"), F.col("lat").cast("string"))
        when = F.date_format("datetime", "yyyy-MM-dd HH:mm:ss")
        self.df.withColumns({"datetime": when, "geometry": F.when(F.col("lon").isNotNull() & F.col("lat").isNotNull(), point)}).write.mode(mode).option("header", True).csv(path)

    def write_geojson(self, path: str, mode: str = "errorifexists") -> None:
        """IO5: a GeoJSON feature in every line, in longitude and latitude on WGS 84; no geometry where coordinates are missing."""
        df = self.to_crs("EPSG:4326").df
        point = F.when(F.col("lon").isNotNull() & F.col("lat").isNotNull(), F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")))
        rest = F.struct(*(c for c in df.columns if c not in ("lon", "lat")))
        df.select(F.lit("Feature").alias("type"), point.alias("geometry"), rest.alias("properties")).write.mode(mode).option("ignoreNullFields", False).json(path)

    def with_df(self, df: DataFrame) -> Trajectories:
        """SC12, SC13: the same system over another table."""
        return replace(self, df=df)

    def uloc(self, users) -> Trajectories:
        """SC4, SC7: records of one user, of several, or of those in a table's ``user_id``."""
        if isinstance(users, DataFrame):
            return self.with_df(self.df.join(users.select("user_id").distinct(), "user_id", "left_semi"))
        several = isinstance(users, Iterable) and not isinstance(users, str)
        return self.with_df(self.df.where(F.col("user_id").isin(list(users)) if several else F.col("user_id") == users))

    def get_users(self) -> DataFrame:
        """SC5"""
        return self.df.select("user_id").distinct()

    def where(self, condition: Column | str) -> Trajectories:
        """SC6"""
        return self.with_df(self.df.where(condition))

    def dropna(self, columns: list[str] | None = None) -> Trajectories:
        """SC9: without the rows that miss one of the columns; the key columns unless told otherwise."""
        return self.with_df(self.df.na.drop("any", subset=columns or list(KEYS)))

    def drop_duplicates(self, columns: list[str] | None = None) -> Trajectories:
        """SC8"""
        return self.with_df(self.df.dropDuplicates(columns))

    def nth(self, first: int, last: int | None = None) -> Trajectories:
        """SC11: each user's records from place ``first`` to ``last`` in time, from 0; negative places count from the end."""
        df = self.df.withColumns({"_a": F.row_number().over(in_time(self.df)) - 1, "_z": -F.row_number().over(in_time(self.df, descending=True))})
        place = lambda n: F.col("_a") if n >= 0 else F.col("_z")
        kept = df.where((place(first) >= first) & (place(first if last is None else last) <= (first if last is None else last)))
        return self.with_df(kept.drop("_a", "_z"))

    def to_crs(self, dest_crs: str, cur_crs: str | None = None) -> Trajectories:
        """G1: coordinates in another system: EPSG:4326, EPSG:3857, UTM on WGS 84, and the British grid (within some metres)."""
        code = lambda c: re.sub(r"\D", "", str(c))
        here, there = code(cur_crs or self.crs), code(dest_crs)
        if here == there:
            return replace(self, crs=f"EPSG:{there}")
        if not (known(here) and known(there)):
            raise UnsupportedCrs(f"from {here} to {there}")
        if {here, there} != {"4326", "3857"}:
            moved = self.df.withColumn("_p", reprojected(F.col("lon"), F.col("lat"), here, there))
            return replace(self, df=moved.withColumns({"lon": F.col("_p.lon"), "lat": F.col("_p.lat")}).drop("_p"), crs=f"EPSG:{there}")
        x, y = (to_mercator if there == "3857" else from_mercator)(F.col("lon"), F.col("lat"))
        return replace(self, df=self.df.withColumns({"lon": x, "lat": y}), crs=f"EPSG:{there}")
