import json
from datetime import datetime

import numpy as np
import pytest

from tracksmith.functions.projections import projection, reproject
from tracksmith.operators.trajectory import Trajectories, UnsupportedCrs, infer_datetime, infer_geometry, infer_id

ROWS = [
    "5,2020-01-01 00:00:00,1.0,530000.5,180000.25,0,2020-01-01 00:00:00,2020-01-01 01:00:00,POINT (530000.5 180000.25)",
    "5,2020-01-01 01:00:00,2.0,530100.5,180100.25,1,2020-01-01 01:00:00,2020-01-01 02:00:00,POINT (530100.5 180100.25)",
    "5,2020-01-01 02:00:00,,,,,,,POINT (nan nan)",
    "7,2020-01-01 00:00:00,1.0,530000.5,180000.25,0,2020-01-01 00:00:00,2020-01-01 01:00:00,POINT (530000.5 180000.25)",
]
NAMES = ["user_id", "datetime", "temp", "lat", "lon", "labels", "start", "end", "geometry"]
WANT = [(5, datetime(2020, 1, 1, 0), 180000.25, 530000.5), (5, datetime(2020, 1, 1, 1), 180100.25, 530100.5), (7, datetime(2020, 1, 1, 0), 180000.25, 530000.5)]


@pytest.mark.parametrize("variant", ["header", "unnamed", "no header", "no geometry"])
def test_read_from_file(spark, tmp_path, variant):
    path = str(tmp_path / "t.csv")
    lines = [r.rsplit(",", 1)[0] for r in ROWS] if variant == "no geometry" else ROWS
    with open(path, "w") as f:
        f.write("\n".join(([("id" if variant == "header" else "") + ",time,temp,lat,lon,labels,start,end,geometry"] if variant in ("header", "unnamed") else []) + lines) + "\n")
    t = Trajectories.read_csv(spark, path, names=None if variant in ("header", "unnamed") else NAMES, header=variant in ("header", "unnamed"), crs="EPSG:27700")
    got = sorted(tuple(r[:4]) for r in t.dropna().df.select("user_id", "datetime", "lon", "lat").collect())
    assert got == WANT and t.crs == "EPSG:27700"
    assert "labels" in t.df.columns and "start" in t.df.columns


def test_single_row_is_parsed_and_missing_coordinates_are_zero(spark):
    t = Trajectories.from_df(spark.createDataFrame([("a", "2020-05-01", "12:30:00")], "uid string, day string, clock string"))
    assert [tuple(r) for r in t.df.collect()] == [("a", datetime(2020, 5, 1, 12, 30), 0.0, 0.0)]


def test_to_crs_and_back(spark):
    df = spark.createDataFrame([(1, "2020-01-01", 139.5, 10.5), (1, "2020-01-02", 0.0, 0.0)], "user_id long, datetime string, lon double, lat double")
    there = Trajectories.from_df(df).to_crs("3857")
    assert there.crs == "EPSG:3857"
    x, y = there.df.orderBy("datetime").first()[2:4]
    assert abs(x - 15529068.96) < 1 and abs(y - 1175547.1) < 200
    back = [tuple(r[2:4]) for r in there.to_crs("EPSG:4326").df.orderBy("datetime").collect()]
    assert all(abs(a - b) < 1e-9 for p, q in zip(back, [(139.5, 10.5), (0.0, 0.0)]) for a, b in zip(p, q))
    with pytest.raises(UnsupportedCrs):
        there.to_crs("EPSG:2154")


def test_transverse_mercator():
    # the worked example of the British grid's guide, on its own datum
    x, y = projection("27700").forward(np.float64(1 + 43 / 60 + 4.5177 / 3600), np.float64(52 + 39 / 60 + 27.2531 / 3600))
    assert abs(x - 651_409.903) < 0.002 and abs(y - 313_177.270) < 0.002
    # on the central meridian of a UTM zone, and a quarter of the meridian
    assert np.allclose(projection("32631").forward(np.float64(3.0), np.float64(0.0)), (500_000.0, 0.0))
    assert abs(projection("32631").forward(np.float64(3.0), np.float64(89.9999))[1] - 0.9996 * (10_001_965.729 - 11.1694)) < 0.05
    lon, lat = np.meshgrid(np.linspace(-6, 2, 9), np.linspace(50, 60, 6))
    for code in ("27700", "32630", "32730"):
        there = reproject(lon, lat, "4326", code)
        assert np.allclose(reproject(*there, code, "4326"), (lon, lat), atol=1e-7, rtol=0)


def test_british_grid_to_mercator(spark):
    df = spark.createDataFrame([(1, "2020-01-01", 530000.5, 180000.25), (1, "2020-01-02", None, None)], "user_id long, datetime string, lon double, lat double")
    t = Trajectories.from_df(df, crs="EPSG:27700").to_crs("EPSG:3857")
    got = [tuple(r[2:4]) for r in t.df.orderBy("datetime").collect()]
    # Westminster, known to some metres
    assert t.crs == "EPSG:3857" and abs(got[0][0] + 14_287) < 10 and abs(got[0][1] - 6_710_933) < 10 and got[1] == (None, None)
    back = t.to_crs("EPSG:27700").df.orderBy("datetime").first()
    assert abs(back["lon"] - 530000.5) < 1e-3 and abs(back["lat"] - 180000.25) < 1e-3


def test_write_geojson(spark, tmp_path):
    df = spark.createDataFrame([(1, "2020-01-01", 1.5, 2.5, "x"), (2, "2020-01-01", None, None, None)], "user_id long, datetime string, lon double, lat double, note string")
    Trajectories.from_df(df).write_geojson(str(tmp_path / "g"))
    lines = sorted((json.loads(r[0]) for r in spark.read.text(str(tmp_path / "g")).collect()), key=lambda f: f["properties"]["user_id"])
    assert lines[0]["geometry"] == {"type": "Point", "coordinates": [1.5, 2.5]} and lines[0]["properties"]["note"] == "x"
    assert lines[1]["geometry"] is None and lines[1]["type"] == "Feature"


def test_round_trip_keeps_the_crs(spark, tmp_path):
    df = spark.createDataFrame([(1, "2020-01-01", 1.0, 2.0)], "user_id long, datetime string, lon double, lat double")
    Trajectories.from_df(df, crs="EPSG:3857").write_parquet(str(tmp_path / "p"))
    back = Trajectories.read_parquet(spark, str(tmp_path / "p"))
    assert back.crs == "EPSG:3857" and back.df.count() == 1
    back.write_wkt(str(tmp_path / "w"))
    assert spark.read.option("header", True).csv(str(tmp_path / "w")).first()["geometry"] == "POINT (1.0 2.0)"


def test_nth_and_uloc(spark):
    df = spark.createDataFrame([(u, f"2020-01-0{k}", float(k), 0.0) for u in (1, 2) for k in range(1, 4)] + [(3, "2020-01-01", 9.0, 0.0)], "user_id long, datetime string, lon double, lat double")
    t = Trajectories.from_df(df)
    at = lambda x: sorted(tuple(r) for r in x.df.select("user_id", "lon").collect())
    assert at(t.nth(0)) == [(1, 1.0), (2, 1.0), (3, 9.0)]
    assert at(t.nth(-1)) == [(1, 3.0), (2, 3.0), (3, 9.0)]
    assert at(t.nth(1, -2)) == [(1, 2.0), (2, 2.0)]
    assert at(t.uloc(3)) == at(t.uloc([3])) == at(t.uloc(spark.createDataFrame([(3,)], "user_id long"))) == [(3, 9.0)]


def test_rules():
    assert infer_id(["x", "userID", "idx"]) == "userID"
    assert infer_geometry([("a", "double"), ("b", "double"), ("c", "string")]) == ("a", "b")
    assert infer_geometry([("my_lon", "string"), ("lat", "double"), ("lon", "double")]) == ("lon", "lat")
    assert infer_datetime(["d", "h"], {"d": "2020/01/02", "h": "10:00:00"}) == ["d", "h"]
    with pytest.raises(ValueError):
        infer_id(["x", "y"])
