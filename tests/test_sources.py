import json

from pyspark.sql import functions as F

from tracksmith.sources.checkins import clean_checkins, parse_time
from tracksmith.sources.layers import read_geojson


def test_geojson(spark, tmp_path):
    square = [[[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]]
    holed = [*square, [[2.0, 1.0], [3.0, 1.0], [3.0, 3.0], [2.0, 3.0], [2.0, 1.0]]]
    shapes = [("Polygon", square), ("Polygon", holed), ("MultiPolygon", [square, [[[10, 0, 5], [12, 0, 5], [12, 2e0, 5], [10, 0, 5]]]]), ("Point", [1, 2])]
    features = [{"type": "Feature", "properties": {"code": str(i + 7)}, "geometry": {"type": t, "coordinates": c}} for i, (t, c) in enumerate(shapes)]
    (tmp_path / "l.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    got = {r["cell_id"]: r for r in read_geojson(spark, str(tmp_path / "l.json"), "code").collect()}
    assert sorted(got) == [7, 8, 9]
    assert (got[7]["cx"], got[7]["cy"]) == (2.0, 2.0) and (got[7]["xmax"], got[7]["ymax"]) == (4.0, 4.0)
    assert abs(got[8]["cx"] - (32 - 5) / 14) < 1e-9 and abs(got[8]["cy"] - 2) < 1e-9
    assert got[9]["xmax"] == 12.0
    assert [r["cell_id"] for r in read_geojson(spark, str(tmp_path / "l.json")).orderBy("cell_id").collect()] == [0, 1, 2]


def test_times(spark):
    texts = ["2024-03-04T00:54:54Z", "2024-03-05T05:47:19+10:00", "2024-03-04 17:50:38", "04/03/2024 20:56", "1709590856", "0000-00-00", "", None, "soon"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(F.unix_seconds(parse_time(F.col("t")))).collect()]
    assert got == [1709513694, 1709581639, 1709574638, 1709585760, 1709590856, None, None, None, None]


def test_checkins(spark):
    rows = [(1, "2024-03-04 17:50:38", 10.0, 20.0, "a")] * 2 + [(1, "2024-03-04 17:50:38", 0.0, 0.0, "a"), (None, "2024-03-04 17:50:38", 1.0, 1.0, "a"), (2, "never", 1.0, 1.0, None), (3, "1709590856", float("nan"), 1.0, None)]
    got = sorted((r["user_id"], r["lat"] is None, r["lon"] is None) for r in clean_checkins(spark.createDataFrame(rows, "id long, datetime string, lat double, lon double, place string")).collect())
    assert got == [(1, False, False), (1, True, True), (3, True, False)]


def test_layer_in_another_system_and_by_lines(spark, tmp_path):
    from tracksmith.sources.layers import to_crs

    square = [[[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]]
    lines = [json.dumps({"type": "Feature", "properties": {"code": str(i)}, "geometry": {"type": "Polygon", "coordinates": square}}) for i in range(3)]
    (tmp_path / "l.jsonl").write_text("\n".join(lines))
    layer = read_geojson(spark, str(tmp_path / "l.jsonl"), "code", lines=True)
    assert sorted(r["cell_id"] for r in layer.collect()) == [0, 1, 2]
    moved = to_crs(to_crs(layer, "EPSG:4326", "EPSG:3857"), "3857", "4326").first()
    assert abs(moved["cx"] - 2) < 1e-9 and abs(moved["xmax"] - 4) < 1e-9
