"""Equal-area projections, layers of several grids in one stack, and calls that had no test."""

import json
import math

import pytest
from pyspark.sql import functions as F

from terrace.functions import crs
from terrace.grid import UTM, GridSpec
from terrace.operators import raster, reports, sampling, timeseries
from terrace.sources import vector

PLACES = [(125.5, -8.6), (119.0, -20.0), (131.2, 3.3), (125.0, -15.0)]


@pytest.mark.parametrize("code", [102028, 102022, 102025, 6933])
def test_there_and_back(spark, code):
    df = spark.createDataFrame(PLACES, "lon double, lat double")
    x, y = crs.reproject(F.col("lon"), F.col("lat"), 4326, code)
    lon, lat = crs.reproject(F.col("x"), F.col("y"), code, 4326)
    for r in df.withColumns({"x": x, "y": y}).withColumns({"lon2": lon, "lat2": lat}).collect():
        assert abs(r.lon - r.lon2) < 1e-9 and abs(r.lat - r.lat2) < 5e-8  # some millimetres


def test_known_places_and_equal_areas(spark):
    at = lambda lon, lat, code: spark.range(1).select(*crs.reproject(F.lit(lon), F.lit(lat), 4326, code)).first()
    assert at(125.0, -15.0, 102028) == pytest.approx((0, 0), abs=1e-6)
    assert at(180.0, 85.0445664, 6933) == pytest.approx((17367530.445, 7314540.831), abs=0.02)  # the published corner of the global grid
    for code in (102028, 6933):  # a small box has the area of the ellipsoid there
        lon, lat, d = 126.0, -9.0, 1e-4
        (x0, y0), (x1, y1), (x2, y2) = at(lon - d, lat - d, code), at(lon + d, lat - d, code), at(lon - d, lat + d, code)
        e2 = 0.0066943799901
        w = 1 - e2 * math.sin(math.radians(lat)) ** 2
        want = math.radians(2 * d) ** 2 * 6378137.0**2 * math.cos(math.radians(lat)) * (1 - e2) / w**2
        assert abs((x1 - x0) * (y2 - y0) - (x2 - x0) * (y1 - y0)) == pytest.approx(want, rel=1e-5)
    with pytest.raises(ValueError, match="neither"):
        at(1.0, 1.0, 3857)


def test_stack_of_several_systems(spark):
    utm = GridSpec(20, 20, 30.0, 0.0, 500000.0, 0.0, -30.0, 9_050_000.0, 32751)
    x, y = (spark.range(1).select(*crs.reproject(F.lit(500000.0), F.lit(9_050_000.0), 32751, 4326)).first())
    lonlat = GridSpec(60, 60, 0.0001, 0.0, x, 0.0, -0.0001, y, 4326)
    band = spark.createDataFrame([(r, c, float(r + c)) for r in range(20) for c in range(20)], "row long, col long, value double")
    classes = spark.createDataFrame([(r, c, 1.0 + 10 * (r >= 30) + (c >= 30)) for r in range(60) for c in range(60)], "row long, col long, value double")
    layers = [raster.Layer("band", band, utm), raster.Layer("cls", classes, lonlat)]
    got = raster.stack_layers(layers, nearest=["cls"]).collect()
    assert len(got) == 400 and {r.cls for r in got if r.cls is not None} == {1.0, 2.0, 11.0, 12.0}
    here = spark.createDataFrame([(r.row, r.col, r.cls) for r in got], "row long, col long, cls double")
    lon, lat = crs.reproject(*utm.centre_of(F.col("row"), F.col("col")), 32751, 4326)
    row, col = lonlat.pixel_of(lon, lat)
    inside = here.withColumns({"r": row, "c": col}).where(lonlat.inside(F.col("r"), F.col("c")))
    assert inside.where("cls <> 1.0 + CASE WHEN r >= 30 THEN 10 ELSE 0 END + CASE WHEN c >= 30 THEN 1 ELSE 0 END OR cls IS NULL").count() == 0 and inside.count() > 300
    mixed, names, _ = raster.create_feature_stack(layers, nearest=["cls"])
    assert names == ["band", "cls"] and {r.cls for r in mixed.collect() if r.cls is not None} == {1.0, 2.0, 11.0, 12.0}
    for bad in (lambda: raster.stack_layers([]), lambda: raster.stack_layers(layers, nearest=["x"]), lambda: raster.create_feature_stack(layers, nearest=["x"]), lambda: raster.stack_layers(layers[:1] * 2)):
        with pytest.raises(ValueError):
            bad()


def test_seasons_of_radar(spark):
    rows = [("p", f"2024-{m:02d}-10 00:00:00", mode, pols, v) for m, mode, pols, v in ((1, "IW", ["VV", "VH"], 1.0), (12, "IW", ["VV"], 3.0), (7, "IW", ["VV"], 8.0), (7, "EW", ["VV"], 99.0), (2, "IW", ["VH"], 77.0))]
    df = spark.createDataFrame(rows, "pixel string, ts string, mode string, polarisations array<string>, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    assert [tuple(r) for r in timeseries.seasonal_radar(df, ["pixel"]).select("pixel", "wet", "dry").collect()] == [("p", 2.0, 8.0)]


def test_points_of_any_file(spark, tmp_path):
    (tmp_path / "p.csv").write_text("id,cls\n1,4\n2,\n")
    (tmp_path / "p.geojson").write_text(json.dumps({"features": [{"properties": {"id": k, "cls": c}, "geometry": {"type": "Point", "coordinates": [1, 2]}} for k, c in ((1, 4), (2, None))]}))
    for name in ("p.csv", "p.geojson"):
        got = vector.read_points(spark, str(tmp_path / name), "id long, cls int")
        assert got.columns == ["id", "cls"] and sorted(map(tuple, got.collect())) == [(1, 4), (2, None)]


def test_random_split(spark):
    df = spark.range(5000).withColumnRenamed("id", "point_id")
    split = sampling.bernoulli_split(df, "point_id", 0.6)
    n = split.where("is_train").count()
    assert 2800 < n < 3200 and split.count() == 5000
    assert {r.point_id for r in split.where("is_train").collect()} == {r.point_id for r in sampling.bernoulli_split(df.repartition(7), "point_id", 0.6).where("is_train").collect()}
    assert sampling.bernoulli_split(df, "point_id", 0.6, seed=1).where("is_train").exceptAll(split.where("is_train")).count() > 0


def test_flow_pages_and_area_reports(spark, tmp_path):
    links = spark.createDataFrame([("2015-2020", 1, 2, 30.0), ("2015-2020", 1, 99, 60.0)], "interval string, source int, target int, area_ha double")
    page = reports.sankey_html(links, {1: "Forest", 2: "Crop <b>"})
    data = json.loads(page.split("const d=")[1].split(";const m")[0])
    assert [(d["source"], d["target"], d["area_ha"]) for d in data] == [("Forest", "99", 60.0), ("Forest", "Crop <b>", 30.0)] and "http" not in page
    px = spark.createDataFrame([(r, c, 1 + c % 2) for r in range(4) for c in range(5)], "row long, col long, cls int")
    table = reports.class_area_report(px, UTM, names={1: "a", 2: "b"}, csv=str(tmp_path / "csv"), chart=str(tmp_path / "chart"))
    back = spark.read.option("header", True).option("inferSchema", True).csv(str(tmp_path / "csv"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, table.collect()))
    assert json.loads(spark.read.text(str(tmp_path / "chart")).first()[0])["mark"] == "bar"
