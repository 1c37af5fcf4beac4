"""Files, coordinates, reports and streams."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrace.functions import crs
from terrace.grid import UTM, GridSpec
from terrace.operators import areas, reports
from terrace.sources import tiff, vector
from terrace.streaming.scenes import windowed_means

G = GridSpec(5, 7, 10.0, 0.0, 500000.0, 0.0, -10.0, 9000000.0, 32751)


@pytest.mark.parametrize("dtype", ["uint8", "uint16", "int32", "float32"])
def test_tiff_round_trip(spark, tmp_path, dtype):
    a = (np.arange(70).reshape(5, 7, 2) % 9).astype(dtype)
    (tmp_path / "a.tif").write_bytes(tiff.encode(a, G, 0, rows=2))
    got = {(r.row, r.col): (r.b1, r.b2) for r in tiff.read_raster(spark, str(tmp_path / "a.tif"), ["b1", "b2"]).collect()}
    for r in range(5):
        for c in range(7):
            want = tuple(None if v == 0 else float(v) for v in a[r, c])
            assert got.get((r, c), (None, None)) == want
    G.assert_aligned(tiff.read_grid(spark, str(tmp_path / "a.tif")))


def test_tiles(spark):
    px = spark.createDataFrame([(r, c, 1 + (r + c) % 5) for r in range(5) for c in range(7)], "row long, col long, cls int")
    for t in tiff.raster_tiles(px, G, ["cls"], tile=4).collect():
        image = tiff.Image.of(bytes(t.content))
        (r, c, a), = image.blocks(bytes(t.content))
        assert a[0, 0, 0] == 1 + (t.tile_row * 4 + t.tile_col * 4) % 5 and image.grid.f == 9000000 - 40 * t.tile_row


def test_not_a_tiff():
    with pytest.raises(ValueError):
        tiff.Image.of(b"nothing of the kind")


def test_utm_there_and_back(spark):
    pts = spark.createDataFrame([(125.5, -8.6), (123.1, -0.2), (128.9, -40.0)], "lon double, lat double")
    x, y = crs.to_utm(F.col("lon"), F.col("lat"), 32751)
    lon, lat = crs.to_lonlat(F.col("x"), F.col("y"), 32751)
    for r in pts.withColumn("x", x).withColumn("y", y).select("*", lon.alias("lon2"), lat.alias("lat2")).collect():
        assert abs(r.lon - r.lon2) < 1e-8 and abs(r.lat - r.lat2) < 1e-8
    mid = spark.range(1).select(*crs.to_utm(F.lit(123.0), F.lit(0.0), 32651)).first()
    assert abs(mid[0] - 500000) < 1e-6 and abs(mid[1]) < 1e-6
    with pytest.raises(ValueError):
        crs.zone_of(3857)


def test_geojson(spark, tmp_path):
    features = [
        {"type": "Feature", "properties": {"id": 1, "cls": 3}, "geometry": {"type": "Point", "coordinates": [1.5, 2.5]}},
        {"type": "Feature", "properties": {"id": 2, "cls": None}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 1], [0, 0]]]}},
    ]
    (tmp_path / "f.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    a, b = sorted(vector.read_geojson(spark, str(tmp_path / "f.geojson"), "id long, cls int").collect(), key=lambda r: r.id)
    assert (a.cls, a.x, a.y, a.ring) == (3, 1.5, 2.5, None) and (b.cls, b.x, [tuple(p) for p in b.ring][1]) == (None, None, (2.0, 0.0))


def test_assessment_and_files(spark, tmp_path):
    px = spark.createDataFrame([(r, c, 1 + (c > 3)) for r in range(5) for c in range(7)], "row long, col long, cls int")
    pts = spark.createDataFrame([(k, 1 + (k % 7 > 2), 500005.0 + 10 * (k % 7), 8999995.0 - 10 * (k // 7)) for k in range(35)], "point_id long, class_id int, x double, y double")
    done = reports.assess_map(px, pts, G)
    assert done.overall.first().oa == pytest.approx(30 / 35, abs=1e-6)
    assert all(os.path.isdir(p) for p in done.save(str(tmp_path)))
    assert reports.batch_summary({"m_2020": px, "m_2015": px}, pts, G).select("year").distinct().count() == 2
    assert reports.bar_chart(areas.class_area(px, UTM))["mark"] == "bar"
    assert json.loads(reports.manifest(["a"], G, "p", "median", []))["feature_names"] == ["a"]


def test_stream_equals_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = spark.range(200).select(F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 43200).alias("ts"), (F.col("id") % 3).alias("pixel"), (F.col("id") * 1.0).alias("value"))
    rows.write.parquet(src)
    spark.range(1).select(F.timestamp_seconds(F.lit(1735689600)).alias("ts"), F.lit(9).cast("long").alias("pixel"), F.lit(0.0).alias("value")).write.mode("append").parquet(src)
    stream = windowed_means(spark.readStream.schema(rows.schema).parquet(src), ["pixel"])
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.start, r.pixel): (r.n, r["mean"]) for r in spark.read.parquet(str(tmp_path / "out")).where("pixel < 9").collect()}
    want = {(r.start, r.pixel): (r.n, r["mean"]) for r in windowed_means(rows, ["pixel"]).collect()}
    assert got == want
