"""Polygons with holes and parts, lines, and files of them, against plain code."""

import json
import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from terrace.functions import geometry
from terrace.grid import GridSpec
from terrace.operators import raster, reports, sampling
from terrace.sources import shapefile, vector

G = GridSpec(12, 14, 10.0, 0.0, 500000.0, 0.0, -10.0, 9000000.0, 32751)


def _box(u, v, w, h, back=False):
    ring = [(500000.0 + 10 * (u + a * w), 9000000.0 - 10 * (v + b * h)) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))]
    return ring[::-1] if back else ring


HOLED = [_box(1, 1, 10, 10), _box(4, 4, 6, 6, True)]  # 100 pixels less 36
SHAPES = [
    ("Polygon", HOLED), ("MultiPolygon", [[_box(0, 0, 3, 2)], [_box(5, 5, 4, 4), _box(6, 6, 2, 2, True)]]), ("LineString", [(500003.0, 8999998.0), (500078.0, 8999961.0)]),
    ("Point", (500015.0, 8999985.0)), ("MultiLineString", [[(500000.5, 8999999.0), (500000.5, 8999981.0)], [(500131.0, 8999884.0), (500139.0, 8999884.0)]]), ("MultiPoint", [(500005.0, 8999995.0), (500025.0, 8999985.0)]), None,
]


def _features():
    return [{"type": "Feature", "properties": {"id": k, "name": f"n{k} é", "kind": k % 3 or None}, "geometry": s and {"type": s[0], "coordinates": s[1]}} for k, s in enumerate(SHAPES)]


def _file(spark, tmp_path, features, name="f.geojson"):
    (tmp_path / name).write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    return vector.read_geojson(spark, str(tmp_path / name), "id long, name string, kind int")


def _plain_inside(shape, x, y):
    odd = False
    for ring in [r for part in shape for r in part]:
        for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]]):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                odd = not odd
    return odd


def test_kinds_of_features(spark, tmp_path):
    df = _file(spark, tmp_path, _features())
    got = {r.id: r for r in df.collect()}
    assert [got[k].geometry and got[k].geometry.kind for k in range(7)] == ["polygon", "polygon", "line", "point", "line", "point", None]
    assert got[0].ring is None and got[3].x == 500015.0 and got[1].x is None and len(got[1].geometry.parts) == 2
    pixels = {k: 0 for k in range(7)} | {r.id: r["count"] for r in sampling.polygon_pixels(df.select("id", "geometry"), G).groupBy("id").count().collect()}
    assert pixels == {0: 64, 1: 6 + 16 - 4, 2: 0, 3: 0, 4: 0, 5: 0, 6: 0}
    bad = _features()[:1] + [{"type": "Feature", "properties": {"id": 9}, "geometry": {"type": "Circle", "coordinates": [1, 2]}}]
    with pytest.raises(Exception, match="unknown kind of geometry: Circle"):
        _file(spark, tmp_path, bad, "bad.geojson").collect()


def test_features_there_and_back(spark, tmp_path):
    df = _file(spark, tmp_path, _features())
    vector.write_features(df, str(tmp_path / "out"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    (tmp_path / "again.geojson").write_text(json.dumps({"features": lines}))
    again = vector.read_geojson(spark, str(tmp_path / "again.geojson"), "id long, name string, kind int")
    assert sorted(again.collect(), key=lambda r: r.id) == sorted(df.collect(), key=lambda r: r.id)
    assert vector.area_of_interest(spark, str(tmp_path / "f.geojson"))[:2] == (500000.0, 8999884.0)


def test_stretches_equal_every_centre(spark):
    rnd = random.Random(4)
    ring = lambda x, y, r, n: [(x + r * rnd.uniform(0.3, 1) * math.cos(2 * math.pi * k / n), y + r * rnd.uniform(0.3, 1) * math.sin(2 * math.pi * k / n)) for k in range(n)]
    shapes = {k: [[ring(500000 + rnd.uniform(-20, 150), 9000000 - rnd.uniform(-20, 130), rnd.uniform(5, 80), rnd.randint(3, 12)) for _ in range(rnd.randint(1, 3))] for _ in range(rnd.randint(1, 2))] for k in range(30)}
    df = spark.createDataFrame([(k, ("polygon", s)) for k, s in shapes.items()], f"k int, geometry {geometry.GEOMETRY}")
    want = {(k, r, c) for k, s in shapes.items() for r in range(12) for c in range(14) if _plain_inside(s, 500005.0 + 10 * c, 8999995.0 - 10 * r)}
    assert {(r.k, r.row, r.col) for r in sampling.polygon_pixels(df, G).collect()} == want
    inner = sampling.with_interior_point(df).select("*", geometry.contains(F.col("geometry"), F.col("x"), F.col("y")).alias("ok")).collect()
    assert all(r.ok and _plain_inside(shapes[r.k], r.x, r.y) for r in inner)


def test_lines_touch_what_they_pass(spark):
    rnd = random.Random(7)
    lines = {k: [(500000 + rnd.uniform(-30, 170), 9000000 - rnd.uniform(-30, 150)) for _ in range(rnd.randint(2, 5))] for k in range(20)}
    df = spark.createDataFrame([(k, ("line", [[s]])) for k, s in lines.items()], f"k int, geometry {geometry.GEOMETRY}")
    got = {(r.k, r.row, r.col) for r in raster.rasterize_touched(df, G).collect()}
    want = set()
    for k, s in lines.items():
        for (ax, ay), (bx, by) in zip(s, s[1:]):
            for t in range(20_001):
                c, r = math.floor((ax + (bx - ax) * t / 20_000 - 500000) / 10), math.floor((9000000 - ay - (by - ay) * t / 20_000) / 10)
                if 0 <= r < 12 and 0 <= c < 14:
                    want.add((k, r, c))
    assert want <= got and len(got - want) <= 2  # a corner that is cut by less than a step of the plain walk
    away = spark.createDataFrame([(1, ("line", [[[(0.0, 0.0), (5.0, 5.0)]]]))], f"k int, geometry {geometry.GEOMETRY}")
    with pytest.raises(ValueError, match="no features"):
        raster.distance_features({"road": away}, G)
    road = spark.createDataFrame([(("line", [[[(500005.0, 9000000.0), (500005.0, 8999880.0)]]]),)], f"geometry {geometry.GEOMETRY}")
    assert all(r.road == 10.0 * r.col for r in raster.distance_features({"road": road}, G).collect())


def test_samples_of_geometries(spark, tmp_path):
    df = _file(spark, tmp_path, _features()).withColumn("class_id", F.col("id").cast("int") + 1).withColumnRenamed("id", "point_id")
    px = spark.createDataFrame([(r, c, 1 + (c >= 4)) for r in range(12) for c in range(14)], "row long, col long, cls int")
    shapes = df.where("geometry.kind <> 'line'")
    done = {mode: reports.assess_map(px, shapes, G, mode=mode, area=False).samples for mode in ("majority", "all_pixels", "centroid")}
    assert {r.ref_class: r.map_class for r in done["majority"].collect()} == {1: 2, 2: 2, 4: 1, 6: 1}
    assert done["all_pixels"].groupBy("ref_class").count().count() == 4 and done["all_pixels"].count() == 64 + 18 + 1 + 2
    assert done["centroid"].count() == 4
    assert sampling.load_and_extract(px, shapes, G, bands=["cls"]).count() == 85
    with pytest.raises(Exception, match="lines hold no pixels"):
        sampling.polygon_samples(df.select("point_id", "class_id", "geometry"), px, G, poly="point_id").collect()
    lonlat = sampling.to_grid(df.select("point_id", "geometry"), 32751, GridSpec(1, 1, 1.0, 0.0, 0.0, 0.0, -1.0, 0.0, 4326))
    back = sampling.to_grid(lonlat, 4326, G).collect()
    for a, b in zip(sorted(back), sorted(df.select("point_id", "geometry").collect()), strict=True):
        flat = lambda g: [v for p in g.parts for r in p for q in r for v in q]
        assert a.geometry == b.geometry or flat(a.geometry) == pytest.approx(flat(b.geometry), abs=1e-3)


def _shapefile(at, features, deleted=()):
    """A plain writer: one kind of shape in a file; rings of polygons as they are."""
    shp, shx, rows = b"", b"", b""
    for k, f in enumerate(features):
        g = f["geometry"]
        if g is None:
            body = struct.pack("<i", 0)
        elif g["type"] == "Point":
            body = struct.pack("<i2d", 11, *g["coordinates"]) + struct.pack("<2d", 7.0, 8.0)
        elif g["type"] == "MultiPoint":
            pts = g["coordinates"]
            body = struct.pack("<i4di", 8, 0, 0, 0, 0, len(pts)) + b"".join(struct.pack("<2d", *p) for p in pts)
        else:
            rings = {"Polygon": lambda c: c, "MultiPolygon": lambda c: [r for p in c for r in p], "LineString": lambda c: [c], "MultiLineString": lambda c: c}[g["type"]](g["coordinates"])
            pts = [p for r in rings for p in r]
            body = struct.pack("<i4d2i", 5 if "Polygon" in g["type"] else 3, 0, 0, 0, 0, len(rings), len(pts))
            body += b"".join(struct.pack("<i", sum(map(len, rings[:i]))) for i in range(len(rings))) + b"".join(struct.pack("<2d", *p) for p in pts)
        shx += struct.pack(">2i", (100 + len(shp)) // 2, len(body) // 2)
        shp += struct.pack(">2i", k + 1, len(body) // 2) + body
        p = f["properties"]
        name = p["name"].encode()
        rows += (b"*" if k in deleted else b" ") + f"{p['id']:>8}".encode() + name + b" " * (12 - len(name)) + (f"{p['kind']:>4}".encode() if p["kind"] else b"    ") + (b"20240229" if k % 2 else b" " * 8) + (b"T" if k % 2 else b"F")
    head = lambda n: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + n) // 2) + struct.pack("<2i8d", 1000, 5, *[0.0] * 8)
    fields = b"".join(n.ljust(11, b"\0") + t + bytes(4) + bytes([w, 0]) + bytes(14) for n, t, w in ((b"id", b"N", 8), (b"name", b"C", 12), (b"kind", b"N", 4), (b"day", b"D", 8), (b"ok", b"L", 1)))
    (at.parent / (at.name + ".shp")).write_bytes(head(len(shp)) + shp)
    (at.parent / (at.name + ".shx")).write_bytes(head(len(shx)) + shx)
    (at.parent / (at.name + ".dbf")).write_bytes(struct.pack("<4BIHH20x", 3, 124, 1, 1, len(features), 33 + len(fields), 34) + fields + b"\r" + rows + b"\x1a")
    return str(at) + ".shp"


def test_shapefile_equals_geojson(spark, tmp_path):
    for k, kinds in enumerate((("Polygon", "MultiPolygon"), ("LineString", "MultiLineString"), ("Point",), ("MultiPoint",))):
        features = [f for f in _features() if f["geometry"] is None or f["geometry"]["type"] in kinds] * 3
        features = [{**f, "properties": {**f["properties"], "id": i}} for i, f in enumerate(features)]
        path = _shapefile(tmp_path / f"s{k}", features, deleted=(1,))
        got = shapefile.read_shapefile(spark, path, "id long, name string, kind int", task_records=2)
        want = _file(spark, tmp_path, [f for i, f in enumerate(features) if i != 1], f"w{k}.geojson")
        assert got.rdd.getNumPartitions() == -(-len(features) // 2)
        assert sorted(got.collect(), key=lambda r: r.id) == sorted(want.collect(), key=lambda r: r.id)
    row = shapefile.read_shapefile(spark, path, "day date, ok boolean, name int").where("ok").first()
    assert str(row.day) == "2024-02-29" and row["name"] is None
    with pytest.raises(ValueError, match="no attributes"):
        shapefile.read_shapefile(spark, path, "nothing int")
    with pytest.raises(ValueError, match="unknown kind of shape: 31"):
        shapefile.shape_of(struct.pack("<i", 31))


def test_names_are_the_first(spark):
    ref = spark.createDataFrame([(2, "b"), (1, "z"), (1, "a"), (1, " "), (None, "x")], "class_id int, name string").coalesce(1)
    assert reports.class_names_of(ref, "class_id", "name") == {1: "z", 2: "b"}
