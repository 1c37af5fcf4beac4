"""Seams of several bands, fractional spikes, full assessments, feature stacks, distances, wide rasters in files, exact quantiles."""

import json
import math
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrace.grid import UTM, GridSpec
from terrace.operators import accuracy, areas, components, focal, fusion, learning, outliers, quantiles, raster, reports, sampling, transitions
from terrace.schema import IMPOSSIBLE, TRAJECTORIES
from terrace.sources import tiff, vector

G = GridSpec(12, 14, 10.0, 0.0, 500000.0, 0.0, -10.0, 9000000.0, 32751)


def _pixels(spark, a, kind="int", name="cls"):
    return spark.createDataFrame([(r, c, x) for r, line in enumerate(a) for c, x in enumerate(line)], f"row long, col long, {name} {kind}")


def test_seams_take_the_whole_vector_of_one_pixel(spark):
    nan = float("nan")
    a = [[[0.2, 0.8], [nan, 0.0], [0.6, 0.4]], [[0.0, 0.5], [0.0, 0.0], [0.1, 0.9]]]
    got = {(r.row, r.col): r.p for r in focal.heal_seams(_pixels(spark, a, "array<double>", "p"), value="p").collect()}
    assert got[0, 1] == [0.2, 0.8] and got[1, 1] == [0.0, 0.5] and got[1, 0] == [0.0, 0.5]
    two = _pixels(spark, [[(1, 2), (0, 0), (3, 4)]], "struct<a:int,b:int>", "s").select("row", "col", "s.a", "s.b")
    assert [(r.a, r.b) for r in focal.heal_seams(two, value=["a", "b"]).orderBy("col").collect()] == [(1, 2), (1, 2), (3, 4)]


def test_spikes_of_fractional_probabilities(spark):
    a = [[[0.3, 0.3, 0.4]] * 5 for _ in range(5)]
    a[2] = [list(x) for x in a[2]]
    a[2][2] = [0.4, 0.2, 0.4]
    got = {(r.row, r.col): r.p for r in focal.heal_spikes(_pixels(spark, a, "array<double>", "p"), bands=3).collect()}
    assert got[2, 2] == pytest.approx([0.3, 0.3, 0.4]) and got[1, 1] == [0.3, 0.3, 0.4]


def test_windows_do_not_depend_on_tiles(spark):
    rng = random.Random(1)
    a = [[[rng.random() for _ in range(3)] for _ in range(13)] for _ in range(11)]
    px = _pixels(spark, a, "array<double>", "p")
    key = lambda df, c: {(r.row, r.col): r[c] for r in df.collect()}
    one, many = (key(focal.bayesian_smooth(px, smoothness={7: 1.0, 8: 2.0, 9: 3.0}, classes=[7, 8, 9], window=5, tile=t), "p") for t in (256, 4))
    assert set(one) == set(many) and len(one) == 143 and all(one[k] == pytest.approx(many[k]) for k in one)
    assert all(sum(p) == pytest.approx(1) for p in one.values())
    same = key(focal.bayesian_smooth(px, smoothness=2.0, classes=[1, 2, 3], window=3), "p")
    assert same == key(focal.bayesian_smooth(px, smoothness=[2.0, 2.0, 2.0], window=3), "p")
    var = key(focal.local_variance(px, window=3), "var")
    assert len(var) == 143 and all(v > 0 for x in var.values() for v in x)
    for bad in ({7: 1.0}, [1.0], float("nan")):
        with pytest.raises(ValueError, match="smoothness"):
            focal.bayesian_smooth(px, smoothness=bad, classes=[7, 8])


def test_distance_equals_brute_force(spark):
    rng = random.Random(2)
    a = [[int(rng.random() < 0.05) for _ in range(40)] for _ in range(23)]
    got = {(r.row, r.col): r.distance for r in focal.distance_to(_pixels(spark, a), F.col("cls") == 1, 10.0, 7.0).collect()}
    holds = [(r, c) for r in range(23) for c in range(40) if a[r][c]]
    for (r, c), d in got.items():
        assert d == pytest.approx(min(math.hypot((c - x) * 10, (r - y) * 7) for y, x in holds))
    assert len(got) == 23 * 40


def test_exact_quantiles(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "LAST", 20)
    monkeypatch.setattr(quantiles, "STEPS", 8)
    rng = np.random.default_rng(3)
    x = {"a": np.concatenate([rng.normal(size=500), [1e12, -5.0]]), "b": np.repeat([1.0, 2.0], [300, 41]), "c": np.array([3.0])}
    df = spark.createDataFrame([(g, float(v)) for g, vs in x.items() for v in vs] + [("a", float("nan")), ("d", None)], "g string, v double")
    got = quantiles.exact_quantiles(df, F.col("g"), F.col("v"), (0.02, 0.5, 0.99))
    assert set(got) == {"a", "b", "c"}
    for g, vs in x.items():
        assert got[g] == pytest.approx(list(np.quantile(vs, (0.02, 0.5, 0.99))))


def test_interior_points_and_scan_lines(spark):
    rings = {1: [(0, 0), (10, 0), (10, -50), (60, -50), (60, -60), (0, -60)], 2: [(0, 0), (100, 0), (50, -90)], 3: [(5, -5), (65, -5), (65, -65), (45, -65), (45, -25), (25, -25), (25, -65), (5, -65)]}
    df = spark.createDataFrame([(k, [(500000.0 + x, 9000000.0 + y) for x, y in [*r, r[0]]]) for k, r in rings.items()], "k int, ring array<struct<x:double,y:double>>")
    for r in sampling.with_interior_point(df).select("k", sampling.in_ring(F.col("x"), F.col("y"), F.col("ring")).alias("ok")).collect():
        assert r.ok
    cells = spark.range(12 * 14).select(F.floor(F.col("id") / 14).alias("row"), (F.col("id") % 14).alias("col"))
    px, py = G.centre_of(F.col("row"), F.col("col"))
    want = {(r.k, r.row, r.col) for r in df.crossJoin(cells).where(sampling.in_ring(px, py, F.col("ring"))).collect()}
    assert {(r.k, r.row, r.col) for r in sampling.polygon_pixels(df, G).collect()} == want


def test_assessment_with_everything(spark, tmp_path):
    px = _pixels(spark, [[1 + (c > 6) for c in range(14)] for _ in range(12)])
    pts = spark.createDataFrame([(k, 1 + (k % 14 > 5), 500005.0 + 10 * (k % 14), 8999995.0 - 10 * (k // 14), "yes" if k % 2 else "no", "wood") for k in range(168)], "point_id long, class_id int, x double, y double, use string, name string")
    done = reports.assess_map(px, pts, G, filter_col="use", filter_value="yes", name_col="name", labels=[1, 2, 3], mapping={1: 2, 2: 3}, folder=str(tmp_path))
    assert {r.cls: r.class_name for r in done.classes.collect()} == {2: "wood", 3: "Class_3"}
    assert {(r.ref_class, r.map_class) for r in done.samples.collect()} == {(3, 3)}  # 1 to 2 in one step, then 2 to 3
    plain = reports.assess_map(px, pts, G, name_col="name", names={2: "field"})
    row = plain.overall.first()
    assert row.n == 168 and row.num_classes == 2 and row.f1_micro == row.oa == pytest.approx(156 / 168, abs=1e-6)
    area = {r.cls: r for r in plain.adjusted.collect()}
    assert area[1].class_name == "wood" and area[2].class_name == "field"
    assert sum(r.area_ha for r in area.values()) == pytest.approx(1.68) and sum(r.pixels for r in area.values()) == pytest.approx(168) and area[1].mapped_km2 == pytest.approx(84 * 100 / 1e6)
    for bad in (dict(filter_col="use", filter_value="maybe"), dict(label="nothing"), dict(filter_col="nothing")):
        with pytest.raises(ValueError):
            reports.assess_map(px, pts, G, **bad)
    ring = [(500000.0, 9000000.0), (500060.0, 9000000.0), (500060.0, 8999950.0), (500000.0, 8999950.0), (500000.0, 9000000.0)]
    poly = spark.createDataFrame([(1, 1, ring)], "point_id long, class_id int, ring array<struct<x:double,y:double>>")
    assert [reports.assess_map(px, poly, G, mode=m, area=False).samples.count() for m in ("majority", "all_pixels", "centroid")] == [1, 30, 1]


def test_change_in_one_call(spark):
    rng = random.Random(5)
    px = spark.createDataFrame([(k // 10, k % 10, *(rng.choice([1, 2, 16]) for _ in range(3))) for k in range(100)], "row long, col long, a int, b int, c int")
    done = transitions.analyse(px, {2010: "a", 2015: "b", 2020: "c"}, [1, 2, 16], UTM)
    assert {r.interval for r in done.overall.collect()} == {"2010-2015", "2015-2020", "net"}
    for r in done.overall.collect():
        assert r.landscape == pytest.approx(1.0) and r.total == pytest.approx(1.0 - r.persistence, abs=0.02) and r.allocation == pytest.approx(r.exchange + r["shift"], abs=0.02)
    assert {r.label for r in done.trajectories.collect()} == set(TRAJECTORIES.values())
    assert len(IMPOSSIBLE) == 26
    with pytest.raises(ValueError):
        transitions.analyse(px, {2010: "a"}, [1], UTM)


def test_feature_stack_from_layers(spark):
    layer = lambda name, f, grid=G, **s: raster.Layer(name, spark.createDataFrame([(r, c, float(f(r, c))) for r in range(grid.height) for c in range(grid.width)], "row long, col long, value double"), grid, s)
    coarse = GridSpec(6, 7, 20.0, 0.0, 500000.0, 0.0, -20.0, 9000000.0, 32751)
    made, names, about = raster.create_feature_stack(
        [layer("B08", lambda r, c: 3, item="x"), layer("B08", lambda r, c: 5), layer("B04", lambda r, c: 1)], layers=[layer("data", lambda r, c: 2 * c, coarse)], aliases={"data": "dem"}, indices=["ndvi"], terrain_from=["dem"])
    assert names == ["B08", "B04", "dem", "NDVI", "dem_slope", "dem_aspect"] and made.columns == ["row", "col", *names]
    got = {(r.row, r.col): r for r in made.collect()}
    assert len(got) == 168 and all(r.B08 == 4 and r.NDVI == pytest.approx(0.6) for r in got.values())
    assert got[5, 6].dem == pytest.approx(2 * (6.5 / 2 - 0.5)) and got[5, 6].dem_slope == pytest.approx(math.degrees(math.atan(0.1)))
    assert json.loads(about)["sources"][0] == {"asset": "B08", "item": "x"}
    assert {r.B08 for r in raster.create_feature_stack([layer("B08", lambda r, c: 3), layer("B08", lambda r, c: 5)], method="first_valid")[0].collect()} == {3.0}
    fine = raster.target_grid(G, resolution=7.0)
    assert (fine.height, fine.width) == (18, 20) and fine.c == G.c
    lonlat = raster.target_grid(G, epsg=4326)
    assert lonlat.epsg == 4326 and abs(lonlat.a) < 1e-3 or lonlat.width >= 1
    for bad in (dict(imagery=[]), dict(imagery=[layer("a", lambda r, c: 1)], terrain_from=["b"]), dict(imagery=[layer("NDVI", lambda r, c: 1)], indices=["NDVI"]), dict(imagery=[layer("a", lambda r, c: 1)], method="mean"), dict(imagery=[layer("a", lambda r, c: 1)], epsg=4326, resolution=10)):
        with pytest.raises(ValueError):
            raster.create_feature_stack(**bad)


def test_distances_to_vectors(spark):
    ring = [(500020.0, 8999980.0), (500040.0, 8999980.0), (500040.0, 8999960.0), (500020.0, 8999960.0), (500020.0, 8999980.0)]
    roads = spark.createDataFrame([(ring,)], "ring array<struct<x:double,y:double>>")
    towns = spark.createDataFrame([(500005.0, 8999995.0), (0.0, 0.0)], "x double, y double")
    got = {(r.row, r.col): r for r in raster.distance_features({"road": roads, "town": towns}, G).collect()}
    assert len(got) == 168 and got[3, 3].road == 0 and got[0, 0].town == 0 and got[11, 13].town == pytest.approx(math.hypot(110, 130))
    with pytest.raises(ValueError, match="no features"):
        raster.distance_features({"road": roads.limit(0)}, G)
    with pytest.raises(ValueError, match="projected"):
        raster.distance_features({"road": roads}, GridSpec(2, 2, 1.0, 0.0, 0.0, 0.0, -1.0, 0.0, 4326))


def _lzw(data):
    """The format's LZW, by the plainest coder."""
    out, held, bits = bytearray(), 0, 0

    def put(code, width):
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)

    table, width, w = {bytes([k]): k for k in range(256)}, 9, b""
    put(256, 9)
    for k in data:
        if w + bytes([k]) in table:
            w += bytes([k])
            continue
        put(table[w], width)
        table[w + bytes([k])] = len(table) + 2
        if len(table) + 2 > 4093:
            put(256, 12)
            table, width = {bytes([j]): j for j in range(256)}, 9
        else:
            width = 9 if len(table) + 2 < 512 else 10 if len(table) + 2 < 1024 else 11 if len(table) + 2 < 2048 else 12
        w = bytes([k])
    put(table[w], width)
    put(257, width)
    put(0, 7)
    return bytes(out)


def test_lzw_and_windows_of_files(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    for n in (1, 300, 20_000):
        data = bytes(rng.choice([0, 1, 7, rng.randrange(256)]) for _ in range(n))
        assert tiff.unlzw(_lzw(data)) == data
    a = np.arange(40 * 30).reshape(40, 30).astype("uint16")
    monkeypatch.setattr(tiff, "TASK_BYTES", 200)
    (tmp_path / "a.tif").write_bytes(tiff.encode(a, GridSpec(40, 30, 10.0, 0.0, 0.0, 0.0, -10.0, 0.0, 32751), 0, rows=8))
    whole = tiff.read_raster(spark, str(tmp_path / "a.tif"), ["v"])
    assert {(r.row, r.col): r.v for r in whole.collect()} == {(r, c): float(a[r, c]) for r in range(40) for c in range(30) if a[r, c]}
    part = tiff.read_raster(spark, str(tmp_path / "a.tif"), ["v"], (10, 5, 12, 4))
    assert {(r.row, r.col) for r in part.collect()} == {(r, c) for r in range(10, 22) for c in range(5, 9)}
    assert tiff.band_names(spark, str(tmp_path / "a.tif")) == ["band_1"]
    # A large file's header: 64-bit places.
    raw = zlib.compress(a.astype("<u2").tobytes())
    tags = [(256, 4, 30), (257, 4, 40), (258, 3, 16), (259, 3, 8), (273, 16, 16), (277, 3, 1), (278, 4, 40), (279, 16, len(raw)), (339, 3, 1)]
    body = struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16 + len(raw)) + raw + struct.pack("<Q", len(tags)) + b"".join(struct.pack("<HHQQ", t, k, 1, v) for t, k, v in tags) + struct.pack("<Q", 0)
    image = tiff.Image.of(body)
    r, c, rows, offsets, sizes = image.layout()[0]
    assert (image.decode([body[offsets[0] : offsets[0] + sizes[0]]], r, c, rows)[:, :, 0] == a).all()
    px = whole.select("row", "col", F.col("v").cast("int").alias("v"))
    done = tiff.write_tiles(px, GridSpec(40, 30, 10.0, 0.0, 0.0, 0.0, -10.0, 0.0, 32751), ["v"], str(tmp_path / "tiles"), dtype="uint16", tile=16).collect()
    assert len(done) == 6 and tiff.read_raster(spark, str(tmp_path / "tiles" / "*.tif"), ["v"]).count() == 1199


def test_paths_areas_and_features(spark, tmp_path):
    for n in ("b", "a"):
        (tmp_path / f"{n}.tif").write_bytes(b"x")
    assert [p.rsplit("/", 1)[1] for _, p in vector.resolve_paths(spark, str(tmp_path / "*.tif"))] == ["a.tif", "b.tif"]
    assert [p.rsplit("/", 1)[1] for _, p in vector.resolve_paths(spark, [str(tmp_path / "b.tif"), str(tmp_path / "a.tif")])] == ["b.tif", "a.tif"]
    for bad in (str(tmp_path / "*.jp2"), [], [str(tmp_path / "c.tif")]):
        with pytest.raises(FileNotFoundError):
            vector.resolve_paths(spark, bad)
    shape = {"type": "Polygon", "coordinates": [[[0, 1], [4, 1], [4, 3], [0, 1]]]}
    assert vector.area_of_interest(spark, {"type": "Feature", "geometry": shape}) == vector.area_of_interest(spark, (0, 1, 4, 3)) == (0, 1, 4, 3)
    (tmp_path / "aoi.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {}, "geometry": shape}, {"type": "Feature", "properties": {}, "geometry": {"type": "Point", "coordinates": [9, 9]}}]}))
    assert vector.area_of_interest(spark, str(tmp_path / "aoi.geojson")) == (0, 1, 9, 9)
    with pytest.raises(ValueError):
        vector.area_of_interest(spark, (1, 2, 3))
    scenes = spark.createDataFrame([("s 1", "c&d", ["visual"])], "item_id string, collection string, assets array<string>")
    assert vector.preview_urls(scenes, "https://x.test/p").first().preview_url == "https://x.test/p?collection=c%26d&item=s+1&assets=visual"
    with pytest.raises(Exception, match="no asset"):
        vector.preview_urls(scenes, "https://x.test/p", "thumb").collect()
    vector.write_features(spark.createDataFrame([(1, 2.0, 3.0)], "id int, x double, y double"), str(tmp_path / "out"))
    assert json.loads(spark.read.text(str(tmp_path / "out")).first()[0]) == {"type": "Feature", "properties": {"id": 1}, "geometry": {"type": "Point", "coordinates": [2.0, 3.0]}}


def test_samples_in_one_call(spark):
    px = spark.createDataFrame([(r, c, 1.0 + r, 2.0 + c) for r in range(12) for c in range(14)], "row long, col long, red double, nir double")
    pts = spark.createDataFrame([(k, k % 3, 500005.0 + 10 * (k % 14), 8999995.0 - 10 * (k // 14)) for k in range(168)], "point_id long, class_id int, x double, y double")
    got = sampling.load_and_split(px, pts, G, bands=["red", "nir"])
    assert got.count() == 168 and got.where("is_test").count() == 51
    ring = [(500000.0, 9000000.0), (500030.0, 9000000.0), (500030.0, 8999980.0), (500000.0, 8999980.0), (500000.0, 9000000.0)]
    poly = spark.createDataFrame([(1, 4, ring), (2, None, ring)], "point_id long, class_id int, ring array<struct<x:double,y:double>>")
    assert sampling.load_and_extract(px, poly, G, bands=["red"]).count() == 6
    more = sampling.raster_features(px.withColumn("green", F.col("col") * 1.0 - 2), pts, G, bands=["red", "nir", "green"], names=["red", "nir", "green"])
    assert more.where("abs(ndvi - (nir - red) / (nir + red)) > 1e-9").count() == 0 and more.count() == 168 - 12  # green + nir is 0 in one column
    a, b = pts.select("point_id", "class_id", F.lit(1).alias("v"), F.lit(2).alias("w")), pts.select("point_id", "class_id", F.lit(3).alias("v"))
    assert sampling.merge_samples(a, b).columns == ["point_id", "class_id", "v_1", "w", "v_2"]
    with pytest.raises(Exception, match="point twice"):
        sampling.merge_samples(a.unionByName(a), b).collect()
    flags = outliers.detect_point_outliers(px, pts, G, ["red", "nir"])
    kept, flagged = outliers.split_flagged(pts, flags.drop("class_id"))
    assert kept.count() + flags.where("outlier").count() == 168 and flagged.count() == 168 and "x" in kept.columns


def test_models_and_masks(spark):
    rows = [(k, float(k % 7), float(k % 5), float(k % 2)) for k in range(120)]
    df = spark.createDataFrame(rows, "id long, a double, b double, label double").withColumn("b", F.col("label") * 3 + F.col("b") / 10)
    made = learning.assemble(df, ["a", "b"])
    model = learning.train_probability_model(made, numTrees=5)
    weight = learning.feature_importances(model, ["a", "b"])
    assert next(iter(weight)) == "b" and sum(weight.values()) == pytest.approx(1) and learning.class_values(df) == [0.0, 1.0]
    assert learning.cohen_kappa(model.transform(made)) > 0.9
    table, best = learning.tune_forest(made, [3, 5], ["all"])
    assert table.first().oa == max(r.oa for r in table.collect()) and set(best) == {"numTrees", "featureSubsetStrategy"}
    from pyspark.ml.classification import RandomForestClassifier

    dealt = made.withColumn("half", F.floor(F.col("id") / 2) % 2)
    table, model = learning.tune(dealt, lambda trees: RandomForestClassifier(numTrees=trees, seed=1), {"trees": [2, 4]}, fold_col="half", scoring="f1_macro")
    assert table.columns == ["params", "f1_macro"] and model.getNumTrees in (2, 4) and table.first().f1_macro > 0.9
    with pytest.raises(ValueError, match="unknown score"):
        learning.tune(made, "rf", {"numTrees": [2]}, scoring="luck", folds=2)
    train, test = sampling.sample_regions(spark.createDataFrame([(r, c, 1.0) for r in range(12) for c in range(14)], "row long, col long, v double"), spark.createDataFrame([(k, k % 3, 500005.0 + 10 * (k % 14), 8999995.0 - 10 * (k // 14)) for k in range(168)], "point_id long, class_id int, x double, y double"), G, ["v"])
    assert train.count() + test.count() == 168 and 90 < train.count() < 145
    split = sampling.stratified_bernoulli(spark.range(3000).select("id", (F.col("id") % 3).cast("int").alias("c")), "id", "c", {0: 1.0, 1: 0.5})
    n = {r.c: r.n for r in split.where("is_train").groupBy("c").agg(F.count("*").alias("n")).collect()}
    assert n[0] == 1000 and 420 < n[1] < 580 and 2 not in n
    px = spark.createDataFrame([(0, 0, 1.0, 2.0, 3.0), (0, 1, 1.0, None, 3.0)], "row long, col long, x double, y double, z double")

    class Picks:
        def transform(self, t):
            return t[["z"]]

    got = learning.classify_pixels(px, ["x", "y", "z"], lambda t: t["z"] * 2, selector=Picks(), dtype="tinyint")
    assert dict(got.dtypes)["cls"] == "tinyint" and [r.cls for r in got.orderBy("col").collect()] == [6, 0]
    assert [r.cls for r in learning.classify_pixels(px, ["x", "y", "z"], lambda t: t["x"], selector=["x"]).orderBy("col").collect()] == [1, 0]
    assert [r.mask for r in raster.valid_mask(px, "y").orderBy("col").collect()] == [255, 0]


def test_components_of_single_edges_have_the_smallest_root(spark):
    from terrace.operators.graph import components

    got = components(spark.createDataFrame([(1, 2), (5, 3), (7, 8), (7, 9)], "u long, v long")).collect()
    assert sorted((r.node, r.root) for r in got) == [(2, 1), (5, 3), (8, 7), (9, 7)]


def test_rules_on_all_classes(spark):
    # p by class: water or riverbed first, cleared or built second, and near it; then merged or not.
    def p(first, second, ratio):
        out = [0] * 18
        out[first - 1], out[second - 1] = 5000, int(5000 * ratio)
        return out

    cases = [(p(18, 15, 0.9), 15), (p(18, 16, 0.9), 16), (p(17, 15, 0.9), 15), (p(17, 15, 0.2), 17), (p(18, 3, 0.9), 17), (p(18, 15, 0.2), 17), (p(4, 16, 0.9), 4), ([0] * 18, 0)]
    df = spark.createDataFrame([(0, k, x, 0) for k, (x, _) in enumerate(cases)], "row int, col int, p array<int>, seg long")
    assert [r.lulc for r in fusion.fuse(df, bands=18).orderBy("col").collect()] == [c for _, c in cases]
    assert [r.lulc for r in fusion.fuse(df, bands=18, merge_riverbed=False).orderBy("col").collect()] == [15, 16, 15, 17, 18, 18, 4, 0]


def test_localised_clamps_and_small_patches_of_a_whole_raster(spark):
    rng = random.Random(6)
    a = [[rng.choice([1, 1, 2]) for _ in range(30)] for _ in range(30)]
    got = {(r.row, r.col): r.is_small for r in components.small_patches(_pixels(spark, a), {1: 12, 2: 5}, tile=7).collect()}
    seen, want = {}, {}
    for r in range(30):
        for c in range(30):
            if (r, c) in seen:
                continue
            todo, own = [(r, c)], {(r, c)}
            while todo:
                y, x = todo.pop()
                for y2 in (y - 1, y, y + 1):
                    for x2 in (x - 1, x, x + 1):
                        if 0 <= y2 < 30 and 0 <= x2 < 30 and (y2, x2) not in own and a[y2][x2] == a[r][c]:
                            own.add((y2, x2))
                            todo.append((y2, x2))
            for k in own:
                seen[k] = True
                want[k] = len(own) < {1: 12, 2: 5}[a[r][c]]
    assert got == want
    assert accuracy.overall_log_loss(spark.createDataFrame([(0.5,), (0.0,), (None,)], "p double"), "p").first().log_loss == pytest.approx((math.log(2) + math.log(1000)) / 2, abs=1e-6)
    assert areas.class_area(_pixels(spark, a), UTM).first().cls == 1
