"""The raster format: pushed windows, commits, predictors, names of bands."""

import os
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrace.grid import GridSpec
from terrace.sources import raster_format, tiff
from terrace.sources.raster_format import RasterReader, register, write_raster

G = GridSpec(40, 30, 10.0, 0.0, 500000.0, 0.0, -10.0, 9000000.0, 32751)


def _values(dtype="uint16", bands=2):
    return (np.arange(40 * 30 * bands).reshape(40, 30, bands) % 251).astype(dtype)


def test_reads_what_is_there_and_prunes_blocks(spark, tmp_path):
    register(spark)
    a = _values()
    for k in range(2):
        (tmp_path / f"t{k}.tif").write_bytes(tiff.encode(a + k, G, 0, rows=8, names=["red", "near infrared"]))
    (tmp_path / "_hidden.tif").write_bytes(b"nothing")
    df = spark.read.format("raster").load(str(tmp_path))
    assert df.columns == ["path", "row", "col", "red", "near infrared"]
    got = {(os.path.basename(r.path), r.row, r.col): (r.red, r["near infrared"]) for r in df.collect()}
    value = lambda v: float(v) if v else None
    want = {(f"t{k}.tif", r, c): tuple(value(v) for v in (a + k)[r, c]) for k in range(2) for r in range(40) for c in range(30) if (a + k)[r, c].any()}
    assert got == want
    part = spark.read.format("raster").option("bands", "red").load(str(tmp_path / "t1.*")).where("row >= 10 AND row < 20 AND col = 7 AND red > 100")
    assert {(r.row, r.col): r.red for r in part.collect()} == {(r, 7): float(a[r, 7, 0] + 1) for r in range(10, 20) if a[r, 7, 0] + 1 > 100}
    with pytest.raises(Exception, match="no bands"):
        spark.read.format("raster").option("bands", "blue").load(str(tmp_path)).collect()
    # What the plan's partitions hold when rows 10 to 19 are asked for: two of five strips.
    reader = RasterReader(str(tmp_path / "t0.tif"), df.schema)
    left = list(reader.pushFilters([raster_format.GreaterThanOrEqual(("row",), 10), raster_format.LessThan(("row",), 20), raster_format.GreaterThan(("red",), 3)]))
    assert [f.attribute for f in left] == [("red",)] and [b[0] for p in reader.partitions() for b in p.blocks] == [8, 16]
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "> 100.0" in plan and ">= 10" not in plan and "= 7" not in plan  # row and col are left to the scan


def test_a_task_reads_a_run_of_blocks(spark, tmp_path, monkeypatch):
    (tmp_path / "a.tif").write_bytes(tiff.encode(_values(), G, 0, rows=4))
    monkeypatch.setattr(raster_format, "TASK_BYTES", 300)
    reader = RasterReader(str(tmp_path / "a.tif"), spark.createDataFrame([], "path string, row long, col long, band_1 double").schema)
    parts = reader.partitions()
    assert len(parts) > 2 and [b[0] for p in parts for b in p.blocks] == list(range(0, 40, 4))


def test_writes_all_or_nothing(spark, tmp_path):
    folder = str(tmp_path / "out")
    px = spark.createDataFrame([(r, c, (r * 30 + c) % 7 + 1) for r in range(40) for c in range(30)], "row long, col long, v int")
    write_raster(px, G, ["v"], folder, dtype="uint8", tile=16)
    assert sorted(os.listdir(folder)) == sorted(f"tile_{r}_{c}.tif" for r in range(3) for c in range(2))
    back = tiff.read_raster(spark, f"{folder}/*.tif", ["v"])
    assert back.count() == 1200 and tiff.band_names(spark, f"{folder}/tile_0_0.tif") == ["v"]
    bad = px.withColumn("v", F.when(F.col("row") == 39, F.raise_error(F.lit("broken")).cast("int")).otherwise(9))
    with pytest.raises(Exception, match="broken"):
        write_raster(bad, G, ["v"], folder, dtype="uint8", tile=16)
    assert sorted(os.listdir(folder)) == sorted(f"tile_{r}_{c}.tif" for r in range(3) for c in range(2))
    assert tiff.read_raster(spark, f"{folder}/*.tif", ["v"]).where("v = 9").count() == 0
    fresh = str(tmp_path / "fresh")
    with pytest.raises(Exception, match="broken"):
        write_raster(bad, G, ["v"], fresh, dtype="uint8", tile=16)
    assert not os.path.exists(fresh) or os.listdir(fresh) == []
    write_raster(px.where("row < 16 AND col < 16"), G, ["v"], folder, mode="overwrite", dtype="uint8", tile=16)
    assert os.listdir(folder) == ["tile_0_0.tif"]


def _lzw(data):
    """The plainest coder, which clears its table when it's full."""
    out, held, bits = bytearray(), 0, 0

    def put(code, width):
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)

    table, width, word = {bytes([k]): k for k in range(256)}, 9, b""
    put(256, 9)
    for byte in data:
        if word + bytes([byte]) in table:
            word += bytes([byte])
            continue
        put(table[word], width)
        table[word + bytes([byte])] = len(table) + 2
        n = len(table) + 2
        width = 12 if n >= 2048 else 11 if n >= 1024 else 10 if n >= 512 else 9
        if n >= 4094:
            put(256, 12)
            table, width = {bytes([k]): k for k in range(256)}, 9
        word = bytes([byte])
    if word:
        put(table[word], width)
    n = len(table) + 3
    put(257, 12 if n >= 2048 else 11 if n >= 1024 else 10 if n >= 512 else 9)
    put(0, 7)
    return bytes(out)


def test_lzw_of_any_shape():
    rnd = random.Random(2)
    for data in (b"", b"a", b"a" * 70_000, bytes(range(256)) * 40, bytes(rnd.randrange(256) for _ in range(9_000)), bytes(rnd.choice(b"ab") for _ in range(60_000))):
        assert tiff.unlzw(_lzw(data)) == data
    with pytest.raises(ValueError, match="isn't known"):
        tiff._words(np.array([65, 300]))


@pytest.mark.parametrize("kind, order", [("f4", "<"), ("f8", "<"), ("f4", ">")])
def test_floating_predictor(kind, order):
    a = np.random.default_rng(1).normal(size=(3, 5, 2)).astype(kind)
    rows = []
    for line in a:
        planes = line.astype(">" + kind).reshape(-1).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T.reshape(-1, 2)  # by byte, then pixel and band
        rows.append(np.concatenate([planes[:1], np.diff(planes, axis=0)]).astype(np.uint8).tobytes())
    raw = zlib.compress(b"".join(rows))
    tags = [(256, 3, 5), (257, 3, 3), (258, 3, 8 * np.dtype(kind).itemsize), (259, 3, 8), (273, 4, 8), (277, 3, 2), (278, 3, 3), (279, 4, len(raw)), (317, 3, 3), (339, 3, 3)]
    at = 8 + len(raw)
    value = lambda k, v: struct.pack(order + ("H2x" if k == 3 else "I"), v)
    body = struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, at) + raw + struct.pack(order + "H", len(tags)) + b"".join(struct.pack(order + "HHI", t, k, 1) + value(k, v) for t, k, v in tags) + bytes(4)
    image = tiff.Image.of(body)
    (_, _, got), = image.blocks(body)
    assert np.array_equal(got.astype(kind), a)
    image.tags[317] = (4,)
    with pytest.raises(ValueError, match="predictor 4"):
        list(image.blocks(body))


def test_names_of_bands_and_stores(tmp_path):
    image = tiff.Image.of(tiff.encode(_values(bands=3), G, 0, names=["a", "", "c"]))
    assert image.names == ["a", "band_2", "c"]
    with pytest.raises(ValueError, match="one name"):
        tiff.Image.of(tiff.encode(_values(), G, 0, names=["a", "a"])).names
    assert tiff.Image.of(tiff.encode(_values(), G, 0)).names == ["band_1", "band_2"]
    with pytest.raises(ValueError, match="can't be read in parts"):
        tiff.store_of("nowhere://x/y")
    assert type(tiff.store_of("s3a://bucket/key?region=none")[0]).__name__ == "S3FileSystem"
    with pytest.raises(FileNotFoundError):
        raster_format.files_of(str(tmp_path))
