"""Rasters in TIFF files as pixel tables, and tiles of pixel tables as files: classic and large files; strips or tiles, plain, deflated or LZW.

A scan's partitions are blocks of a file, not files: headers are read first, then each task reads the bytes of its own blocks.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.grid import GridSpec
from terrace.scratch import materialize

# Tags of the format and of its geographic extension.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, BANDS, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, FORMAT, SCALE, TIEPOINT, GEO_KEYS, METADATA, NODATA = 322, 323, 324, 325, 339, 33550, 33922, 34735, 42112, 42113
_SIZES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 6: ("b", 1), 8: ("h", 2), 9: ("i", 4), 11: ("f", 4), 12: ("d", 8), 16: ("Q", 8)}
_KINDS = {1: "u", 2: "i", 3: "f"}
#: Bytes of blocks that one task reads.
TASK_BYTES = 64 << 20

Reader = Callable[[int, int], bytes]  # offset, size


# Schemes of Hadoop's that Arrow knows by another name.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def store_of(path: str) -> tuple[object, str]:
    """The file system of a path and the path in it: local, or of a store that Arrow knows by its address."""
    from pyarrow import fs

    scheme, mark, rest = path.partition("://")
    if not mark:
        return fs.FileSystem.from_uri(path) if path.startswith("file:") else (fs.LocalFileSystem(), path)
    try:
        return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}")
    except pa.ArrowInvalid as e:
        raise ValueError(f"files of {scheme}:// can't be read in parts: {e}") from e


def opened(path: str) -> Reader:
    """Reads ranges of a file."""
    store, inner = store_of(path)
    file = store.open_input_file(inner)
    return lambda at, size: file.read_at(size, at)


def _codes(bits: np.ndarray, at: int, many: int) -> tuple[np.ndarray, np.ndarray]:
    """many codes after a clear at bit `at`, and where each ends: their widths grow with the table, one early."""
    entries = 257 + np.arange(many)
    width = 9 + (entries >= 511).astype(np.int64) + (entries >= 1023) + (entries >= 2047)
    ends = at + np.cumsum(width)
    begin = ends - width
    byte = np.minimum(begin >> 3, len(bits) - 3)
    held = bits[byte] << 16 | bits[byte + 1] << 8 | bits[byte + 2]
    return held >> (24 - width - (begin & 7)) & ((1 << width) - 1), ends


def _words(codes: np.ndarray) -> bytes:
    """What the codes between two clears stand for. A code above 257 repeats what an earlier code stood for and one byte more, which follows it."""
    n = len(codes)
    plain = codes < 256
    before = np.where(plain, np.arange(n), codes - 258)
    if (before > np.arange(n)).any() or (before < 0).any():
        raise ValueError("a code that isn't known yet")
    size, up = (~plain).astype(np.int64), before.copy()
    while True:  # each round doubles how far back a code looks
        more = size + size[up]
        if (more == size).all():
            break
        size, up = more, up[up]
    size += 1
    start = np.cumsum(size) - size
    code = np.repeat(np.arange(n), size)
    at = np.arange(len(code))
    source = np.where(plain[code], at, start[before[code]] + at - start[code])
    while True:
        further = source[source]
        if (further == source).all():
            return codes[code[source]].astype(np.uint8).tobytes()
        source = further


def unlzw(data: bytes) -> bytes:
    """The format's LZW: codes from the high bit on, of 9 to 12 bits, one early; 256 clears the table, 257 ends."""
    bits = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int64)
    at, end, out, many = 0, 8 * len(data), [], 4096
    while at + 9 <= end:
        codes, ends = _codes(bits, at, many)
        stop = np.flatnonzero((codes == 256) | (codes == 257) | (ends > end))
        if not len(stop):
            many *= 2  # a writer that doesn't clear its full table
            continue
        k = int(stop[0])
        out.append(_words(codes[:k]))
        if ends[k] > end or codes[k] == 257:
            break
        at, many = int(ends[k]), 4096
    return b"".join(out)


@dataclass
class Image:
    """The header of a TIFF file and the place of its blocks."""

    tags: dict[int, tuple]
    order: str

    @classmethod
    def of(cls, raw: bytes | Reader) -> Image:
        read = raw if callable(raw) else lambda at, size: raw[at : at + size]
        head = read(0, 16)
        order = {b"II": "<", b"MM": ">"}.get(head[:2])
        version = struct.unpack(order + "H", head[2:4])[0] if order else 0
        if version not in (42, 43):
            raise ValueError("not a TIFF file")
        large = version == 43
        at = struct.unpack(order + "Q", head[8:16])[0] if large else struct.unpack(order + "I", head[4:8])[0]
        count_code, entry, inline = ("Q", "HHQ8s", 8) if large else ("H", "HHI4s", 4)
        first, size = struct.calcsize(order + count_code), struct.calcsize(order + entry)
        many = struct.unpack(order + count_code, read(at, first))[0]
        entries, tags = read(at + first, size * many), {}
        for k in range(many):
            tag, kind, count, value = struct.unpack(order + entry, entries[size * k : size * (k + 1)])
            if kind not in _SIZES:
                continue
            code, width = _SIZES[kind]
            data = value if width * count <= inline else read(struct.unpack(order + ("Q" if large else "I"), value)[0], width * count)
            tags[tag] = (data[:count].rstrip(b"\0").decode("latin-1"),) if kind == 2 else struct.unpack(f"{order}{count}{code}", data[: width * count])
        return cls(tags, order)

    def one(self, tag: int, default: int | None = None) -> int:
        return self.tags.get(tag, (default,))[0]

    @property
    def dtype(self) -> np.dtype:
        return np.dtype(f"{self.order}{_KINDS[self.one(FORMAT, 1)]}{self.one(BITS, 8) // 8}")

    @property
    def grid(self) -> GridSpec:
        sx, sy = self.tags.get(SCALE, (1.0, 1.0, 0.0))[:2]
        i, j, _, x, y = self.tags.get(TIEPOINT, (0, 0, 0, 0.0, 0.0, 0.0))[:5]
        keys = self.tags.get(GEO_KEYS, ())
        epsg = next((keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k] in (3072, 2048)), 0)
        return GridSpec(self.one(HEIGHT), self.one(WIDTH), sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy, epsg)

    @property
    def nodata(self) -> float | None:
        return float(self.tags[NODATA][0]) if NODATA in self.tags else None

    @property
    def names(self) -> list[str]:
        """The bands' descriptions, band_1, band_2 ... where there are none; the same twice is an error."""
        told = {}
        if METADATA in self.tags:
            for item in ElementTree.fromstring(self.tags[METADATA][0]).iter("Item"):
                if (item.get("role") or "").lower() == "description" and item.get("sample") is not None and (item.text or "").strip():
                    told[int(item.get("sample"))] = item.text.strip()
        found = [told.get(k, f"band_{k + 1}") for k in range(self.one(BANDS, 1))]
        if len(set(found)) < len(found):
            raise ValueError(f"bands of one name: {found}")
        return found

    def layout(self) -> list[tuple[int, int, int, tuple[int, ...], tuple[int, ...]]]:
        """(row, col, rows, offsets, sizes) of each strip or tile; several offsets where bands are stored apart."""
        h, w, n, planar = self.one(HEIGHT), self.one(WIDTH), self.one(BANDS, 1), self.one(PLANAR, 1)
        tiled = TILE_OFFSETS in self.tags
        bh, bw = (self.one(TILE_HEIGHT), self.one(TILE_WIDTH)) if tiled else (min(self.one(ROWS_PER_STRIP, h), h), w)
        offsets, sizes = self.tags[TILE_OFFSETS if tiled else STRIP_OFFSETS], self.tags[TILE_BYTES if tiled else STRIP_BYTES]
        across, down = -(-w // bw), -(-h // bh)
        out = []
        for k in range(across * down):
            r, c = k // across * bh, k % across * bw
            own = [k] if planar == 1 else [k + b * across * down for b in range(n)]
            out.append((r, c, bh if tiled else min(bh, h - r), tuple(offsets[j] for j in own), tuple(sizes[j] for j in own)))
        return out

    def decode(self, parts: list[bytes], r: int, c: int, rows: int) -> np.ndarray:
        """Values by row, column and band of one block."""
        kind, width = self.one(COMPRESSION, 1), self.one(TILE_WIDTH) if TILE_OFFSETS in self.tags else self.one(WIDTH)
        unpack = {1: lambda d: d, 5: unlzw, 8: zlib.decompress, 32946: zlib.decompress}
        if kind not in unpack:
            raise ValueError(f"compression {kind} is not supported")
        bands = self.one(BANDS, 1) if self.one(PLANAR, 1) == 1 else 1

        def cells(data: bytes) -> np.ndarray:
            raw, predictor = unpack[kind](data), self.one(PREDICTOR, 1)
            if predictor == 3:  # a row's bytes by their place in the value, the highest first, as differences
                size = self.dtype.itemsize
                planes = np.frombuffer(raw, np.uint8, rows * width * bands * size).reshape(rows, size * width, bands)
                planes = np.cumsum(planes, 1, dtype=np.uint8).reshape(rows, size, width * bands)
                return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(self.dtype.newbyteorder(">")).reshape(rows, width, bands)
            if predictor not in (1, 2):
                raise ValueError(f"predictor {predictor} is not supported")
            a = np.frombuffer(raw, self.dtype, rows * width * bands).reshape(rows, width, bands)
            return np.cumsum(a, 1, dtype=a.dtype) if predictor == 2 else a

        whole = np.concatenate([cells(p) for p in parts], 2)
        return whole[: self.one(HEIGHT) - r, : self.one(WIDTH) - c]

    def blocks(self, raw: bytes) -> Iterator[tuple[int, int, np.ndarray]]:
        """(row, col, values) of each block of a whole file."""
        for r, c, rows, offsets, sizes in self.layout():
            yield r, c, self.decode([raw[o : o + s] for o, s in zip(offsets, sizes, strict=True)], r, c, rows)


def pixels_of(image: Image, read: Reader, block: tuple, bands: int, window: tuple[int, int, int, int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, col and values (NaN: no data) of the pixels of one block that have data in any band and lie in the window."""
    r, c, rows, offsets, sizes = block
    a = image.decode([read(o, s) for o, s in zip(offsets, sizes, strict=True)], r, c, rows)
    values = a.astype(float).reshape(-1, bands)
    values[np.isclose(values, image.nodata) if image.nodata is not None else ~np.isfinite(values)] = np.nan
    row, col = (x.ravel() for x in np.mgrid[r : r + a.shape[0], c : c + a.shape[1]])
    keep = ~np.isnan(values).all(1)
    if window is not None:
        keep &= (row >= window[0]) & (row < window[0] + window[2]) & (col >= window[1]) & (col < window[1] + window[3])
    return row[keep], col[keep], values[keep]


def read_raster(spark: SparkSession, path: str, bands: list[str], window: tuple[int, int, int, int] | None = None, grid: GridSpec | None = None) -> DataFrame:
    """path, row, col, bands (double) of TIFF files; pixels with nodata in all bands are left out, nodata in one is null. window: first row, first column, rows, columns.

    grid: that of which the files are parts (as tiles are); rows, columns and the window are its own then, else those of each file.
    Each task reads and unpacks some blocks, a block at a time, so files may be of any size; blocks outside the window aren't read.
    """
    files = spark.read.format("binaryFile").load(path).select("path")  # the content isn't read

    def place(image: Image) -> tuple[int, int]:
        own = image.grid
        return (round((own.f - grid.f) / grid.e), round((own.c - grid.c) / grid.a)) if grid is not None else (0, 0)

    def within(at: tuple[int, int]) -> tuple[int, int, int, int] | None:
        return None if window is None else (window[0] - at[0], window[1] - at[1], *window[2:])

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                image = Image.of(opened(name))
                if image.one(BANDS, 1) != len(bands):
                    raise ValueError(f"{name} has {image.one(BANDS, 1)} bands, not {len(bands)}")
                across = image.one(TILE_WIDTH) if TILE_OFFSETS in image.tags else image.one(WIDTH)
                own = within(place(image))
                lines = [(r, c, n, o, s) for r, c, n, o, s in image.layout() if own is None or (r < own[0] + own[2] and r + n > own[0] and c < own[1] + own[3] and c + across > own[1])]
                group, held = [], 0
                for line in lines:  # so many blocks together as a task reads
                    group.append(held // TASK_BYTES)
                    held += sum(line[4])
                cols = [pa.array([x[k] for x in lines], pa.int64()) for k in range(3)] + [pa.array([list(x[k]) for x in lines], pa.list_(pa.int64())) for k in (3, 4)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(lines), pa.string()), pa.array(group, pa.int64()), *cols], names=["path", "part", "r", "c", "rows", "offsets", "sizes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = image = read = at = None
        for batch in batches:
            for p, _, r, c, rows, offsets, sizes in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if p != name:
                    name, read = p, opened(p)
                    image = Image.of(read)
                    at = place(image)
                row, col, values = pixels_of(image, read, (r, c, rows, offsets, sizes), len(bands), within(at))
                cols = [pa.array(values[:, k], from_pandas=True) for k in range(len(bands))]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(row), pa.string()), pa.array(row + at[0]), pa.array(col + at[1]), *cols], names=["path", "row", "col", *bands])

    blocks = materialize(files.mapInArrow(plan, "path string, part long, r long, c long, rows long, offsets array<long>, sizes array<long>"), "blocks")
    parts = blocks.select("path", "part").distinct().count()
    dealt = blocks.repartition(max(1, parts), "path", "part").sortWithinPartitions("path", "part")
    return dealt.mapInArrow(run, "path string, row long, col long, " + ", ".join(f"{b} double" for b in bands))


def read_grid(spark: SparkSession, path: str) -> GridSpec:
    """The grid of one file, from its header."""
    return Image.of(opened(spark.read.format("binaryFile").load(path).select("path").first()[0])).grid


def band_names(spark: SparkSession, path: str) -> list[str]:
    """The names of one file's bands: their descriptions, or band_1, band_2 ..."""
    return Image.of(opened(spark.read.format("binaryFile").load(path).select("path").first()[0])).names


def encode(values: np.ndarray, grid: GridSpec, nodata: float | None = None, rows: int = 256, names: list[str] | None = None) -> bytes:
    """A TIFF file of values (row, col, band): deflated strips, little-endian. names: descriptions of the bands."""
    a = np.ascontiguousarray(values if values.ndim == 3 else values[:, :, None])
    a = a.astype(a.dtype.newbyteorder("<"))
    strips = [zlib.compress(a[r : r + rows].tobytes()) for r in range(0, len(a), rows)]
    kind = {"u": 1, "i": 2, "f": 3}[a.dtype.kind]
    n = a.shape[2]
    entries: list[tuple[int, int, tuple]] = [
        (WIDTH, 4, (a.shape[1],)), (HEIGHT, 4, (a.shape[0],)), (BITS, 3, (a.dtype.itemsize * 8,) * n), (COMPRESSION, 3, (8,)), (PHOTOMETRIC, 3, (1,)), (STRIP_OFFSETS, 4, (0,) * len(strips)), (BANDS, 3, (n,)),
        (ROWS_PER_STRIP, 4, (rows,)), (STRIP_BYTES, 4, tuple(map(len, strips))), (PLANAR, 3, (1,)), (FORMAT, 3, (kind,) * n), (SCALE, 12, (grid.a, -grid.e, 0.0)), (TIEPOINT, 12, (0.0, 0.0, 0.0, grid.c, grid.f, 0.0)),
        (GEO_KEYS, 3, (1, 1, 0, 2, 1024, 0, 1, 2 if grid.geographic else 1, 2048 if grid.geographic else 3072, 0, 1, grid.epsg)),
    ]
    if nodata is not None:
        entries.append((NODATA, 2, (f"{nodata:g}\0".encode(),)))
    if names is not None:
        told = ElementTree.Element("GDALMetadata")
        for k, name in enumerate(names):
            ElementTree.SubElement(told, "Item", name="DESCRIPTION", sample=str(k), role="description").text = name
        entries.append((METADATA, 2, (ElementTree.tostring(told) + b"\0",)))
    pack = lambda kind, v: v[0] if kind == 2 else struct.pack(f"<{len(v)}{_SIZES[kind][0]}", *v)
    head, extra, at = b"", b"", 8 + 2 + 12 * len(entries) + 4
    start = at + sum(len(p) + len(p) % 2 for _, k, v in entries if len(p := pack(k, v)) > 4)
    places = tuple(start + sum(map(len, strips[:k])) for k in range(len(strips)))
    for tag, kind_, v in sorted(entries):
        data = pack(kind_, places if tag == STRIP_OFFSETS else v)
        count = len(data) if kind_ == 2 else len(v)
        if len(data) > 4:
            head += struct.pack("<HHII", tag, kind_, count, at + len(extra))
            extra += data + b"\0" * (len(data) % 2)
        else:
            head += struct.pack("<HHI", tag, kind_, count) + data.ljust(4, b"\0")
    return struct.pack("<2sHIH", b"II", 42, 8, len(entries)) + head + struct.pack("<I", 0) + extra + b"".join(strips)


def raster_tiles(pixels: DataFrame, grid: GridSpec, bands: list[str], *, dtype: str = "uint8", nodata: float = 0, tile: int = 512) -> DataFrame:
    """tile_row, tile_col, content: each tile of the grid that has pixels as a TIFF file of its own, made on the executors."""
    import pandas as pd

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        tr, tc = int(pdf["tile_row"].iloc[0]), int(pdf["tile_col"].iloc[0])
        a = np.full((min(tile, grid.height - tr * tile), min(tile, grid.width - tc * tile), len(bands)), nodata, dtype)
        a[pdf["row"] - tr * tile, pdf["col"] - tc * tile] = pdf[bands].fillna(nodata).to_numpy()
        own = GridSpec(a.shape[0], a.shape[1], grid.a, 0.0, grid.c + tc * tile * grid.a, 0.0, grid.e, grid.f + tr * tile * grid.e, grid.epsg)
        return pd.DataFrame({"tile_row": [tr], "tile_col": [tc], "content": [encode(a, own, nodata, names=bands)]})

    own = pixels.select("row", "col", *bands).withColumn("tile_row", F.floor(F.col("row") / tile)).withColumn("tile_col", F.floor(F.col("col") / tile))
    return own.groupBy("tile_row", "tile_col").applyInPandas(make, "tile_row long, tile_col long, content binary")


def write_tiles(pixels: DataFrame, grid: GridSpec, bands: list[str], folder: str, **how) -> DataFrame:
    """raster_tiles written as folder/tile_<row>_<col>.tif, each by the task that made it; returns tile_row, tile_col, path, bytes. A file is put in place whole, so a task that runs again does no harm."""
    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, inner = store_of(folder)
        for b in batches:
            store.create_dir(inner, recursive=True)
            paths, sizes = [], []
            for r, c, content in zip(*(x.to_pylist() for x in b.columns), strict=True):
                at = f"{inner.rstrip('/')}/tile_{r}_{c}.tif"
                made = f"{at}.{uuid.uuid4().hex}"
                with store.open_output_stream(made) as out:
                    out.write(content)
                store.move(made, at)
                paths.append(at)
                sizes.append(len(content))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(paths), pa.array(sizes, pa.int64())], names=["tile_row", "tile_col", "path", "bytes"])

    return raster_tiles(pixels, grid, bands, **how).mapInArrow(put, "tile_row long, tile_col long, path string, bytes long")
