"""Rasters as a format of Spark's reader and writer: `spark.read.format("raster")` and `.write.format("raster")`, once `register` was called.

Reading: partitions are runs of a file's blocks; comparisons of row and col are pushed into the plan, where blocks that they rule out
make no partition. Writing takes tiles as `raster_tiles` makes them: tasks write to a folder of their own, and only when all have
ended are the files put in their place; a job that fails leaves none.
"""

from __future__ import annotations

import fnmatch
import uuid
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from terrace.grid import GridSpec
from terrace.sources.tiff import TASK_BYTES, TILE_OFFSETS, TILE_WIDTH, WIDTH, Image, opened, pixels_of, raster_tiles, store_of

#: Headers that are read at once.
THREADS = 16
_FAR = 1 << 62


def files_of(path: str) -> list[str]:
    """Files of a path, sorted: itself, those of a folder (but for names that begin with . or _), or of a pattern of names."""
    from pyarrow import fs

    store, inner = store_of(path)
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    if store.get_file_info(inner).type == fs.FileType.File:
        return [path]
    folder, _, name = inner.rpartition("/") if any(c in inner for c in "*?[") else (inner, "", "*")
    found = store.get_file_info(fs.FileSelector(folder))
    names = sorted(f.path for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._" and fnmatch.fnmatchcase(f.base_name, name))
    if not names:
        raise FileNotFoundError(path)
    return [prefix + f for f in names]


@dataclass
class Blocks(InputPartition):
    """Blocks of a file: (row, col, rows, offsets, sizes) each."""

    path: str
    blocks: tuple


class RasterReader(DataSourceReader):
    """Pixels of blocks; low and high (first and last row, first and last column) are what was pushed."""

    def __init__(self, path: str, schema: StructType) -> None:
        self.path, self.columns = path, [f.name for f in schema.fields]
        self.low, self.high = {"row": 0, "col": 0}, {"row": _FAR, "col": _FAR}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Comparisons of row and col with numbers are done here; the others are left to Spark."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            kind = type(f)
            if name not in self.low or kind not in (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual):
                yield f
                continue
            if kind in (EqualTo, GreaterThan, GreaterThanOrEqual):
                self.low[name] = max(self.low[name], f.value + (kind is GreaterThan))
            if kind in (EqualTo, LessThan, LessThanOrEqual):
                self.high[name] = min(self.high[name], f.value - (kind is LessThan))

    def partitions(self) -> list[InputPartition]:
        def of(path: str) -> list[Blocks]:
            image = Image.of(opened(path))
            across = image.one(TILE_WIDTH) if TILE_OFFSETS in image.tags else image.one(WIDTH)
            parts, held = [[]], 0
            for block in image.layout():
                r, c, rows, _, sizes = block
                if r > self.high["row"] or r + rows <= self.low["row"] or c > self.high["col"] or c + across <= self.low["col"]:
                    continue
                if held and held + sum(sizes) > TASK_BYTES:
                    parts.append([])
                    held = 0
                parts[-1].append(block)
                held += sum(sizes)
            return [Blocks(path, tuple(p)) for p in parts if p]

        with ThreadPoolExecutor(THREADS) as pool:
            return [p for own in pool.map(of, files_of(self.path)) for p in own]

    def read(self, partition: Blocks) -> Iterator[pa.RecordBatch]:
        read = opened(partition.path)
        image = Image.of(read)
        at = {name: k for k, name in enumerate(image.names)}
        if missing := [c for c in self.columns[3:] if c not in at]:
            raise ValueError(f"no bands {missing} in {partition.path}, which has {image.names}")
        window = (self.low["row"], self.low["col"], self.high["row"] - self.low["row"] + 1, self.high["col"] - self.low["col"] + 1)
        for block in partition.blocks:
            row, col, values = pixels_of(image, read, block, len(at), window)
            cols = [pa.array(values[:, at[c]], from_pandas=True) for c in self.columns[3:]]
            yield pa.RecordBatch.from_arrays([pa.array([partition.path] * len(row), pa.string()), pa.array(row), pa.array(col), *cols], names=self.columns)


@dataclass
class Written(WriterCommitMessage):
    """Names of the files that a task has written."""

    names: list[str]


class RasterWriter(DataSourceArrowWriter):
    """Tiles (tile_row, tile_col, content) as files tile_<row>_<col>.tif of a folder."""

    def __init__(self, folder: str, overwrite: bool) -> None:
        self.folder, self.overwrite, self.job = folder, overwrite, uuid.uuid4().hex

    def staging(self) -> tuple[object, str, str]:
        store, inner = store_of(self.folder)
        return store, inner.rstrip("/"), f"{inner.rstrip('/')}/_staged-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, _, staged = self.staging()
        own, names = f"{staged}/{uuid.uuid4().hex}", []  # a task that runs again has a folder of its own
        store.create_dir(own, recursive=True)
        for b in iterator:
            for r, c, content in zip(*(b.column(n).to_pylist() for n in ("tile_row", "tile_col", "content")), strict=True):
                names.append(f"{own}/tile_{r}_{c}.tif")
                with store.open_output_stream(names[-1]) as out:
                    out.write(content)
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        store, folder, staged = self.staging()
        from pyarrow import fs

        names = [n for m in messages if m for n in m.names]
        places = [f"{folder}/{n.rpartition('/')[2]}" for n in names]
        if len(set(places)) < len(places):
            store.delete_dir(staged)
            raise ValueError("a tile twice")
        old = [f.path for f in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if f.type == fs.FileType.File and f.path.endswith(".tif")]
        with ThreadPoolExecutor(THREADS) as pool:
            list(pool.map(lambda x: store.move(*x), zip(names, places, strict=True)))
            if self.overwrite:
                list(pool.map(store.delete_file, [p for p in old if p not in set(places)]))
        if store.get_file_info(staged).type == fs.FileType.Directory:
            store.delete_dir(staged)

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        store, folder, staged = self.staging()
        if store.get_file_info(staged).type == fs.FileType.Directory:
            store.delete_dir(staged)


class RasterSource(DataSource):
    """Options: path, bands (names, comma-separated; all of the first file if not given)."""

    @classmethod
    def name(cls) -> str:
        return "raster"

    def schema(self) -> StructType | str:
        bands = [b.strip() for b in self.options["bands"].split(",")] if "bands" in self.options else Image.of(opened(files_of(self.options["path"])[0])).names
        return ", ".join(["path string", "row bigint", "col bigint", *(f"`{b}` double" for b in bands)])

    def reader(self, schema: StructType) -> RasterReader:
        return RasterReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> RasterWriter:
        if not {"tile_row", "tile_col", "content"} <= set(schema.names):
            raise ValueError("tiles have tile_row, tile_col and content")
        return RasterWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let filters reach it."""
    spark.dataSource.register(RasterSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_raster(pixels: DataFrame, grid: GridSpec, bands: list[str], folder: str, *, mode: str = "append", **how) -> None:
    """Pixels as tiles of a folder (see raster_tiles); they are there when this returns, all or none. mode: append (tiles of the same place are replaced) or overwrite."""
    register(pixels.sparkSession)
    raster_tiles(pixels, grid, bands, **how).write.format("raster").mode(mode).save(folder)
