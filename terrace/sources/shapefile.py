"""Shapefiles as tables: the index says where each record lies, so a scan's partitions are runs of records, not files."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.functions.geometry import GEOMETRY
from terrace.sources.tiff import opened
from terrace.sources.vector import with_places

# Kinds of shapes by the last digit of their code (with heights 1x, with measures 2x); sizes of headers.
KINDS = {1: "point", 3: "line", 5: "polygon", 8: "point"}
HEADER, INDEX_ENTRY, FIELD = 100, 8, 32
#: Records that one task reads.
TASK_RECORDS = 50_000

_PLACE = pa.struct([("x", pa.float64()), ("y", pa.float64())])
_SHAPE = pa.struct([("kind", pa.string()), ("parts", pa.list_(pa.list_(pa.list_(_PLACE))))])


def fields_of(head: bytes) -> list[tuple[str, str, int, int]]:
    """name, kind, place in a record and width of the attributes, from the head of a table of attributes."""
    found, at = [], 1
    for k in range(FIELD, len(head) - 1, FIELD):
        if head[k] == 0x0D:
            break
        found.append((head[k : k + 11].split(b"\0")[0].decode("latin-1"), chr(head[k + 11]), at, head[k + 16]))
        at += head[k + 16]
    return found


def _turn(ring: np.ndarray) -> float:
    """Twice the area of a ring, below 0 if it goes clockwise."""
    x, y = ring[:, 0] - ring[0, 0], ring[:, 1] - ring[0, 1]
    return float(np.dot(x[:-1], y[1:]) - np.dot(x[1:], y[:-1]))


def _holds(ring: np.ndarray, p: np.ndarray) -> bool:
    (ax, ay), (bx, by) = ring[:-1].T, ring[1:].T
    over = (ay > p[1]) != (by > p[1])
    return bool(np.sum(p[0] < ((bx - ax) * (p[1] - ay) / np.where(by == ay, 1, by - ay) + ax)[over]) % 2)


def _parts(rings: list[np.ndarray]) -> list[list[np.ndarray]]:
    """Outer rings go clockwise; a hole joins the smallest outer ring that holds it, or is a part of its own if none does."""
    turns = [_turn(r) for r in rings]
    parts = [[r] for r, t in zip(rings, turns, strict=True) if t < 0]
    sizes = [-t for t in turns if t < 0]
    for r, t in zip(rings, turns, strict=True):
        if t >= 0:
            around = [k for k in range(len(sizes)) if _holds(parts[k][0], r[0])]
            if around:
                parts[min(around, key=sizes.__getitem__)].append(r)
            else:
                parts.append([r])
    return parts


def shape_of(content: bytes) -> dict | None:
    """The geometry of one record; heights and measures are left out. A kind that isn't known is an error."""
    code = struct.unpack_from("<i", content)[0]
    if code == 0:
        return None
    kind = KINDS.get(code % 10) if code < 30 else None
    if kind is None:
        raise ValueError(f"unknown kind of shape: {code}")
    if code % 10 == 1:
        points, bounds = np.frombuffer(content, "<f8", 2, 4).reshape(1, 2), [0, 1]
    elif kind == "point":
        points = np.frombuffer(content, "<f8", 2 * struct.unpack_from("<i", content, 36)[0], 40).reshape(-1, 2)
        bounds = list(range(len(points) + 1))
    else:
        parts, many = struct.unpack_from("<2i", content, 36)
        points = np.frombuffer(content, "<f8", 2 * many, 44 + 4 * parts).reshape(-1, 2)
        bounds = [*struct.unpack_from(f"<{parts}i", content, 44), many]
    rings = [points[a:b] for a, b in zip(bounds, bounds[1:])]
    nested = _parts(rings) if kind == "polygon" else [[r] for r in rings]
    return {"kind": kind, "parts": [[[{"x": x, "y": y} for x, y in r.tolist()] for r in p] for p in nested]} if nested else None


def read_shapefile(spark: SparkSession, path: str, properties: str, *, encoding: str = "utf-8", task_records: int = TASK_RECORDS) -> DataFrame:
    """properties, x, y, ring and geometry (as read_geojson has them) of a .shp file with its .shx and .dbf. properties: DDL of attributes that are wanted.

    Records without a shape stay, with nulls; deleted ones are left out. Blank attributes are null, and so are those that the wanted type can't hold.
    """
    stem = path[: -len(".shp")]
    if not path.lower().endswith(".shp"):
        raise ValueError(f"{path} isn't a .shp file")
    small = path[-1].islower()
    ext = lambda name: f"{stem}.{name if small else name.upper()}"
    many = (struct.unpack(">i", opened(ext("shx"))(24, 4))[0] * 2 - HEADER) // INDEX_ENTRY
    table = opened(ext("dbf"))
    rows, head, width = struct.unpack("<IHH", table(4, 8))
    if rows != many:
        raise ValueError(f"{many} shapes, {rows} rows of attributes in {path}")
    wanted = [(f.name, f.dataType.simpleString()) for f in spark.createDataFrame([], properties).schema]
    own = {name: (kind, at, size) for name, kind, at, size in fields_of(table(0, head))}
    if missing := [n for n, _ in wanted if n not in own]:
        raise ValueError(f"no attributes {missing} among {sorted(own)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes, index, table = opened(path), opened(ext("shx")), opened(ext("dbf"))
        for first in (x for b in batches for x in b.column(0).to_pylist()):
            n = min(task_records, many - first * task_records)
            at = first * task_records
            entries = np.frombuffer(index(HEADER + INDEX_ENTRY * at, INDEX_ENTRY * n), ">i4").reshape(-1, 2).astype(np.int64) * 2
            low, high = entries[:, 0].min(), (entries.sum(axis=1) + 8).max()
            data, text = shapes(int(low), int(high - low)), table(head + width * at, width * n)
            keep = [k for k in range(n) if text[k * width : k * width + 1] != b"*"]
            made = [shape_of(data[a - low + 8 : a - low + 8 + size]) for a, size in entries[keep].tolist()]
            cols = [pa.array([text[k * width + own[c][1] : k * width + own[c][1] + own[c][2]].decode(encoding, "replace").strip(" \0") or None for k in keep], pa.string()) for c, _ in wanted]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(made, _SHAPE)], names=[*(f"a{k}" for k in range(len(wanted))), "geometry"])

    splits = -(-many // task_records)
    raw = spark.range(0, splits, 1, max(1, splits)).mapInArrow(run, ", ".join([*(f"a{k} string" for k in range(len(wanted))), f"geometry {GEOMETRY}"]))

    def typed(c: Column, name: str, kind: str) -> Column:
        if own[name][0] == "D" and kind == "date":
            return F.try_to_date(c, "yyyyMMdd")
        if own[name][0] == "L" and kind == "boolean":
            return F.when(F.upper(c).isin("T", "Y"), True).when(F.upper(c).isin("F", "N"), False)
        return c.try_cast(kind)

    return with_places(raw.select(*[typed(F.col(f"a{k}"), name, kind).alias(name) for k, (name, kind) in enumerate(wanted)], "geometry"))
