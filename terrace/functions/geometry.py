"""Geometries as a column: a kind (point, line, polygon) and parts of rings of points, so that holes, several parts and lines are kept.

A polygon's part is its outer ring and its holes, a line's part one open ring, a point's part a ring of one point. A place is inside
a polygon if a line from it crosses an odd number of sides of all rings. A plain `ring` (an array of points) counts as a polygon.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from terrace.grid import GridSpec

POINT = "struct<x:double,y:double>"
GEOMETRY = f"struct<kind:string,parts:array<array<array<{POINT}>>>>"

# The kinds of GeoJSON, what they are here, and how deep their coordinates are nested.
GEOJSON = {"Point": ("point", 1), "MultiPoint": ("point", 2), "LineString": ("line", 2), "MultiLineString": ("line", 3), "Polygon": ("polygon", 3), "MultiPolygon": ("polygon", 4)}


def column_of(df: DataFrame, ring: str = "ring") -> str:
    """The column that holds shapes: `geometry` where there is one, else ring."""
    return "geometry" if "geometry" in df.columns else ring


def has_shapes(df: DataFrame) -> bool:
    return "geometry" in df.columns or "ring" in df.columns


def geometry_of(df: DataFrame, name: str) -> Column:
    """The column as a geometry, if it is one or a ring; null and empty ones stay null."""
    kind = df.schema[name].dataType
    if isinstance(kind, StructType):
        return F.when(F.size(F.col(name)["parts"]) > 0, F.col(name))
    if not isinstance(kind, ArrayType):
        raise ValueError(f"{name} is neither a geometry nor a ring")
    return polygon(F.array(F.col(name)))


def once(value: Column, how) -> Column:
    """how(value), where value is made once however often how names it."""
    return F.transform(F.array(value), how)[0]


def polygon(*parts: Column) -> Column:
    """A polygon of parts, each an array of rings, the outer one first; null if a ring is."""
    made = F.struct(F.lit("polygon").alias("kind"), F.array(*parts).alias("parts"))
    whole = F.lit(True)
    for p in parts:
        whole = whole & F.forall(p, lambda r: r.isNotNull())
    return F.when(whole, made)


def line(*parts: Column) -> Column:
    """A line of parts, each an array of points."""
    return F.struct(F.lit("line").alias("kind"), F.array(*[F.array(p) for p in parts]).alias("parts"))


def rings(geometry: Column) -> Column:
    return F.flatten(geometry["parts"])


def corners(geometry: Column) -> Column:
    return F.flatten(rings(geometry))


def sides(geometry: Column) -> Column:
    """a, b of every side of a line or polygon; a polygon's ring that is open is closed."""
    def of_ring(r: Column) -> Column:
        n = F.size(r)
        along = F.when(n > 1, F.zip_with(F.slice(r, 1, F.greatest(n - 1, F.lit(1))), F.slice(r, 2, F.greatest(n - 1, F.lit(1))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).otherwise(F.array())
        last = F.try_element_at(r, F.lit(-1))
        opened = (geometry["kind"] == "polygon") & (n > 2) & (last != F.try_element_at(r, F.lit(1)))
        return F.when(opened, F.concat(along, F.array(F.struct(last.alias("a"), F.try_element_at(r, F.lit(1)).alias("b"))))).otherwise(along)

    return F.flatten(F.transform(rings(geometry), of_ring))


def crosses(side: Column, y: Column) -> Column:
    """Whether a side meets the line at y; a side along it doesn't, of two that share a corner on it one does, or both."""
    return (side["a"]["y"] > y) != (side["b"]["y"] > y)


def crossing_x(side: Column, y: Column) -> Column:
    a, b = side["a"], side["b"]
    return (b["x"] - a["x"]) * (y - a["y"]) / F.when(b["y"] != a["y"], b["y"] - a["y"]).otherwise(1.0) + a["x"]


def contains(geometry: Column, x: Column, y: Column) -> Column:
    """Whether a polygon holds a place, by the even-odd rule over all its rings; false for lines and points, null for null."""
    hit = F.filter(sides(geometry), lambda s: crosses(s, y) & (x < crossing_x(s, y)))
    return (geometry["kind"] == "polygon") & (F.size(hit) % 2 == 1)


def crossings_at(geometry: Column, y: Column) -> Column:
    """Where the sides cross the line at y, ascending."""
    return F.array_sort(F.transform(F.filter(sides(geometry), lambda s: crosses(s, y)), lambda s: crossing_x(s, y)))


def stretches(geometry: Column, grid: GridSpec) -> Column:
    """row, low, high of the stretches inside a polygon along the centres of the grid's rows.

    Each side gives a crossing for each row that it passes. Closed rings cross a row an even number of times, so of all crossings
    in order of row and place, two by two, the first of a pair opens a stretch and the second ends it: work follows the outline.
    """
    def of_side(s: Column) -> Column:
        at = lambda p: (p["y"] - grid.f) / grid.e
        low = F.greatest(F.floor(F.least(at(s["a"]), at(s["b"]))) - 1, F.lit(0))
        high = F.least(F.ceil(F.greatest(at(s["a"]), at(s["b"]))) + 1, F.lit(grid.height - 1))
        rows = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
        centre = lambda r: (r + 0.5) * grid.e + grid.f
        return F.transform(F.filter(rows, lambda r: crosses(s, centre(r))), lambda r: F.struct(r.alias("row"), crossing_x(s, centre(r)).alias("x")))

    every = F.array_sort(F.flatten(F.transform(sides(geometry), of_side)))
    pairs = lambda c: F.when(F.size(c) > 1, F.transform(F.sequence(F.lit(1), F.floor(F.size(c) / 2)), lambda k: F.struct(F.element_at(c, (2 * k).cast("int"))["row"].alias("row"), F.element_at(c, (2 * k - 1).cast("int"))["x"].alias("low"), F.element_at(c, (2 * k).cast("int"))["x"].alias("high"))))
    return once(every, pairs)


def moved(geometry: Column, how) -> Column:
    """The geometry with how(point) in place of each point."""
    parts = F.transform(geometry["parts"], lambda p: F.transform(p, lambda r: F.transform(r, how)))
    return F.when(geometry.isNotNull(), F.struct(geometry["kind"].alias("kind"), parts.alias("parts")))


def from_geojson(kind: Column, coordinates: Column) -> Column:
    """The geometry of GeoJSON's type and coordinates (as text); null stays null, a type that isn't known stops the query."""
    nested = lambda deep: F.from_json(coordinates, "array<" * deep + "double" + ">" * deep)
    point = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    ring = lambda r: F.transform(r, point)
    parts = {
        "Point": lambda c: F.array(F.array(F.array(point(c)))), "MultiPoint": lambda c: F.transform(c, lambda p: F.array(F.array(point(p)))),
        "LineString": lambda c: F.array(F.array(ring(c))), "MultiLineString": lambda c: F.transform(c, lambda r: F.array(ring(r))),
        "Polygon": lambda c: F.array(F.transform(c, ring)), "MultiPolygon": lambda c: F.transform(c, lambda p: F.transform(p, ring)),
    }
    out = F.when(kind.isNotNull(), F.raise_error(F.concat(F.lit("unknown kind of geometry: "), kind)).cast(GEOMETRY))
    for name, (own, deep) in GEOJSON.items():
        found = nested(deep)
        made = F.struct(F.lit(own).alias("kind"), parts[name](found).alias("parts"))
        out = F.when(kind == name, F.when(found.isNotNull() & (F.size(found) > 0), made)).otherwise(out)
    return out


def to_geojson(geometry: Column) -> Column:
    """The geometry as GeoJSON text; null gives null."""
    flat = lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"]))
    many = F.size(geometry["parts"]) > 1
    parts = {"point": F.transform(geometry["parts"], lambda p: flat(p[0])[0]), "line": F.transform(geometry["parts"], lambda p: flat(p[0])), "polygon": F.transform(geometry["parts"], lambda p: F.transform(p, flat))}
    names = {"point": "Point", "line": "LineString", "polygon": "Polygon"}
    out = F.lit(None).cast("string")
    for kind, made in parts.items():
        text = F.when(many, F.concat(F.lit(f'{{"type":"Multi{names[kind]}","coordinates":'), F.to_json(made))).otherwise(F.concat(F.lit(f'{{"type":"{names[kind]}","coordinates":'), F.to_json(F.try_element_at(made, F.lit(1)))))
        out = F.when(geometry["kind"] == kind, F.concat(text, F.lit("}"))).otherwise(out)
    return out
