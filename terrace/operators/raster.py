"""Composites, mosaics, stacks and resampling of pixel tables."""

from __future__ import annotations

import json
import math
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.functions import geometry
from terrace.functions.crs import reproject
from terrace.functions.scalars import finite, spectral_index, stretch
from terrace.grid import GridSpec
from terrace.operators.focal import slope_aspect
from terrace.operators.quantiles import exact_quantiles


def composite(scenes: DataFrame, keys: list[str], value: str = "value", order: str = "ord", method: str = "median") -> DataFrame:
    """keys, value: the median or the first (by order) of the finite values of each key; null if there is none."""
    v = F.when(finite(F.col(value)), F.col(value))
    if method not in ("median", "first"):
        raise ValueError(f"unknown method {method}")
    made = F.median(v) if method == "median" else F.min_by(v, F.when(v.isNotNull(), F.col(order)))
    return scenes.groupBy(*keys).agg(made.alias(value))


def mosaic(tiles: list[DataFrame], value: str = "cls", nodata: int = 0, method: str = "max") -> DataFrame:
    """row, col, value over the union of tiles (on one grid); where several have data the largest, the smallest, the first or the last tile's counts."""
    rows = reduce(DataFrame.unionByName, [t.select("row", "col", F.col(value).alias("v"), F.lit(k).alias("ord")) for k, t in enumerate(tiles)])
    v = F.when(F.col("v") != nodata, F.col("v"))
    ordered = F.when(v.isNotNull(), F.col("ord"))
    made = {"max": F.max(v), "min": F.min(v), "first": F.min_by(v, ordered), "last": F.max_by(v, ordered)}
    if method not in made:
        raise ValueError(f"unknown method {method}")
    return rows.groupBy("row", "col").agg(F.coalesce(made[method], F.lit(nodata)).alias(value))


def stack(layers: dict[str, DataFrame], value: str = "value") -> DataFrame:
    """row, col and a column for each layer, on the pixels of the first. One shuffle: layers are tagged, gathered and pivoted."""
    if len(set(layers)) != len(layers) or not layers:
        raise ValueError("layers have different names")
    names = list(layers)
    rows = reduce(DataFrame.unionByName, [t.select("row", "col", F.lit(n).alias("layer"), F.col(value).cast("double").alias("v")) for n, t in layers.items()])
    wide = rows.groupBy("row", "col").agg(*[F.max(F.when(F.col("layer") == n, F.col("v"))).alias(n) for n in names], F.max(F.col("layer") == names[0]).alias("_own"))
    return wide.where("_own").drop("_own")


def feature_stack(bands: DataFrame, indices: list[str], dem: DataFrame | None = None, grid: GridSpec | None = None) -> DataFrame:
    """row, col, the bands, the indices by lower-case name and, with dem (row, col, z), slope and aspect."""
    own = [c for c in bands.columns if c not in ("row", "col")]
    out = bands.select("row", "col", *own, *[spectral_index(i, own).alias(i.lower()) for i in indices])
    if len(set(out.columns)) != len(out.columns):
        raise ValueError("features have different names")
    if dem is None:
        return out
    x, y = (abs(grid.a), abs(grid.e)) if grid else (10.0, 10.0)
    return out.join(slope_aspect(dem, "z", x, y), ["row", "col"], "left")


@dataclass(frozen=True)
class Layer:
    """One raster of a feature: its name (an asset, or a file's stem), pixels (row, col, value), grid, and what is known of where it comes from."""

    name: str
    pixels: DataFrame
    grid: GridSpec
    source: dict[str, str] = field(default_factory=dict)


def normalise_inputs(imagery: Iterable[Layer], layers: Iterable[Layer] = (), aliases: dict[str, str] | None = None) -> tuple[dict[str, list[Layer]], list[dict[str, str]]]:
    """(layers by feature name, in order; their sources): repeated names are one feature."""
    grouped: dict[str, list[Layer]] = {}
    for one in [*imagery, *layers]:
        grouped.setdefault((aliases or {}).get(one.name, one.name), []).append(one)
    if not grouped:
        raise ValueError("there are no layers")
    return grouped, [{"asset": one.name, **one.source} for group in grouped.values() for one in group]


def target_grid(first: GridSpec, epsg: int | None = None, resolution: float | None = None) -> GridSpec:
    """The grid of a stack: that of the first layer, or its extent in another coordinate system or at another resolution (in units of the system), rounded up."""
    from terrace.functions.crs import reproject_box

    target = epsg or first.epsg
    if resolution is not None and target == 4326:
        raise ValueError("a resolution in metres takes a projected coordinate system")
    if target == first.epsg and resolution is None:
        return first
    west, north, east, south = first.c, first.f, first.c + first.width * first.a, first.f + first.height * first.e
    west, south, east, north = reproject_box((min(west, east), min(north, south), max(west, east), max(north, south)), first.epsg, target)
    size = resolution or max(abs(first.a), abs(first.e))
    width, height = max(1, math.ceil((east - west) / size)), max(1, math.ceil((north - south) / size))
    return GridSpec(height, width, (east - west) / width, 0.0, west, 0.0, (south - north) / height, north, target)


def create_feature_stack(
    imagery: Iterable[Layer], *, method: str = "median", indices: Iterable[str] = (), layers: Iterable[Layer] = (), aliases: dict[str, str] | None = None, terrain_from: Iterable[str] = (), epsg: int | None = None, resolution: float | None = None, nearest: Iterable[str] = (),
) -> tuple[DataFrame, list[str], str]:
    """(row, col and the features on one grid; their names in order; the manifest as JSON).

    Layers of one feature are brought to the grid by bilinear resampling where theirs differs (features named in nearest, such as
    classes: by their nearest pixels), and composited (median or first valid; classes the first valid); indices are of the features, slope and aspect of those in terrain_from. Every pixel of the grid that any feature has is there.
    """
    if method.lower() not in ("median", "first_valid"):
        raise ValueError(f"unknown method {method}")
    grouped, sources = normalise_inputs(imagery, layers, aliases)
    grid = target_grid(next(iter(grouped.values()))[0].grid, epsg, resolution)
    indices, terrain_from = [i.upper() for i in indices], list(terrain_from)
    lacking = [n for n in terrain_from if n not in grouped]
    if lacking:
        raise ValueError(f"terrain sources that are no features: {lacking}")
    names = [*grouped, *indices, *[f"{n}_{x}" for n in terrain_from for x in ("slope", "aspect")]]
    if len(set(names)) != len(names):
        raise ValueError("features have different names")
    nearest = set(nearest)
    if unknown := nearest - set(grouped):
        raise ValueError(f"no features {sorted(unknown)}")
    made = {}
    for name, group in grouped.items():
        ready = [aligned(one, grid, name in nearest).select("row", "col", F.col("value").cast("double").alias("value"), F.lit(k).alias("ord")) for k, one in enumerate(group)]
        made[name] = composite(reduce(DataFrame.unionByName, ready), ["row", "col"], method="first" if method.lower() == "first_valid" or name in nearest else "median")
    rows = reduce(DataFrame.unionByName, [t.select("row", "col", F.lit(n).alias("layer"), F.col("value").alias("v")) for n, t in made.items()])
    wide = rows.groupBy("row", "col").agg(*[F.max(F.when(F.col("layer") == n, F.col("v"))).alias(n) for n in made])
    wide = wide.select("*", *[spectral_index(i, list(made)).alias(i) for i in indices])
    for n in terrain_from:
        slopes = slope_aspect(made[n].withColumnRenamed("value", "z"), "z", abs(grid.a), abs(grid.e))
        wide = wide.join(slopes.select("row", "col", F.col("slope").alias(f"{n}_slope"), F.col("aspect").alias(f"{n}_aspect")), ["row", "col"], "left")
    about = {"feature_names": names, "composite": method.lower(), "epsg": grid.epsg, "resolution": resolution, "sources": sources}
    return wide.select("row", "col", *names), names, json.dumps(about, indent=2)


def warp_nearest(source: DataFrame, source_grid: GridSpec, target: GridSpec, cols: list[str]) -> DataFrame:
    """row, col, cols on the target grid, of any known coordinate system: its pixels whose centre lies in a source pixel that there is, for classes and masks."""
    spark = source.sparkSession
    cells = spark.range(target.height * target.width).select(F.floor(F.col("id") / target.width).alias("row"), (F.col("id") % target.width).alias("col"))
    x, y = reproject(*target.centre_of(F.col("row"), F.col("col")), target.epsg, source_grid.epsg)
    row, col = source_grid.pixel_of(x, y)
    t = cells.select("row", "col", row.alias("_r"), col.alias("_c"))
    return t.join(source.select(F.col("row").alias("_r"), F.col("col").alias("_c"), *cols), ["_r", "_c"]).select("row", "col", *cols)


def stack_layers(layers: list[Layer], grid: GridSpec | None = None, nearest: Iterable[str] = ()) -> DataFrame:
    """stack of layers of any grids and coordinate systems, brought to one grid (the first one's, if not given).

    Layers named in nearest (classes, masks) take the pixel that holds a centre, the others the mean of the four around it. There are the
    pixels of the first layer, once it is on the grid.
    """
    if not layers or len({one.name for one in layers}) != len(layers):
        raise ValueError("layers have different names")
    nearest, grid = set(nearest), grid or layers[0].grid
    if unknown := nearest - {one.name for one in layers}:
        raise ValueError(f"no layers {sorted(unknown)}")
    return stack({one.name: aligned(one, grid, one.name in nearest) for one in layers})


def aligned(one: Layer, grid: GridSpec, nearest: bool) -> DataFrame:
    """row, col, value of a layer on a grid."""
    if one.grid == grid:
        return one.pixels.select("row", "col", "value")
    return warp_nearest(one.pixels, one.grid, grid, ["value"]) if nearest else warp_bilinear(one.pixels, one.grid, grid, "value")


def warp_bilinear(source: DataFrame, source_grid: GridSpec, target: GridSpec, value: str) -> DataFrame:
    """row, col, value on the target grid, of any known coordinate system: all its pixels whose centre lies in the source."""
    spark = source.sparkSession
    cells = spark.range(target.height * target.width).select(F.floor(F.col("id") / target.width).alias("row"), (F.col("id") % target.width).alias("col"))
    x, y = reproject(*target.centre_of(F.col("row"), F.col("col")), target.epsg, source_grid.epsg)
    cells = cells.withColumns({"_x": x, "_y": y})
    r, c = source_grid.pixel_of(F.col("_x"), F.col("_y"))
    return _bilinear(source, source_grid, cells.where(source_grid.inside(r, c)), value)


def valid_mask(pixels: DataFrame, value: str = "cls", nodata: float = 0) -> DataFrame:
    """row, col, mask: 255 where a pixel has data, else 0."""
    good = F.coalesce((F.col(value) != nodata) & finite(F.col(value).cast("double")), F.lit(False))
    return pixels.select("row", "col", F.when(good, 255).otherwise(0).alias("mask"))


def distance_features(sources: dict[str, DataFrame], grid: GridSpec) -> DataFrame:
    """row, col and a distance for each name: to the nearest pixel that its features touch (polygons with a ring, geometries of any kind, such as lines) or hold (points x, y); nothing on the grid means an error."""
    from terrace.operators.focal import distance_to

    if grid.geographic:
        raise ValueError("distances take a projected grid")
    if not sources:
        raise ValueError("there are no features")
    spark = next(iter(sources.values())).sparkSession
    cells = spark.range(grid.height * grid.width).select(F.floor(F.col("id") / grid.width).alias("row"), (F.col("id") % grid.width).alias("col"))
    out = None
    for name, rows in sources.items():
        if geometry.has_shapes(rows):
            hit = rasterize_touched(rows.select(geometry.column_of(rows)), grid)
        else:
            r, c = grid.pixel_of(F.col("x"), F.col("y"))
            hit = rows.select(r.alias("row"), c.alias("col")).where(grid.inside(F.col("row"), F.col("col"))).distinct()
        if hit.isEmpty():
            raise ValueError(f"no features of {name} on the grid")
        own = distance_to(cells.join(hit.withColumn("_hit", F.lit(True)), ["row", "col"], "left"), F.coalesce("_hit", F.lit(False)), abs(grid.a), abs(grid.e)).withColumnRenamed("distance", name)
        out = own if out is None else out.join(own, ["row", "col"])
    return out


def resample_nearest(source: DataFrame, source_grid: GridSpec, target: DataFrame, target_grid: GridSpec, cols: list[str]) -> DataFrame:
    """row, col of target and cols of the source pixel that holds each target pixel's centre, of any known coordinate systems; null beyond the source."""
    x, y = reproject(*target_grid.centre_of(F.col("row"), F.col("col")), target_grid.epsg, source_grid.epsg)
    row, col = source_grid.pixel_of(x, y)
    t = target.select("row", "col", row.alias("_r"), col.alias("_c"))
    s = source.select(F.col("row").alias("_r"), F.col("col").alias("_c"), *cols)
    return t.join(s, ["_r", "_c"], "left").select("row", "col", *cols)


def resample_bilinear(source: DataFrame, source_grid: GridSpec, target: DataFrame, target_grid: GridSpec, value: str) -> DataFrame:
    """row, col, value: the mean of the four source pixels around each target centre, by nearness; missing ones are left out."""
    x, y = reproject(*target_grid.centre_of(F.col("row"), F.col("col")), target_grid.epsg, source_grid.epsg)
    return _bilinear(source, source_grid, target.select("row", "col", x.alias("_x"), y.alias("_y")), value)


def _bilinear(source: DataFrame, source_grid: GridSpec, target: DataFrame, value: str) -> DataFrame:
    """target: row, col and the place _x, _y in the source's coordinates."""
    fy, fx = (F.col("_y") - source_grid.f) / source_grid.e - 0.5, (F.col("_x") - source_grid.c) / source_grid.a - 0.5
    t = target.select("row", "col", fy.alias("_y"), fx.alias("_x"))
    part = lambda at, near: 1 - F.abs(at - near)
    corners = F.array(*[F.struct((F.floor("_y") + i).alias("r"), (F.floor("_x") + j).alias("c")) for i in (0, 1) for j in (0, 1)])
    each = t.withColumn("_k", F.explode(corners)).select("row", "col", F.col("_k.r").alias("_r"), F.col("_k.c").alias("_c"), (part(F.col("_y"), F.col("_k.r")) * part(F.col("_x"), F.col("_k.c"))).alias("_w"))
    joined = each.where("_w > 0").join(source.select(F.col("row").alias("_r"), F.col("col").alias("_c"), F.col(value).alias("_v")).where(finite(F.col("_v"))), ["_r", "_c"])
    done = joined.groupBy("row", "col").agg((F.sum(F.col("_v") * F.col("_w")) / F.sum("_w")).alias(value))
    return target.select("row", "col").join(done, ["row", "col"], "left")


def _bands_long(pixels: DataFrame, bands: list[str], keep) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.when(keep(F.col(b)), F.col(b).cast("double")).alias("v")) for b in bands]))
    return pixels.select(each.alias("x")).select("x.*")


def percent_stretch(pixels: DataFrame, bands: list[str], low: float = 0.02, high: float = 0.98) -> DataFrame:
    """pixels with bands stretched from 0 to 1 between two exact percentiles of their values above 0; null where a band has none."""
    ends = exact_quantiles(_bands_long(pixels, bands, lambda x: finite(x.cast("double")) & (x > 0)), F.col("band"), F.col("v"), (low, high))
    unit = [stretch(F.col(b), F.lit(ends[b][0]), F.lit(ends[b][1])).alias(b) if b in ends else F.lit(None).cast("double").alias(b) for b in bands]
    return pixels.select(*[c for c in pixels.columns if c not in bands], *unit)


def make_features(pixels: DataFrame, bands: list[str], low: float = 0.02, high: float = 0.98) -> DataFrame:
    """row, col, the bands and ndvi, each stretched between two percentiles, of pixels whose bands are all finite and above 0."""
    good = pixels.where(reduce(lambda a, b: a & b, [finite(F.col(b).cast("double")) & (F.col(b) > 0) for b in bands]))
    made = good.select("row", "col", *[F.col(b).cast("double").alias(b) for b in bands], spectral_index("NDVI", bands).alias("ndvi"))
    ends = exact_quantiles(_bands_long(made, [*bands, "ndvi"], lambda x: finite(x)), F.col("band"), F.col("v"), (low, high))
    return made.select("row", "col", *[stretch(F.col(b), F.lit(ends[b][0]), F.lit(ends[b][1])).alias(b) if b in ends else F.lit(None).cast("double").alias(b) for b in [*bands, "ndvi"]])


def band_statistics(pixels: DataFrame, bands: list[str], quantiles: tuple[float, ...] = (0.5, 0.99)) -> DataFrame:
    """band, max, mean and exact quantiles (q50, q99 ...) of each band."""
    rows = _bands_long(pixels, bands, lambda x: x.isNotNull())
    at = exact_quantiles(rows, F.col("band"), F.col("v"), quantiles)
    names = [f"q{round(q * 100)}" for q in quantiles]
    table = pixels.sparkSession.createDataFrame([(b, *at.get(b, [None] * len(names))) for b in bands], "band string, " + ", ".join(f"{n} double" for n in names))
    return rows.groupBy("band").agg(F.max("v").alias("max"), F.avg("v").alias("mean")).join(F.broadcast(table), "band").select("band", "max", "mean", *names)


def rasterize_touched(features: DataFrame, grid: GridSpec, ring: str = "ring") -> DataFrame:
    """features, without their shapes, with row, col of every pixel that they touch: pixels inside polygons, those that a side of a polygon or line passes, and those that hold points.

    Shapes are a `geometry`, else rings. Sides are rows of their own, cut at the grid's lines: between two cuts a side is in one pixel.
    Parts of sides off the grid are left out before they are cut.
    """
    from terrace.operators.sampling import point_parts, polygon_pixels

    shape = geometry.column_of(features, ring)
    names = [c for c in features.columns if c not in (shape, ring)]
    own = features.select(*names, geometry.geometry_of(features, shape).alias("geometry"))
    each = own.select(*names, F.explode(geometry.sides(F.col("geometry"))).alias("_side"))
    u = lambda p: (F.col(f"_side.{p}.x") - grid.c) / grid.a
    v = lambda p: (F.col(f"_side.{p}.y") - grid.f) / grid.e
    each = each.select(*names, u("a").alias("_u0"), v("a").alias("_v0"), u("b").alias("_u1"), v("b").alias("_v1"))
    near = lambda a, b, most: (F.greatest(a, b) >= 0) & (F.least(a, b) <= most)
    each = each.where(near(F.col("_u0"), F.col("_u1"), grid.width) & near(F.col("_v0"), F.col("_v1"), grid.height))

    def cut(a: Column, b: Column, most: int) -> Column:
        low, high = F.greatest(F.ceil(F.least(a, b)), F.lit(0)), F.least(F.floor(F.greatest(a, b)), F.lit(most))
        return F.when((low <= high) & (a != b), F.transform(F.sequence(low, high), lambda k: (k - a) / (b - a))).otherwise(F.array().cast("array<double>"))

    stops = F.array_sort(F.array_union(F.array_union(F.array(F.lit(0.0), F.lit(1.0)), cut(F.col("_u0"), F.col("_u1"), grid.width)), cut(F.col("_v0"), F.col("_v1"), grid.height)))
    each = each.withColumn("_t", stops).withColumn("_k", F.explode(F.sequence(F.lit(1), F.size("_t") - 1)))
    mid = (F.element_at("_t", F.col("_k")) + F.element_at("_t", F.col("_k") + 1)) / 2
    row, col = F.floor(F.col("_v0") + mid * (F.col("_v1") - F.col("_v0"))), F.floor(F.col("_u0") + mid * (F.col("_u1") - F.col("_u0")))
    edge = each.select(*names, row.cast("long").alias("row"), col.cast("long").alias("col")).where(grid.inside(F.col("row"), F.col("col")))
    inside = polygon_pixels(own, grid).select(*names, "row", "col")
    return edge.unionByName(inside).unionByName(point_parts(own, grid).select(*names, "row", "col")).dropDuplicates([*names, "row", "col"])
