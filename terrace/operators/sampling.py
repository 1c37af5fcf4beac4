"""Samples: pixels under points and polygons, clean rows, splits, flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.functions import geometry
from terrace.functions.crs import reproject
from terrace.functions.scalars import all_of, finite, spectral_index
from terrace.grid import GridSpec


def point_pixels(points: DataFrame, pixels: DataFrame, grid: GridSpec, *, bands: list[str], label: str = "class_id", x: str = "x", y: str = "y", keep: tuple[str, ...] = ("point_id",)) -> DataFrame:
    """keep, label and bands of the pixel that holds each point; points without label or place, and pixels with a band that isn't finite, are left out."""
    row, col = grid.pixel_of(F.col(x), F.col(y))
    own = points.where(F.col(label).isNotNull() & F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keep, label, row.alias("row"), col.alias("col")).where(grid.inside(F.col("row"), F.col("col")))
    good = pixels.where(all_of([finite(F.col(b)) for b in bands])).select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), *bands)
    return own.join(good, ["row", "col"]).select(*keep, label, "row", "col", *bands)


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point lies in a closed ring (an array of x, y structs), by the even-odd rule."""
    n = F.size(ring)
    sides = F.zip_with(F.slice(ring, 1, n - 1), F.slice(ring, 2, n - 1), lambda a, b: ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.when(b["y"] != a["y"], b["y"] - a["y"]).otherwise(1.0) + a["x"]))
    return F.aggregate(sides, F.lit(False), lambda a, s: a != F.coalesce(s, F.lit(False)))


def with_interior_point(polygons: DataFrame, ring: str = "ring", x: str = "x", y: str = "y") -> DataFrame:
    """polygons with a point inside: the middle of the widest stretch inside, on lines half way between the corners next to the middle of a ring's height.

    Shapes are a `geometry`, else rings; stretches inside leave out holes. Points and lines get their first point.
    """
    shape = geometry.column_of(polygons, ring)
    keep = [c for c in polygons.columns if c not in (x, y)]

    def along(g: Column, at: Column, order: Column) -> Column:
        """wide, order, k, x, y of the stretches inside on the line at a height."""
        def of_cuts(cuts: Column) -> Column:
            low, high = lambda k: F.element_at(cuts, 2 * k - 1), lambda k: F.element_at(cuts, 2 * k)
            pair = lambda k: F.struct((high(k) - low(k)).alias("wide"), (-order).alias("order"), (-k).alias("k"), ((high(k) + low(k)) / 2).alias("x"), at.alias("y"))
            many = F.floor(F.size(cuts) / 2).cast("int")
            return F.when(many > 0, F.transform(F.sequence(F.lit(1), F.greatest(many, F.lit(1))), pair))

        return geometry.once(geometry.crossings_at(g, at), of_cuts)

    def height(ring: Column, ys: Column) -> Column:
        own = F.transform(ring, lambda p: p["y"])
        middle = (F.array_max(own) + F.array_min(own)) / 2
        below, above = F.array_max(F.filter(ys, lambda v: v <= middle)), F.array_min(F.filter(ys, lambda v: v > middle))
        return (below + F.coalesce(above, below)) / 2

    def inside(g: Column) -> Column:
        lines = geometry.once(F.transform(geometry.corners(g), lambda p: p["y"]), lambda ys: F.array_distinct(F.transform(geometry.rings(g), lambda r: height(r, ys))))
        found = geometry.once(lines, lambda at: F.array_max(F.flatten(F.array_compact(F.transform(at, lambda y, k: along(g, y, k))))))
        first = F.try_element_at(geometry.corners(g), F.lit(1))
        return geometry.once(F.when(g["kind"] == "polygon", found), lambda best: F.when(best.isNotNull(), F.struct(best["x"].alias("x"), best["y"].alias("y"))).otherwise(first))

    # Exploded, so that what is asked of the point isn't asked of the whole expression again.
    at = F.explode(F.array(geometry.once(geometry.geometry_of(polygons, shape), inside))).alias("_inside")
    return polygons.select(*keep, at).select(*keep, F.col("_inside.x").alias(x), F.col("_inside.y").alias(y))


def polygon_pixels(polygons: DataFrame, grid: GridSpec, ring: str = "ring") -> DataFrame:
    """polygons with row, col of every pixel whose centre they hold by the even-odd rule over all rings. Overlapping polygons each get theirs; points and lines hold none.

    Shapes are a `geometry`, else rings. A polygon is cut into the stretches of rows inside it; only then are there pixels, without the shape.
    """
    shape = geometry.column_of(polygons, ring)
    key = [c for c in polygons.columns if c not in (shape, ring, "row", "col")]
    own = polygons.select(*key, geometry.geometry_of(polygons, shape).alias("_g")).where("_g.kind = 'polygon'")
    parts = own.select(*key, F.explode(geometry.stretches(F.col("_g"), grid)).alias("_p")).select(*key, F.col("_p.row").alias("row"), "_p.low", "_p.high")
    edge = lambda x: F.floor((x - grid.c) / grid.a)
    ends = F.least(edge(F.col("low")), edge(F.col("high"))) - 1, F.greatest(edge(F.col("low")), edge(F.col("high"))) + 1
    parts = parts.withColumn("_c0", F.greatest(ends[0], F.lit(0))).withColumn("_c1", F.least(ends[1], F.lit(grid.width - 1))).where("_c0 <= _c1")
    each = parts.withColumn("col", F.explode(F.sequence("_c0", "_c1")))
    x = grid.centre_of(F.col("row"), F.col("col"))[0]
    return each.where((x >= F.col("low")) & (x < F.col("high"))).select(*key, "row", "col")


def point_parts(features: DataFrame, grid: GridSpec) -> DataFrame:
    """features of kind point (those that have a geometry) with row, col of the pixels of the grid that hold their points, without the geometry."""
    key = [c for c in features.columns if c not in ("geometry", "row", "col")]
    each = features.where("geometry.kind = 'point'").select(*key, F.explode(geometry.corners(F.col("geometry"))).alias("_p"))
    row, col = grid.pixel_of(F.col("_p.x"), F.col("_p.y"))
    return each.select(*key, row.alias("row"), col.alias("col")).where(grid.inside(F.col("row"), F.col("col")))


def no_lines(features: DataFrame) -> DataFrame:
    """features; one that is a line stops the query, since it holds no pixels."""
    if "geometry" not in features.columns:
        return features
    ok = F.when(F.col("geometry.kind") == "line", F.raise_error(F.lit("lines hold no pixels to sample"))).otherwise(F.lit(True))
    return features.where(ok.cast("boolean"))


def polygon_samples(polygons: DataFrame, pixels: DataFrame, grid: GridSpec, *, mode: str = "majority", poly: str = "poly_id", label: str = "class_id", cls: str = "cls") -> DataFrame:
    """poly, ref_class, map_class: of all pixels of a polygon, of the most frequent class (the lowest of equals), or of the pixel of a point inside ("centroid").

    Polygons have a `ring`, or a `geometry` with holes and parts; points among geometries have the pixels that hold them, lines stop the query.
    """
    shape = geometry.column_of(polygons)
    own = no_lines(polygons.select(poly, label, shape))
    values = pixels.where(F.col(cls).isNotNull()).select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col(cls).cast("int").alias("map_class"))
    if mode == "centroid":
        inside = with_interior_point(own, x="_x", y="_y")
        row, col = grid.pixel_of(F.col("_x"), F.col("_y"))
        hit = inside.select(poly, label, row.alias("row"), col.alias("col"))
    elif mode in ("majority", "all_pixels"):
        hit = polygon_pixels(own, grid)
        if shape == "geometry":
            hit = hit.unionByName(point_parts(own, grid))
    else:
        raise ValueError(f"unknown mode {mode}")
    joined = hit.join(values, ["row", "col"]).select(poly, F.col(label).cast("int").alias("ref_class"), "map_class")
    if mode != "majority":
        return joined
    return joined.groupBy(poly, "ref_class").agg(F.mode("map_class", True).alias("map_class"))


def clean_samples(samples: DataFrame, features: list[str], label: str) -> DataFrame:
    """Rows whose features are all finite and whose label isn't null."""
    return samples.where(all_of([finite(F.col(c)) for c in features]) & F.col(label).isNotNull())


def stratified_split(samples: DataFrame, label: str, key: str, fraction: float = 0.3, seed: int = 42) -> DataFrame:
    """samples with is_test: of each label the share fraction (half even), in order of a hash of key and seed.

    Ranks are taken in slices of the hash, so that a frequent label is dealt over many tasks.
    """
    from pyspark.sql import Window

    h = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 40))
    own = samples.withColumn("_h", h).withColumn("_s", F.shiftright("_h", 34))
    counts = own.groupBy(label, "_s").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(label).orderBy("_s")
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_all", F.sum("_n").over(Window.partitionBy(label))).drop("_n")
    ranked = own.withColumn("_r", F.row_number().over(Window.partitionBy(label, "_s").orderBy("_h", key))).join(counts, [label, "_s"])
    return ranked.withColumn("is_test", F.col("_r") + F.col("_before") <= F.bround(F.col("_all") * fraction)).drop("_h", "_s", "_r", "_before", "_all")


def bernoulli_split(samples: DataFrame, key: str, fraction: float, seed: int = 42) -> DataFrame:
    """samples with is_train, by a hash of key and seed."""
    return samples.withColumn("is_train", F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_000)) < int(fraction * 1_000_000))


def to_grid(reference: DataFrame, epsg: int, grid: GridSpec) -> DataFrame:
    """Points (x, y), polygons (ring) or geometries of one coordinate system in the grid's."""
    if epsg == grid.epsg:
        return reference

    def moved(p: Column) -> Column:
        x, y = reproject(p["x"], p["y"], epsg, grid.epsg)
        return F.struct(x.alias("x"), y.alias("y"))

    if "ring" in reference.columns:
        reference = reference.withColumn("ring", F.transform("ring", moved))
    if "geometry" in reference.columns:
        reference = reference.withColumn("geometry", geometry.moved(F.col("geometry"), moved))
    if {"x", "y"} <= set(reference.columns):
        x, y = reproject(F.col("x"), F.col("y"), epsg, grid.epsg)
        reference = reference.withColumns({"x": x, "y": y})
    return reference


def load_and_extract(pixels: DataFrame, reference: DataFrame, grid: GridSpec, *, bands: list[str], label: str = "class_id", epsg: int | None = None, key: str = "point_id") -> DataFrame:
    """key, label, row, col and bands of the pixels under points, or in polygons (with a ring or geometry), of any known coordinate system; only whole rows."""
    own = to_grid(reference, epsg or grid.epsg, grid)
    if not geometry.has_shapes(own):
        return clean_samples(point_pixels(own, pixels, grid, bands=bands, label=label, keep=(key,)), bands, label)
    shape = geometry.column_of(own)
    own = no_lines(own.where(F.col(label).isNotNull() & F.col(shape).isNotNull()).select(key, label, shape))
    inside = polygon_pixels(own, grid)
    if shape == "geometry":
        inside = inside.unionByName(point_parts(own, grid))
    values = pixels.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), *bands)
    return clean_samples(inside.join(values, ["row", "col"]), bands, label).select(key, label, "row", "col", *bands)


def load_and_split(pixels: DataFrame, reference: DataFrame, grid: GridSpec, *, bands: list[str], label: str = "class_id", epsg: int | None = None, key: str = "point_id", fraction: float = 0.3, seed: int = 42) -> DataFrame:
    """load_and_extract with is_test, by label."""
    got = load_and_extract(pixels, reference, grid, bands=bands, label=label, epsg=epsg, key=key)
    return stratified_split(got.withColumn("_at", F.xxhash64(key, "row", "col")), label, "_at", fraction, seed).drop("_at")


def raster_features(pixels: DataFrame, points: DataFrame, grid: GridSpec, *, bands: list[str], names: list[str], label: str = "class_id", keep: tuple[str, ...] = ("point_id",)) -> DataFrame:
    """keep, label, the bands under their names (blue, green, red, nir ...) and NDVI, SAVI and NDWI of points; those with a denominator of 0 are left out."""
    if len(bands) != len(names):
        raise ValueError(f"{len(bands)} bands, {len(names)} names")
    got = point_pixels(points, pixels, grid, bands=bands, label=label, keep=keep).select(*keep, label, *[F.col(b).cast("double").alias(n) for b, n in zip(bands, names, strict=True)])
    made = got.select("*", *[spectral_index(i, names).alias(i.lower()) for i in ("NDVI", "SAVI", "NDWI")])
    return made.dropna(subset=["ndvi", "savi", "ndwi"])


def merge_samples(first: DataFrame, second: DataFrame, key: str = "point_id", label: str = "class_id") -> DataFrame:
    """The features of two rasters at the same points, by key and label; names of both get _1 and _2. A point twice in either stops the query."""
    def once(df: DataFrame, suffix: str) -> DataFrame:
        other = first if df is second else second
        names = [c for c in df.columns if c not in (key, label)]
        done = df.groupBy(key, label).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c + suffix if c in other.columns else c) for c in names])
        return done.where(F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("point twice: "), F.col(key).cast("string")))).otherwise(F.lit(True)).cast("boolean")).drop("_n")

    return once(first, "_1").join(once(second, "_2"), [key, label])


def stratified_bernoulli(samples: DataFrame, key: str, label: str, fraction: float | dict[int, float] = 0.7, seed: int = 42) -> DataFrame:
    """samples with is_train: each row of a label with the label's chance, by a hash of key, label and seed. Labels without a chance are never in it."""
    h = F.pmod(F.xxhash64(F.col(key), F.col(label), F.lit(seed)), F.lit(1_000_000))
    if not isinstance(fraction, dict):
        return samples.withColumn("is_train", h < int(fraction * 1_000_000))
    table = F.create_map(*[F.lit(x) for k, v in fraction.items() for x in (k, int(v * 1_000_000))]) if fraction else F.create_map(F.lit(0), F.lit(0))
    return samples.withColumn("is_train", F.coalesce(h < F.try_element_at(table, F.col(label).cast("int")), F.lit(False)))


def sample_regions(pixels: DataFrame, points: DataFrame, grid: GridSpec, bands: list[str], *, label: str = "class_id", key: str = "point_id", fraction: float = 0.7, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(training rows, testing rows) with the bands of the pixels that hold the points of each half."""
    split = stratified_bernoulli(points, key, label, fraction, seed)
    half = lambda w: point_pixels(split.where(w), pixels, grid, bands=bands, label=label, keep=(key,))
    return half("is_train"), half("NOT is_train")


def remove_flagged(points: DataFrame, flags: DataFrame, key: str = "point_id", flag: str = "outlier") -> DataFrame:
    return points.join(flags.where(F.col(flag)).select(key), key, "left_anti")


def join_flags(points: DataFrame, flags: DataFrame, key: str = "point_id", flag: str = "outlier") -> DataFrame:
    """points with the columns of flags (those of equal name with the suffix _flag); no flag means false; a key twice in flags stops the query."""
    once = flags.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(f"{c}_flag" if c in points.columns else c) for c in flags.columns if c != key])
    once = once.where(F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("key twice in flags: "), F.col(key).cast("string")))).otherwise(F.lit(True)).cast("boolean")).drop("_n")
    name = f"{flag}_flag" if flag in points.columns else flag
    return points.join(once, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))
