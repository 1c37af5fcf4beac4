"""Vector features, point lists and scene catalogues as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.functions import geometry


def read_geojson(spark: SparkSession, path: str, properties: str, lines: bool = False) -> DataFrame:
    """properties, x, y (points), ring (polygons of one ring) and geometry (all) of the features of GeoJSON files. properties: their DDL, such as "id LONG, class_id INT".

    lines: each line is a feature, as write_features has them, so that a file is read in parts; else a file is a collection. Features without a geometry stay, with nulls; a kind of geometry that isn't known stops the query.
    """
    feature = f"STRUCT<properties: STRUCT<{', '.join(':'.join(p.split()) for p in properties.split(','))}>, geometry: STRUCT<type: STRING, coordinates: STRING>>"
    if lines:
        each = spark.read.text(path).select(F.from_json("value", feature).alias("f")).where("f IS NOT NULL")
    else:
        each = spark.read.schema(f"features ARRAY<{feature}>").option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    return with_places(each.select("f.properties.*", geometry.from_geojson(F.col("f.geometry.type"), F.col("f.geometry.coordinates")).alias("geometry")))


def with_places(features: DataFrame) -> DataFrame:
    """features with x, y of single points and the ring of polygons of one ring, before their geometry."""
    g = F.col("geometry")
    single = F.size(geometry.rings(g)) == 1
    point, ring = (g["kind"] == "point") & single, (g["kind"] == "polygon") & single
    only = geometry.rings(g)[0]
    return features.select(*[c for c in features.columns if c != "geometry"], F.when(point, only[0]["x"]).alias("x"), F.when(point, only[0]["y"]).alias("y"), F.when(ring, only).alias("ring"), "geometry")


def resolve_paths(spark: SparkSession, rasters: str | list[str]) -> list[tuple[int, str]]:
    """(place, path) of rasters: a pattern's files sorted, a list's in its own order; each must exist, and there must be one."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()

    def matches(pattern: str) -> list[str]:
        at = jvm.org.apache.hadoop.fs.Path(pattern)
        return sorted(str(x.getPath().toString()) for x in (at.getFileSystem(conf).globStatus(at) or []))

    if isinstance(rasters, str):
        found = matches(rasters)
    else:
        found = []
        for path in rasters:
            own = matches(path)
            if not own:
                raise FileNotFoundError(path)
            found += own[:1]
    if not found:
        raise FileNotFoundError(f"no rasters: {rasters}")
    return list(enumerate(found))


def area_of_interest(spark: SparkSession, aoi) -> tuple[float, float, float, float]:
    """The box around an area: four numbers, a GeoJSON mapping (geometry, feature or collection), or a GeoJSON file."""
    if isinstance(aoi, str):
        rows = read_geojson(spark, aoi, "id STRING")
        corners = rows.select(F.explode(geometry.corners(F.col("geometry"))).alias("p"))
        low = corners.agg(F.min("p.x"), F.min("p.y"), F.max("p.x"), F.max("p.y")).first()
        if low[0] is None:
            raise ValueError(f"no geometries in {aoi}")
        return tuple(low)
    if isinstance(aoi, dict):
        def numbers(x):
            if isinstance(x, dict):
                for k in ("features", "geometries", "geometry", "coordinates"):
                    if x.get(k) is not None:
                        yield from numbers(x[k])
            elif x and isinstance(x[0], (int, float)):
                yield x[0], x[1]
            else:
                for y in x or ():
                    yield from numbers(y)

        points = list(numbers(aoi))
        if not points:
            raise ValueError("the mapping has no coordinates")
        xs, ys = zip(*points, strict=True)
        return min(xs), min(ys), max(xs), max(ys)
    box = tuple(float(x) for x in aoi)
    if len(box) != 4 or box[0] > box[2] or box[1] > box[3]:
        raise ValueError("a box has four numbers: west, south, east, north")
    return box


def preview_urls(scenes: DataFrame, endpoint: str, asset: str = "visual", assets: str = "assets") -> DataFrame:
    """scenes with preview_url: endpoint?collection=..&item=..&assets=..; a scene whose assets (array) lack it stops the query."""
    code = lambda c: F.url_encode(c.cast("string"))
    url = F.concat(F.lit(endpoint + "?collection="), code(F.col("collection")), F.lit("&item="), code(F.col("item_id")), F.lit("&assets="), code(F.lit(asset)))
    lacks = F.raise_error(F.concat(F.lit(f"no asset {asset} in scene "), F.col("item_id").cast("string")))
    return scenes.withColumn("preview_url", F.when(F.array_contains(assets, asset), url).otherwise(lacks.cast("string")) if assets in scenes.columns else url)


def write_features(rows: DataFrame, path: str) -> None:
    """Points (x, y), polygons (ring) or any geometry with their properties as GeoJSON features, a line each, for cleaned or flagged samples."""
    if geometry.has_shapes(rows):
        name = geometry.column_of(rows)
        shape = geometry.to_geojson(geometry.geometry_of(rows, name))
    else:
        shape = F.to_json(F.struct(F.lit("Point").alias("type"), F.array(F.col("x").cast("double"), F.col("y").cast("double")).alias("coordinates")))
    properties = F.struct(*[c for c in rows.columns if c not in ("x", "y", "ring", "geometry")])
    text = F.concat(F.lit('{"type":"Feature","properties":'), F.to_json(properties), F.lit(',"geometry":'), F.coalesce(shape, F.lit("null")), F.lit("}"))
    rows.select(text.alias("value")).write.mode("overwrite").text(path)


def read_points(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Samples of a known schema: a CSV file with a header, or the attributes of a vector file (GeoJSON or shapefile), without its geometry."""
    kind = path.lower().rpartition(".")[2]
    if kind not in ("geojson", "json", "shp"):
        return spark.read.schema(schema).option("header", True).csv(path)
    if kind == "shp":
        from terrace.sources.shapefile import read_shapefile

        found = read_shapefile(spark, path, schema)
    else:
        found = read_geojson(spark, path, schema)
    return found.drop("x", "y", "ring", "geometry")


def search_scenes(catalog: DataFrame, aoi, start: str, end: str, *, max_cloud: float | None = None, max_items: int = 20) -> DataFrame:
    """Scenes (with xmin, ymin, xmax, ymax, ts, cloud_cover, item_id) that meet the box of an area (see area_of_interest) and a span of time, the earliest first; the filters reach the scan."""
    aoi = area_of_interest(catalog.sparkSession, aoi)
    hit = (F.col("xmin") <= aoi[2]) & (F.col("xmax") >= aoi[0]) & (F.col("ymin") <= aoi[3]) & (F.col("ymax") >= aoi[1]) & F.col("ts").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))
    if max_cloud is not None:
        hit = hit & (F.col("cloud_cover") <= max_cloud)
    return catalog.where(hit).orderBy("ts", "item_id").limit(max_items)


def plan_downloads(scenes: DataFrame, assets: list[str], folder: str, existing: DataFrame | None = None) -> DataFrame:
    """item_id, asset, path of each scene's assets, without those whose path is in existing (path)."""
    each = scenes.select("item_id", F.explode(F.array(*map(F.lit, assets))).alias("asset"))
    each = each.withColumn("path", F.concat(F.lit(folder.rstrip("/") + "/"), "item_id", F.lit("_"), "asset", F.lit(".tif")))
    return each if existing is None else each.join(existing.select("path"), "path", "left_anti").select("item_id", "asset", "path")


def year_of(path: Column) -> Column:
    """The year 20xx that a file's name holds."""
    return F.regexp_extract(path, r"(20\d\d)", 1).try_cast("int")
