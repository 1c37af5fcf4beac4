"""Queries that go by way of files: what is written to the shared folder and read again is what the tables hold; and models that SQL can say."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.grid import UTM, GridSpec
from terrace.operators import learning, reports, sampling, timeseries
from terrace.plans.geometries import _holed
from terrace.plans.registry import Part
from terrace.scratch import new_path
from terrace.sources import raster_format, tiff, vector

part = Part()

_TILE = 64


def _grid(px: DataFrame) -> GridSpec:
    """The grid of all pixels there are."""
    row, col = px.agg(F.max("row"), F.max("col")).first()
    return replace(UTM, height=(row or 0) + 1, width=(col or 0) + 1)


@part.add("raster_there_and_back", "px_epochs", "SELECT row, col, CAST(e0 AS DOUBLE) AS e0, CAST(e3 AS DOUBLE) AS e3 FROM (SELECT row, col, nullif(e0, 0) AS e0, nullif(e3, 0) AS e3 FROM px_epochs) WHERE coalesce(e0, e3) IS NOT NULL")
def _(px: DataFrame) -> DataFrame:
    folder = new_path(px.sparkSession, "tiles")
    raster_format.write_raster(px, _grid(px), ["e0", "e3"], folder, tile=_TILE)
    files = px.sparkSession.read.format("raster").load(folder)
    at = lambda k: F.regexp_extract("path", r"tile_(\d+)_(\d+)\.tif$", k).cast("long") * _TILE
    return files.select((F.col("row") + at(1)).alias("row"), (F.col("col") + at(2)).alias("col"), "e0", "e3")


@part.add("raster_window", "px_epochs", "SELECT row, col, CAST(e3 AS DOUBLE) AS e3 FROM px_epochs WHERE e3 > 0 AND row >= 5 AND col >= 10")
def _(px: DataFrame) -> DataFrame:
    folder = new_path(px.sparkSession, "whole")
    grid = _grid(px)
    raster_format.write_raster(px, grid, ["e3"], folder, tile=2048)
    return tiff.read_raster(px.sparkSession, f"{folder}/*.tif", ["e3"], (5, 10, grid.height, grid.width), grid).select("row", "col", "e3")


@part.add("features_there_and_back", "polygons", """
SELECT poly_id, class_id, CAST(r + i AS BIGINT) AS row, CAST(c + j AS BIGINT) AS col
FROM polygons, (SELECT unnest(range(8)) AS i), (SELECT unnest(range(9)) AS j)
WHERE NOT (i BETWEEN 2 AND 5 AND j BETWEEN 2 AND 4)
""")
def _(polygons: DataFrame) -> DataFrame:
    folder = new_path(polygons.sparkSession, "features")
    vector.write_features(_holed(polygons).select("poly_id", "class_id", "geometry"), folder)
    again = vector.read_geojson(polygons.sparkSession, folder, "poly_id BIGINT, class_id BIGINT", lines=True)
    return sampling.polygon_pixels(again.select("poly_id", "class_id", "geometry"), UTM)


@part.add("points_from_csv", "points", "SELECT point_id, x, y, class_id FROM points")
def _(points: DataFrame) -> DataFrame:
    folder = new_path(points.sparkSession, "points")
    points.write.option("header", True).csv(folder)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema)
    return vector.read_points(points.sparkSession, folder, kinds)


@part.add("area_report_csv", "px_epochs", "SELECT e3 AS cls, round_even(count(*) * 0.01::DOUBLE, 4) AS area_ha FROM px_epochs WHERE e3 > 0 GROUP BY 1")
def _(px: DataFrame) -> DataFrame:
    folder = new_path(px.sparkSession, "areas")
    table = reports.class_area_report(px.where("e3 > 0").select("row", "col", F.col("e3").alias("cls")), UTM, csv=folder)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema)
    back = px.sparkSession.read.schema(kinds).option("header", True).csv(folder)
    return back.select("cls", F.bround("area_ha", 4).alias("area_ha"))


# A model is anything that makes classes, or rows of probabilities, of a batch.
@part.add("classify_by_callable", "px_bands", "SELECT row, col, CAST(CASE WHEN nir > red THEN 1 WHEN green > blue THEN 2 ELSE 3 END AS INT) AS cls FROM px_bands")
def _(px: DataFrame) -> DataFrame:
    rule = lambda b: np.where(b["nir"] > b["red"], 1, np.where(b["green"] > b["blue"], 2, 3))
    return learning.classify_pixels(px, ["blue", "green", "red", "nir"], rule)


@part.add("probabilities_by_callable", "px_bands", """
SELECT row, col, CAST(round_even(red / (red + nir::DOUBLE) * 10000, 0) AS INT) AS p_red, CAST(round_even(nir / (red + nir::DOUBLE) * 10000, 0) AS INT) AS p_nir FROM px_bands
""")
def _(px: DataFrame) -> DataFrame:
    done = learning.classify_pixels(px, ["blue", "red", "nir"], lambda b: b.div(b.sum(axis=1), axis=0).to_numpy(), mode="proba", selector=["red", "nir"])
    return done.select("row", "col", F.col("p")[0].alias("p_red"), F.col("p")[1].alias("p_nir"))


@part.add("seasonal_radar", "px_scenes", """
WITH s AS (SELECT pixel, CASE WHEN month(ts) IN (12, 1, 2, 3, 4) THEN 'wet' ELSE 'dry' END AS season, value FROM px_scenes WHERE band <> 'click' AND ord % 3 > 0)
SELECT pixel, round_even(median(value) FILTER (season = 'wet'), 6) AS wet, round_even(median(value) FILTER (season = 'dry'), 6) AS dry FROM s GROUP BY 1
""")
def _(scenes: DataFrame) -> DataFrame:
    mode = F.when(F.col("band") == "click", "EW").otherwise("IW")
    pols = F.when(F.col("ord") % 3 == 0, F.array(F.lit("VH"))).otherwise(F.array(F.lit("VV"), F.lit("VH")))
    done = timeseries.seasonal_radar(scenes.withColumns({"mode": mode, "polarisations": pols}), ["pixel"])
    return done.select("pixel", F.bround("wet", 6).alias("wet"), F.bround("dry", 6).alias("dry"))


QUERIES, ORACLES = part.queries, part.oracles
