"""Queries on polygons with holes and parts and on lines, made of the polygons' corners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.functions import geometry
from terrace.grid import LONLAT, UTM, GridSpec
from terrace.operators import raster, sampling
from terrace.plans.registry import Part

part = Part()

_SMALL = GridSpec(150, 100, 10.0, 0.0, 500000.0, 0.0, -10.0, 9000000.0, 32751)


def _at(u: float, v: float) -> Column:
    """The place u pixels right of and v below a polygon's corner."""
    return F.struct(((F.col("c") + u) * 10.0 + 500000.0).alias("x"), (F.lit(9000000.0) - (F.col("r") + v) * 10.0).alias("y"))


def _box(u: float, v: float, wide: float, high: float) -> Column:
    return F.array(*[_at(u + a * wide, v + b * high) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))])


def _holed(polygons: DataFrame) -> DataFrame:
    return polygons.withColumn("geometry", geometry.polygon(F.array(_box(0, 0, 9, 8), _box(2, 2, 3, 4))))


@part.add("polygon_holes", "polygons", """
SELECT poly_id, CAST(r + i AS BIGINT) AS row, CAST(c + j AS BIGINT) AS col
FROM polygons, (SELECT unnest(range(8)) AS i), (SELECT unnest(range(9)) AS j)
WHERE NOT (i BETWEEN 2 AND 5 AND j BETWEEN 2 AND 4)
""")
def _(polygons: DataFrame) -> DataFrame:
    return sampling.polygon_pixels(_holed(polygons).select("poly_id", "geometry"), UTM)


# Two parts: four by three pixels, and below it six by six with a hole of two by two and an island of one pixel in that.
_PARTS = """
pp AS (
  SELECT poly_id, CAST(class_id AS INT) AS ref_class, CAST(e3 AS INT) AS map_class
  FROM polygons JOIN px_epochs ON row BETWEEN r AND r + 2 AND col BETWEEN c AND c + 3
    OR row BETWEEN r + 4 AND r + 9 AND col BETWEEN c AND c + 5 AND NOT (row BETWEEN r + 6 AND r + 7 AND col BETWEEN c + 2 AND c + 3)
    OR row = r + 6 AND col = c + 2
)
"""


def _parts(polygons: DataFrame) -> DataFrame:
    return polygons.withColumn("geometry", geometry.polygon(F.array(_box(0, 0, 4, 3)), F.array(_box(0, 4, 6, 6), _box(2, 6, 2, 2)), F.array(_box(2, 6, 1, 1))))


@part.add("multi_polygon_samples", "polygons px_epochs", f"""
WITH {_PARTS}
SELECT poly_id, ref_class, map_class
FROM (SELECT poly_id, ref_class, map_class, row_number() OVER (PARTITION BY poly_id ORDER BY count(*) DESC, map_class) AS k FROM pp GROUP BY 1, 2, 3)
WHERE k = 1
""")
def _(polygons: DataFrame, px: DataFrame) -> DataFrame:
    return sampling.polygon_samples(_parts(polygons), px, UTM, cls="e3")


@part.add("multi_polygon_pixels", "polygons px_epochs", f"WITH {_PARTS} SELECT * FROM pp")
def _(polygons: DataFrame, px: DataFrame) -> DataFrame:
    return sampling.polygon_samples(_parts(polygons), px, UTM, mode="all_pixels", cls="e3")


@part.add("points_beside_holes", "polygons px_epochs", """
SELECT poly_id, CAST(class_id AS INT) AS ref_class, CAST(e3 AS INT) AS map_class FROM polygons JOIN px_epochs ON row = r + 4 AND col = c + 7
""")
def _(polygons: DataFrame, px: DataFrame) -> DataFrame:
    return sampling.polygon_samples(_holed(polygons), px, UTM, mode="centroid", cls="e3")


_ROUTE = ((0.3, 0.2), (7.8, 3.9), (2.4, 9.3))
# Each side of the route, held against every pixel near it: the stretch of the side that is in the pixel isn't empty.
_TOUCHED = """
s AS (
  SELECT poly_id, r, c, c + x.u0 AS u0, r + x.v0 AS v0, c + x.u1 AS u1, r + x.v1 AS v1
  FROM polygons, (VALUES (0.3::DOUBLE, 0.2::DOUBLE, 7.8::DOUBLE, 3.9::DOUBLE), (7.8, 3.9, 2.4, 9.3)) AS x(u0, v0, u1, v1)
), near AS (
  SELECT poly_id, r + i AS row, c + j AS col, (c + j - u0) / (u1 - u0) AS a, (c + j + 1 - u0) / (u1 - u0) AS b, (r + i - v0) / (v1 - v0) AS d, (r + i + 1 - v0) / (v1 - v0) AS e
  FROM s, (SELECT unnest(range(11)) AS i), (SELECT unnest(range(11)) AS j)
), hit AS (
  SELECT DISTINCT poly_id, CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col FROM near
  WHERE greatest(0, least(a, b), least(d, e)) < least(1, greatest(a, b), greatest(d, e)) AND row < 1500 AND col < 100
)
"""


def _routes(polygons: DataFrame) -> DataFrame:
    return polygons.withColumn("geometry", geometry.line(F.array(*[_at(u, v) for u, v in _ROUTE])))


@part.add("touched_lines", "polygons", f"WITH {_TOUCHED} SELECT * FROM hit")
def _(polygons: DataFrame) -> DataFrame:
    return raster.rasterize_touched(_routes(polygons).select("poly_id", "geometry"), UTM)


@part.add("distance_to_lines", "polygons", f"""
WITH {_TOUCHED}
SELECT k.r AS row, l.c AS col, round_even(10 * sqrt(min((hit.row - k.r) * (hit.row - k.r) + (hit.col - l.c) * (hit.col - l.c))), 6) AS distance
FROM (SELECT unnest(range(150)) AS r) k, (SELECT unnest(range(100)) AS c) l, (SELECT DISTINCT row, col FROM hit WHERE row < 150) hit
GROUP BY 1, 2
""")
def _(polygons: DataFrame) -> DataFrame:
    done = raster.distance_features({"distance": _routes(polygons).select("geometry")}, _SMALL)
    return done.select("row", "col", F.bround("distance", 6).alias("distance"))


# The raster of geographic pixels on an equal-area grid of 15 m: from x and y to longitude and latitude, then the pixel that holds them.
_EQUAL_AREA = GridSpec(1300, 75, 15.0, 0.0, 12060700.0, 0.0, -15.0, -1080400.0, 6933)


@part.add("warp_nearest_equal_area", "px_epochs", """
WITH e AS (SELECT 1 / 298.257223563::DOUBLE * (2 - 1 / 298.257223563::DOUBLE) AS e2, 6378137.0::DOUBLE AS a),
k AS (SELECT e2, a, cos(radians(30)) / sqrt(1 - e2 * 0.25::DOUBLE) AS k0, (1 - e2) * (1 / (1 - e2) - ln((1 - sqrt(e2)) / (1 + sqrt(e2))) / (2 * sqrt(e2))) AS qp FROM e),
t AS (
  SELECT range // 75 AS row, range % 75 AS col, degrees((12060700 + (range % 75 + 0.5::DOUBLE) * 15) / (a * k0)) AS lon,
         asin(2 * (-1080400 - (range // 75 + 0.5::DOUBLE) * 15) * k0 / a / qp) AS b, e2
  FROM range(97500), k
), p AS (
  SELECT row, col, CAST(floor((lon - 125) / 0.0001::DOUBLE) AS BIGINT) AS c,
         CAST(floor((degrees(b + (e2 / 3 + 31 * e2 * e2 / 180 + 517 * e2 * e2 * e2 / 5040) * sin(2 * b) + (23 * e2 * e2 / 360 + 251 * e2 * e2 * e2 / 3780) * sin(4 * b) + 761 * e2 * e2 * e2 / 45360 * sin(6 * b)) + 8.5::DOUBLE) / -0.0001::DOUBLE) AS BIGINT) AS r
  FROM t
)
SELECT p.row, p.col, e3 FROM p JOIN px_epochs x ON x.row = p.r AND x.col = p.c
""")
def _(px: DataFrame) -> DataFrame:
    return raster.warp_nearest(px, LONLAT, _EQUAL_AREA, ["e3"])


QUERIES, ORACLES = part.queries, part.oracles
