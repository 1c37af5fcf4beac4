"""Queries on bands, composites, mosaics, stacks, distances and time series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.functions import scalars
from terrace.grid import UTM, GridSpec
from terrace.operators import focal, fusion, raster, segmentation, superpixels, timeseries
from terrace.plans.registry import Part
from terrace.sources import vector

part = Part()


def _nd(a: str, b: str) -> str:
    return f"({a} - {b}) / ({a} + {b})::DOUBLE"


_IDX = f"round_even({_nd('nir', 'red')}, 6) AS ndvi, round_even({_nd('green', 'nir')}, 6) AS ndwi, round_even({_nd('green', 'swir1')}, 6) AS mndwi, round_even({_nd('swir1', 'nir')}, 6) AS ndbi, CASE WHEN nir + 6 * red - 7.5 * blue + 1 <> 0 THEN round_even(2.5 * (nir - red) / (nir + 6 * red - 7.5::DOUBLE * blue + 1), 6) END AS evi, round_even(1.5 * (nir - red) / (nir + red + 0.5::DOUBLE), 6) AS savi"
INDICES = ["NDVI", "NDWI", "MNDWI", "NDBI", "EVI", "SAVI"]


@part.add("spectral_indices", "px_bands", f"SELECT row, col, {_IDX} FROM px_bands")
def _(bands: DataFrame) -> DataFrame:
    return bands.select("row", "col", *[F.bround(scalars.spectral_index(i, bands.columns), 6).alias(i.lower()) for i in INDICES])


def _grad(line: str, along: str) -> str:
    w = f"OVER (PARTITION BY {line} ORDER BY {along})"
    return f"CASE WHEN lag(z) {w} IS NOT NULL AND lead(z) {w} IS NOT NULL THEN (lead(z) {w} - lag(z) {w}) / 20.0::DOUBLE WHEN lead(z) {w} IS NOT NULL THEN (lead(z) {w} - z) / 10.0::DOUBLE WHEN lag(z) {w} IS NOT NULL THEN (z - lag(z) {w}) / 10.0::DOUBLE ELSE 0 END"


_SLOPE = f"g AS (SELECT row, col, {_grad('row', 'col')} AS dx, {_grad('col', 'row')} AS dy FROM px_dem), sl AS (SELECT row, col, round_even(degrees(atan(sqrt(dx * dx + dy * dy))), 5) AS slope, round_even((degrees(atan2(-dx, dy)) + 360) % 360, 5) AS aspect FROM g)"


@part.add("terrain_slope_aspect", "px_dem", f"WITH {_SLOPE} SELECT * FROM sl")
def _(dem: DataFrame) -> DataFrame:
    done = focal.slope_aspect(dem)
    return done.select("row", "col", F.bround("slope", 5).alias("slope"), F.bround("aspect", 5).alias("aspect"))


@part.add("feature_stack", "px_bands px_dem", f"WITH {_SLOPE} SELECT row, col, blue, nir, red, round_even({_nd('nir', 'red')}, 6) AS ndvi, slope, aspect FROM px_bands LEFT JOIN sl USING (row, col)")
def _(bands: DataFrame, dem: DataFrame) -> DataFrame:
    done = raster.feature_stack(bands.select("row", "col", "blue", "nir", "red"), ["NDVI"], dem, UTM)
    return done.select("row", "col", "blue", "nir", "red", F.bround("ndvi", 6).alias("ndvi"), F.bround("slope", 5).alias("slope"), F.bround("aspect", 5).alias("aspect"))


@part.add("composite_median", "px_scenes", "SELECT pixel, band, round_even(median(value), 6) AS value FROM px_scenes GROUP BY 1, 2")
def _(scenes: DataFrame) -> DataFrame:
    return raster.composite(scenes, ["pixel", "band"]).withColumn("value", F.bround("value", 6))


@part.add("composite_first_valid", "px_scenes", "SELECT pixel, band, arg_min(value, ord) FILTER (value IS NOT NULL) AS value FROM px_scenes GROUP BY 1, 2")
def _(scenes: DataFrame) -> DataFrame:
    return raster.composite(scenes, ["pixel", "band"], method="first")


def _tiles(px: DataFrame) -> list[DataFrame]:
    return [px.where(w).select("row", "col", F.col(e).alias("cls")) for w, e in (("col < 60", "e0"), ("col >= 40", "e1"), ("row BETWEEN 10 AND 39 AND col BETWEEN 20 AND 79", "e2"))]


_TILES = "tl AS (SELECT row, col, e0 AS cls, 0 AS ord FROM px_epochs WHERE col < 60 UNION ALL SELECT row, col, e1, 1 FROM px_epochs WHERE col >= 40 UNION ALL SELECT row, col, e2, 2 FROM px_epochs WHERE row BETWEEN 10 AND 39 AND col BETWEEN 20 AND 79)"


@part.add("mosaic_max", "px_epochs", f"WITH {_TILES} SELECT row, col, max(cls) AS cls FROM tl GROUP BY 1, 2")
def _(px: DataFrame) -> DataFrame:
    return raster.mosaic(_tiles(px))


@part.add("mosaic_first", "px_epochs", f"WITH {_TILES} SELECT row, col, coalesce(arg_min(cls, ord) FILTER (cls <> 0), 0) AS cls FROM tl GROUP BY 1, 2")
def _(px: DataFrame) -> DataFrame:
    return raster.mosaic(_tiles(px), method="first")


@part.add("stack_bands", "px_bands px_epochs", "SELECT row, col, blue::DOUBLE AS blue, nir::DOUBLE AS nir, e0::DOUBLE AS e0 FROM px_bands LEFT JOIN px_epochs USING (row, col)")
def _(bands: DataFrame, px: DataFrame) -> DataFrame:
    v = lambda df, c: df.select("row", "col", F.col(c).alias("value"))
    return raster.stack({"blue": v(bands, "blue"), "nir": v(bands, "nir"), "e0": v(px, "e0")})


FINE = GridSpec(40, 50, 5.0, 0.0, 500000.0, 0.0, -5.0, 9000000.0, 32751)
COARSE = GridSpec(20, 25, 10.0, 0.0, 500000.0, 0.0, -10.0, 9000000.0, 32751)


def _target(bands: DataFrame) -> DataFrame:
    fine = F.explode(F.array(*[F.struct((F.col("row") * 2 + i).alias("row"), (F.col("col") * 2 + j).alias("col")) for i in (0, 1) for j in (0, 1)]))
    return bands.select(fine.alias("_f")).select("_f.row", "_f.col")


@part.add("resample_nearest", "px_bands", "WITH t AS (SELECT range // 50 AS row, range % 50 AS col FROM range(2000)) SELECT t.row, t.col, b.nir FROM t LEFT JOIN px_bands b ON b.row = t.row // 2 AND b.col = t.col // 2")
def _(bands: DataFrame) -> DataFrame:
    return raster.resample_nearest(bands, COARSE, _target(bands), FINE, ["nir"])


@part.add("resample_bilinear", "px_bands", """WITH t AS (SELECT range // 50 AS row, range % 50 AS col, (range // 50 + 0.5::DOUBLE) / 2 - 0.5 AS y, (range % 50 + 0.5::DOUBLE) / 2 - 0.5 AS x FROM range(2000)),
c AS (SELECT t.*, CAST(floor(y) AS BIGINT) + i AS r, CAST(floor(x) AS BIGINT) + j AS c FROM t, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j)),
w AS (SELECT c.row, c.col, b.nir, (1 - abs(y - r)) * (1 - abs(x - c)) AS w FROM c JOIN px_bands b ON b.row = r AND b.col = c WHERE (1 - abs(y - r)) * (1 - abs(x - c)) > 0)
SELECT t.row, t.col, round_even(sum(nir * w) / sum(w), 5) AS nir FROM t LEFT JOIN w USING (row, col) GROUP BY 1, 2""")
def _(bands: DataFrame) -> DataFrame:
    return raster.resample_bilinear(bands, COARSE, _target(bands), FINE, "nir").withColumn("nir", F.bround("nir", 5))


@part.add("distance_to_feature", "px_dem", "WITH f AS (SELECT row, col FROM px_dem WHERE z % 97 = 0) SELECT d.row, d.col, round_even(10 * sqrt(min((d.row - f.row) * (d.row - f.row) + (d.col - f.col) * (d.col - f.col))), 5) AS distance FROM px_dem d CROSS JOIN f GROUP BY 1, 2")
def _(dem: DataFrame) -> DataFrame:
    return focal.distance_to(dem, F.col("z") % 97 == 0).withColumn("distance", F.bround("distance", 5))


@part.add("fill_isolated", "px_bands", "WITH x AS (SELECT row, col, CASE WHEN nir % 5 <> 0 THEN nir END AS v FROM px_bands), n AS (SELECT a.row, a.col, median(b.v) AS m, count(b.v) AS n FROM x a JOIN x b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 GROUP BY 1, 2) SELECT row, col, CAST(coalesce(v, CASE WHEN n >= 5 THEN m END) AS DOUBLE) AS v FROM x JOIN n USING (row, col)")
def _(bands: DataFrame) -> DataFrame:
    return focal.fill_isolated(bands.select("row", "col", F.when(F.col("nir") % 5 != 0, F.col("nir")).alias("v"))).withColumn("v", F.col("v").cast("double"))


@part.add("decimate", "px_bands", "SELECT row // 10 AS row, col // 10 AS col, round_even(avg(nir), 5) AS nir FROM px_bands GROUP BY 1, 2")
def _(bands: DataFrame) -> DataFrame:
    return focal.decimate(bands, ["nir"]).withColumn("nir", F.bround("nir", 5))


@part.add("percent_stretch", "px_bands", "WITH q AS (SELECT quantile_cont(nir::DOUBLE, 0.02) AS lo, quantile_cont(nir::DOUBLE, 0.98) AS hi FROM px_bands) SELECT row, col, round_even(greatest(0, least(1, (nir - lo) / (hi - lo + 1e-9))), 6) AS nir FROM px_bands, q")
def _(bands: DataFrame) -> DataFrame:
    return raster.percent_stretch(bands.select("row", "col", "nir"), ["nir"]).withColumn("nir", F.bround("nir", 6))


@part.add("qa_bitmask", "qa_pixels", "SELECT l_orderkey, qa, round_even(dn * 0.0000275::DOUBLE - 0.2, 6) AS reflectance, round_even(dn * 0.00341802::DOUBLE + 149, 6) AS kelvin FROM qa_pixels WHERE qa & 30 = 0")
def _(qa: DataFrame) -> DataFrame:
    clear = qa.where(scalars.bits_clear(F.col("qa")))
    return clear.select("l_orderkey", "qa", F.bround(scalars.scaled(F.col("dn"), scalars.OPTICAL), 6).alias("reflectance"), F.bround(scalars.scaled(F.col("dn"), scalars.THERMAL), 6).alias("kelvin"))


@part.add("monthly_median", "px_scenes", "SELECT pixel, band, month, round_even(value, 6) AS value, month + INTERVAL 15 DAYS AS stamp FROM (SELECT pixel, band, CAST(date_trunc('month', ts) AS TIMESTAMP) AS month, median(value) AS value FROM px_scenes WHERE value IS NOT NULL GROUP BY 1, 2, 3)")
def _(scenes: DataFrame) -> DataFrame:
    return timeseries.monthly_median(scenes, ["pixel", "band"]).withColumn("value", F.bround("value", 6))


@part.add("seasonal_median", "px_scenes", "SELECT pixel, round_even(median(value) FILTER (s = 'wet'), 6) AS wet, round_even(median(value) FILTER (s = 'dry'), 6) AS dry FROM (SELECT *, CASE WHEN month(ts + to_days(CAST(ord % 300 AS INT))) IN (12, 1, 2, 3, 4) THEN 'wet' ELSE 'dry' END AS s FROM px_scenes) GROUP BY 1")
def _(scenes: DataFrame) -> DataFrame:
    moved = scenes.withColumn("ts", F.expr("ts + make_dt_interval(CAST(ord % 300 AS INT))"))
    return timeseries.seasonal_median(moved, ["pixel"]).select("pixel", F.bround("wet", 6).alias("wet"), F.bround("dry", 6).alias("dry"))


@part.add("nearest_segment_asof", "ts_segments", "WITH s AS (SELECT pixel, tStart AS s, tEnd AS e, greatest(tStart - 1995.5, 1995.5 - tEnd, 0) AS gap FROM ts_segments) SELECT pixel, s AS tStart, e AS tEnd, round_even(gap, 5) AS gap FROM s QUALIFY row_number() OVER (PARTITION BY pixel ORDER BY gap, s, e) = 1")
def _(segs: DataFrame) -> DataFrame:
    targets = segs.select("pixel").distinct().withColumn("t", F.lit(1995.5))
    return timeseries.nearest_segment(targets, segs, "pixel").select("pixel", "tStart", "tEnd", F.bround("gap", 5).alias("gap"))


@part.add("harmonic_synthetic", "ts_segments", "WITH h AS (SELECT pixel, tStart, least(greatest(1995.5::DOUBLE, tStart), tEnd) AS tt FROM ts_segments) SELECT pixel, tStart, round_even((100 + 0.5 * tt + 20 * cos(tt * 2 * pi()) + 10 * sin(tt * 2 * pi()) + 5 * cos(tt * 4 * pi()) + 4 * sin(tt * 4 * pi()) + 3 * cos(tt * 6 * pi()) + 2 * sin(tt * 6 * pi())) / 10000, 6) AS value FROM h")
def _(segs: DataFrame) -> DataFrame:
    coefs = F.array(*[F.lit(float(x)) for x in (100, 0.5, 20, 10, 5, 4, 3, 2)])
    return segs.select("pixel", "tStart", F.bround(scalars.harmonic(coefs, F.lit(1995.5), F.col("tStart"), F.col("tEnd"), 10000.0), 6).alias("value"))


@part.add("break_count_stable_blend", "ts_segments", "WITH b AS (SELECT pixel, count(*) FILTER (tBreak BETWEEN 1995.0 AND 1997.5) AS n FROM ts_segments GROUP BY 1) SELECT pixel, n AS n_breaks, CASE WHEN n = 0 THEN pixel % 7 ELSE pixel % 5 END AS p FROM b")
def _(segs: DataFrame) -> DataFrame:
    counts = timeseries.break_count(segs, "pixel", first=1995.0, last=1997.5)
    keys = segs.select("pixel").distinct()
    mixed = timeseries.stable_blend(keys.withColumn("p", F.col("pixel") % 5), keys.withColumn("p", F.col("pixel") % 7), counts, "pixel")
    return counts.join(mixed, "pixel").select("pixel", "n_breaks", "p")


@part.add("break_stable_points", "ts_segments", "SELECT DISTINCT pixel FROM ts_segments WHERE pixel NOT IN (SELECT pixel FROM ts_segments WHERE tBreak IS NOT NULL AND abs(tBreak - 1996.5) < 0.5)")
def _(segs: DataFrame) -> DataFrame:
    return timeseries.stable_points(segs.select("pixel").distinct(), segs, "pixel", at=1996.5)


@part.add("amplitude_phase", "px_bands", "SELECT row, col, round_even(sqrt(blue * blue + nir * nir), 5) AS amplitude, round_even(atan2(nir, blue), 6) AS phase FROM px_bands")
def _(bands: DataFrame) -> DataFrame:
    a, p = scalars.amplitude_phase(F.col("blue"), F.col("nir"))
    return bands.select("row", "col", F.bround(a, 5).alias("amplitude"), F.bround(p, 6).alias("phase"))


@part.add("structural_reallocation", "px_bands px_masks", "SELECT b.row, b.col, CASE WHEN c < 15 THEN 0 ELSE blue END / 1.0::DOUBLE AS \"Primary\", CASE WHEN c < 15 THEN blue + green ELSE green END / 1.0::DOUBLE AS \"Secondary\", CASE WHEN settlement = 1 THEN red ELSE 0 END / 1.0::DOUBLE AS \"Built\", CASE WHEN c > 12 THEN 0 ELSE nir END / 1.0::DOUBLE AS \"Grassland\" FROM (SELECT *, swir1 % 30 AS c FROM px_bands) b JOIN px_masks USING (row, col)")
def _(bands: DataFrame, masks: DataFrame) -> DataFrame:
    j = bands.join(masks, ["row", "col"])
    p = {"Primary": "blue", "Secondary": "green", "Built": "red", "Grassland": "nir"}
    out = fusion.reallocate({k: F.col(c).cast("double") for k, c in p.items()}, F.col("swir1") % 30, F.col("settlement"))
    return j.select("row", "col", *[c.alias(k) for k, c in out.items()])


@part.add("unique_segment_ids", "px_segments", "SELECT row, col, seg + (row % 4) * 300000000 AS seg FROM px_segments")
def _(segs: DataFrame) -> DataFrame:
    return segs.select("row", "col", fusion.unique_segments(F.col("seg"), F.col("row") % 4).alias("seg"))


@part.add("scene_search", "scene_list", "SELECT item_id, ts, cloud_cover FROM scene_list WHERE xmin <= 30 AND xmax >= 10 AND ymin <= 20 AND ymax >= 5 AND ts BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1997-01-01' AND cloud_cover <= 20 ORDER BY ts, item_id LIMIT 20")
def _(scenes: DataFrame) -> DataFrame:
    return vector.search_scenes(scenes, (10, 5, 30, 20), "1995-01-01", "1997-01-01", max_cloud=20).select("item_id", "ts", "cloud_cover")


@part.add("download_plan", "scene_list", "SELECT item_id, asset, '/data/' || item_id || '_' || asset || '.tif' AS path FROM scene_list, (VALUES ('B04'), ('B08')) a(asset) WHERE NOT (item_id % 10 = 0 AND asset = 'B04')")
def _(scenes: DataFrame) -> DataFrame:
    there = scenes.where("item_id % 10 = 0").select(F.concat(F.lit("/data/"), "item_id", F.lit("_B04.tif")).alias("path"))
    return vector.plan_downloads(scenes, ["B04", "B08"], "/data", there)


@part.add("band_statistics", "px_bands", "SELECT 'nir' AS band, max(nir)::DOUBLE AS max, round_even(avg(nir), 5) AS mean, round_even(quantile_cont(nir::DOUBLE, 0.5), 5) AS q50, round_even(quantile_cont(nir::DOUBLE, 0.99), 5) AS q99 FROM px_bands UNION ALL SELECT 'red', max(red)::DOUBLE, round_even(avg(red), 5), round_even(quantile_cont(red::DOUBLE, 0.5), 5), round_even(quantile_cont(red::DOUBLE, 0.99), 5) FROM px_bands")
def _(bands: DataFrame) -> DataFrame:
    done = raster.band_statistics(bands, ["nir", "red"])
    return done.select("band", "max", *[F.bround(c, 5).alias(c) for c in ("mean", "q50", "q99")])


@part.add("landsat_collection", "qa_scenes", """SELECT ts, pixel, round_even(b1 * 0.0000275::DOUBLE - 0.2, 6) AS blue, round_even(b2 * 0.0000275::DOUBLE - 0.2, 6) AS nir FROM qa_scenes
WHERE cloud_cover <= 20 AND ts BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-01-01' AND qa & 30 = 0""")
def _(scenes: DataFrame) -> DataFrame:
    two = {"LC08": scenes.where("pixel % 2 = 0").withColumnsRenamed({"b1": "SR_B2", "b2": "SR_B5"}), "LE07": scenes.where("pixel % 2 = 1").withColumnsRenamed({"b1": "SR_B1", "b2": "SR_B4"})}
    done = timeseries.landsat_collection(two, {"LC08": {"blue": "SR_B2", "nir": "SR_B5"}, "LE07": {"blue": "SR_B1", "nir": "SR_B4"}}, start="1995-01-01", end="1996-01-01", max_cloud=20)
    return done.select("ts", "pixel", F.bround("blue", 6).alias("blue"), F.bround("nir", 6).alias("nir"))


@part.add("sentinel2_series", "px_bands px_dem", "SELECT row * 100 + col AS scene_id, CASE WHEN z / 997.0::DOUBLE >= 0.6 THEN nir / 10000.0::DOUBLE END AS nir FROM px_bands JOIN px_dem USING (row, col)")
def _(bands: DataFrame, dem: DataFrame) -> DataFrame:
    key = lambda df: df.withColumn("scene_id", F.col("row") * 100 + F.col("col"))
    return timeseries.sentinel2_series(key(bands).select("scene_id", "nir"), key(dem).select("scene_id", (F.col("z") / 997.0).alias("quality")), ["nir"])


@part.add("yearly_synthetic", "ts_segments", """WITH y AS (SELECT s.pixel, year, s.tStart, s.tEnd, greatest(tStart - (year + 0.5::DOUBLE), year + 0.5::DOUBLE - tEnd, 0) AS gap FROM ts_segments s, (VALUES (1995), (1996)) v(year)),
b AS (SELECT *, least(greatest(year + 0.5::DOUBLE, tStart), tEnd) AS tt FROM y QUALIFY row_number() OVER (PARTITION BY pixel, year ORDER BY gap, tStart, tEnd) = 1),
v AS (SELECT pixel, year, gap, (1000 + 0.1::DOUBLE * tt + 200 * cos(tt * 2 * pi()) + 100 * sin(tt * 2 * pi())) / 10000 AS value FROM b)
SELECT pixel, year, CASE WHEN gap <= 0.3 AND value > -0.05 AND value < 1.5 THEN round_even(value, 6) END AS value FROM v""")
def _(segs: DataFrame) -> DataFrame:
    own = segs.withColumn("coefs", F.array(*[F.lit(float(x)) for x in (1000, 0.1, 200, 100, 0, 0, 0, 0)]))
    return timeseries.yearly_synthetic(own, [1995, 1996], scale=10000.0, tolerance=0.3).withColumn("value", F.bround("value", 6))


@part.add("rasterize_touched", "polygons", "SELECT poly_id, row, col FROM (SELECT poly_id, r, c, unnest(range(-1, 4)) AS i FROM polygons) CROSS JOIN (SELECT unnest(range(-1, 5)) AS j) CROSS JOIN LATERAL (SELECT CAST(r + i AS BIGINT) AS row, CAST(c + j AS BIGINT) AS col) WHERE row >= 0 AND col >= 0 AND row < 1500 AND col < 100 AND i BETWEEN 0 AND 2 AND j BETWEEN 0 AND 3")
def _(polygons: DataFrame) -> DataFrame:
    x0, y0 = F.col("c") * 10.0 + 500000.0, F.lit(9000000.0) - F.col("r") * 10.0
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    # Sides a little inside the lines of the grid, so that they touch no further pixels.
    ring = F.array(corner(x0 + 1, y0 - 1), corner(x0 + 39, y0 - 1), corner(x0 + 39, y0 - 29), corner(x0 + 1, y0 - 29), corner(x0 + 1, y0 - 1))
    return raster.rasterize_touched(polygons.select("poly_id", ring.alias("ring")), UTM).select("poly_id", "row", "col")


# Where place alone counts, seeds stay in the middle of their cells.
@part.add("superpixels_by_place", "px_bands", "SELECT row, col, CAST((row // 5 * 5) * 2147483648 + col // 5 * 5 AS BIGINT) AS seg FROM px_bands")
def _(px: DataFrame) -> DataFrame:
    return superpixels.superpixels(px.select("row", "col", (F.col("red") / 10000).alias("red")), ["red"], spacing=5, compactness=1e6, rounds=3)


@part.add("superpixels", "px_bands")
def _(px: DataFrame) -> DataFrame:
    made = raster.make_features(px, ["blue", "green", "red", "nir"])
    return superpixels.superpixels(made, ["red", "nir", "ndvi"], spacing=5, compactness=0.1, rounds=4)


# Straight lines and no change.
@part.add("trend_segments", "px_scenes", """
WITH o AS (SELECT pixel, year(ts) + (dayofyear(ts) - 1) / 365.25::DOUBLE AS t, value AS y FROM px_scenes WHERE value IS NOT NULL),
s AS (SELECT pixel, min(t) AS a, max(t) AS b, count(*) AS n, regr_slope(y, t - 2024) AS m, regr_intercept(y, t - 2024) AS k, regr_syy(y, t - 2024) AS yy, regr_sxy(y, t - 2024) AS xy FROM o GROUP BY 1)
SELECT pixel, round_even(a, 6) AS tStart, round_even(b, 6) AS tEnd, n, round_even(m, 4) AS slope, round_even(k, 4) AS level, round_even(sqrt((yy - m * xy) / (n - 2)), 4) AS rmse
FROM s WHERE n >= 6 AND b - a >= 0.02
""")
def _(scenes: DataFrame) -> DataFrame:
    t = F.year("ts") + (F.dayofyear("ts") - 1) / F.lit(365.25)
    how = segmentation.Detection(harmonics=0, least_years=0.02, probability=1.0)
    done = segmentation.detect_changes(scenes.select("pixel", t.alias("t"), "value"), ["value"], how)
    slope, level = F.col("coefs_value")[1], F.col("coefs_value")[0] + F.col("coefs_value")[1] * 2024
    return done.select("pixel", F.bround("tStart", 6).alias("tStart"), F.bround("tEnd", 6).alias("tEnd"), "n", F.bround(slope, 4).alias("slope"), F.bround(level, 4).alias("level"), F.bround("rmse_value", 4).alias("rmse"))


@part.add("change_segments", "px_scenes")
def _(scenes: DataFrame) -> DataFrame:
    t = F.year("ts") + (F.dayofyear("ts") - 1) / F.lit(365.25) + F.hour("ts") / F.lit(8766.0)
    how = segmentation.Detection(harmonics=1, consecutive=3, least_years=0.01, probability=0.9)
    return segmentation.detect_changes(scenes.select("pixel", t.alias("t"), "value"), ["value"], how)


QUERIES, ORACLES = part.queries, part.oracles
