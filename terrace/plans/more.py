"""Queries on compositions: smoothing to classes, assessments, stacks, seams of vectors, patches that dissolve."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.functions import scalars
from terrace.grid import UTM, GridSpec
from terrace.operators import areas, components, focal, fusion, raster, reports, sampling, timeseries, transitions
from terrace.plans.accuracy import _AT, _rings
from terrace.plans.pixels import _LOGIT, _LONG, _SM, _TABLE, N, _mv, _p
from terrace.plans.registry import Part, with_fixtures
from terrace.schema import IMPOSSIBLE, MMU, SMOOTHNESS
from terrace.sources.vector import preview_urls

part = Part()

_POST = f"po AS (SELECT row, col, k, 1 / (1 + exp(-(v * s / ({_SM}[k + 1] + s) + m * {_SM}[k + 1] / ({_SM}[k + 1] + s)))) AS e FROM mv)"


@part.add("smooth_and_classify", "px_levels", f"WITH {_LONG}, {_mv(_LOGIT, 1)}, {_POST}, nz AS (SELECT row, col FROM lv GROUP BY 1, 2 HAVING max(v) > 0) SELECT row, col, CASE WHEN max(nz.row) IS NULL THEN 0 ELSE CAST(arg_max(k, round_even(e, 12)) + 1 AS INT) END AS cls FROM po LEFT JOIN nz USING (row, col) GROUP BY 1, 2")
def _(levels: DataFrame) -> DataFrame:
    return focal.smooth_and_classify(_p(levels), list(range(1, N + 1)), smoothness=SMOOTHNESS[:N], window=3, scale=10000.0)


@part.add("logit_variance", "px_levels", f"WITH {_LONG}, {_mv(_LOGIT, 1)} SELECT row, col, CAST(k AS INT) AS k, round_even(s, 5) AS var FROM mv")
def _(levels: DataFrame) -> DataFrame:
    done = focal.local_variance(_p(levels), window=3, scale=10000.0)
    return done.select("row", "col", F.posexplode("var").alias("k", "x")).select("row", "col", "k", F.bround("x", 5).alias("var"))


@part.add("logits_near_the_ends", "px_levels", f"WITH {_LONG} SELECT row, col, CAST(k AS INT) AS k, round_even(ln(c) - ln(1 - c), 5) AS logit FROM (SELECT row, col, k, greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, v / 10000.0::DOUBLE)) AS c FROM lv)")
def _(levels: DataFrame) -> DataFrame:
    lo = scalars.to_logits(F.transform("p", lambda x: x / 10000.0), 1e-6)
    return _p(levels).select("row", "col", F.posexplode(lo).alias("k", "x")).select("row", "col", "k", F.bround("x", 5).alias("logit"))


@part.add("valid_mask", "px_epochs", "SELECT row, col, CASE WHEN e0 <> 0 THEN 255 ELSE 0 END AS mask FROM px_epochs")
def _(px: DataFrame) -> DataFrame:
    return raster.valid_mask(px, "e0")


@part.add("extract_points", "points px_epochs", f"SELECT point_id, class_id, p.row, p.col, e0, e2 FROM (SELECT *, {_AT} FROM points) p JOIN px_epochs USING (row, col)")
def _(points: DataFrame, px: DataFrame) -> DataFrame:
    return sampling.load_and_extract(px, points, UTM, bands=["e0", "e2"])


@part.add("extract_polygons", "polygons px_epochs", "SELECT poly_id, class_id, row, col, e0, e2 FROM polygons JOIN px_epochs ON row BETWEEN r AND r + 2 AND col BETWEEN c AND c + 3")
def _(polygons: DataFrame, px: DataFrame) -> DataFrame:
    return sampling.load_and_extract(px, _rings(polygons), UTM, bands=["e0", "e2"], key="poly_id")


@part.add("split_training_data", "polygons px_epochs", "SELECT class_id, CAST(round_even(count(*) * 0.3::DOUBLE, 0) AS BIGINT) AS n_test, count(*) AS n FROM polygons JOIN px_epochs ON row BETWEEN r AND r + 2 AND col BETWEEN c AND c + 3 GROUP BY 1")
def _(polygons: DataFrame, px: DataFrame) -> DataFrame:
    done = sampling.load_and_split(px, _rings(polygons), UTM, bands=["e0"], key="poly_id")
    return done.groupBy("class_id").agg(F.count_if("is_test").alias("n_test"), F.count(F.lit(1)).alias("n"))


@part.add("point_indices", "points px_bands", f"SELECT point_id, class_id, green::DOUBLE AS green, red::DOUBLE AS red, nir::DOUBLE AS nir, round_even((nir - red) / (nir + red)::DOUBLE, 6) AS ndvi, round_even(1.5::DOUBLE * (nir - red) / (nir + red + 0.5::DOUBLE), 6) AS savi, round_even((green - nir) / (green + nir)::DOUBLE, 6) AS ndwi FROM (SELECT *, {_AT} FROM points) p JOIN px_bands USING (row, col)")
def _(points: DataFrame, bands: DataFrame) -> DataFrame:
    got = sampling.raster_features(bands, points, UTM, bands=["green", "red", "nir"], names=["green", "red", "nir"])
    return got.select("point_id", "class_id", "green", "red", "nir", *[F.bround(i, 6).alias(i) for i in ("ndvi", "savi", "ndwi")])


@part.add("merge_two_rasters", "points px_epochs", f"SELECT point_id, class_id, e0, e1 FROM (SELECT *, {_AT} FROM points) p JOIN px_epochs USING (row, col)")
def _(points: DataFrame, px: DataFrame) -> DataFrame:
    one, two = (sampling.point_pixels(points, px, UTM, bands=[b]).select("point_id", "class_id", b) for b in ("e0", "e1"))
    return sampling.merge_samples(one, two)


_POLY = "pp AS (SELECT poly_id, CAST(class_id AS INT) AS r, CAST(e3 AS INT) AS m FROM polygons JOIN px_epochs ON row BETWEEN r AND r + 2 AND col BETWEEN c AND c + 3 WHERE e3 > 0), mj AS (SELECT r, m FROM (SELECT poly_id, r, m, row_number() OVER (PARTITION BY poly_id ORDER BY count(*) DESC, m) AS k FROM pp GROUP BY 1, 2, 3) WHERE k = 1)"


@part.add("assess_map_polygons", "polygons px_epochs", f"""WITH {_POLY}, c AS (SELECT DISTINCT e3 AS cls FROM px_epochs WHERE e3 > 0 UNION SELECT r FROM mj), g AS (SELECT cls, (SELECT count(*) FROM mj WHERE m = cls) AS n_map, (SELECT count(*) FROM mj WHERE r = cls) AS n_ref, (SELECT count(*) FROM mj WHERE r = cls AND m = cls) AS hit FROM c)
SELECT CAST(cls AS INT) AS cls, 'Class_' || cls AS class_name, n_map, n_ref, CASE WHEN n_map > 0 THEN round_even(hit / n_map::DOUBLE, 6) END AS ua, CASE WHEN n_ref > 0 THEN round_even(hit / n_ref::DOUBLE, 6) END AS pa FROM g""")
def _(polygons: DataFrame, px: DataFrame) -> DataFrame:
    done = reports.assess_map(px, _rings(polygons).drop("r", "c"), UTM, cls="e3", key="poly_id")
    return done.classes.select("cls", "class_name", "n_map", "n_ref", "ua", "pa")


@part.add("batch_accuracy", "points px_epochs", " UNION ALL ".join(f"SELECT 'map_20{10 + 5 * k}' AS name, '20{10 + 5 * k}' AS year, count(*) AS n, round_even(avg(CASE WHEN e{k} = class_id THEN 1.0::DOUBLE ELSE 0 END), 6) AS oa FROM (SELECT *, {_AT} FROM points) p JOIN px_epochs USING (row, col) WHERE e{k} > 0" for k in range(4)))
def _(points: DataFrame, px: DataFrame) -> DataFrame:
    maps = {f"map_20{10 + 5 * k}": px.select("row", "col", F.col(f"e{k}").alias("cls")) for k in range(4)}
    return reports.batch_summary(maps, points, UTM).select("name", "year", "n", "oa")


_SPANS = (("2010-2015", "e0", "e1"), ("2015-2020", "e1", "e2"), ("2020-2025", "e2", "e3"), ("net", "e0", "e3"))


@part.add("change_analysis", "px_epochs", "WITH v AS (SELECT * FROM px_epochs WHERE e0 > 0 AND e1 > 0 AND e2 > 0 AND e3 > 0) " + " UNION ALL ".join(f"SELECT '{n}' AS interval, {a} AS from_cls, {b} AS to_cls, count(*) AS n_pixels, round_even(count(*) * 0.01::DOUBLE, 4) AS area_ha FROM v GROUP BY 2, 3" for n, a, b in _SPANS))
def _(px: DataFrame) -> DataFrame:
    return transitions.analyse(px, {2010: "e0", 2015: "e1", 2020: "e2", 2025: "e3"}, list(range(1, 19)), UTM).matrices


_ST = lambda b: f"greatest(0, least(1, ({b} - l_{b}) / (h_{b} - l_{b} + 1e-9)))"


@part.add("stretched_features", "px_bands", "WITH n AS (SELECT row, col, red::DOUBLE AS red, nir::DOUBLE AS nir, (nir - red) / (nir + red)::DOUBLE AS ndvi FROM px_bands), q AS (SELECT " + ", ".join(f"quantile_cont({b}, 0.02) AS l_{b}, quantile_cont({b}, 0.98) AS h_{b}" for b in ("red", "nir", "ndvi")) + " FROM n) SELECT row, col, " + ", ".join(f"round_even({_ST(b)}, 6) AS {b}" for b in ("red", "nir", "ndvi")) + " FROM n, q")
def _(bands: DataFrame) -> DataFrame:
    return raster.make_features(bands, ["red", "nir"]).select("row", "col", *[F.bround(b, 6).alias(b) for b in ("red", "nir", "ndvi")])


_MINE = "r0 AS (SELECT *, CASE WHEN e3 IN (3, 4) AND corridor = 1 THEN 18 ELSE e3 END AS c0 FROM px_epochs JOIN px_masks USING (row, col)), r1 AS (SELECT *, CASE WHEN c0 = 16 AND corridor = 1 AND settlement <> 1 THEN 17 ELSE c0 END AS c1 FROM r0)"


@part.add("resolved_mask_rules", "px_epochs px_masks", f"WITH {_MINE} SELECT row, col, CASE WHEN c1 IN (17, 18) AND settlement = 1 AND corridor <> 1 THEN 16 ELSE c1 END AS cls FROM r1")
def _(px: DataFrame, masks: DataFrame) -> DataFrame:
    rules = fusion.resolve_rules([fusion.MaskRule((3, 4), 18, "corridor")], "corridor", "settlement")
    return px.join(masks, ["row", "col"]).select("row", "col", fusion.apply_rules(F.col("e3"), rules).alias("cls"))


_STABLE = [(3, 5), (4, 5), (12, 11)]
_pairs = lambda rules: "(" + ", ".join(str(a * 256 + b) for a, b in rules) + ")"


@part.add("consistency_of_two_rule_sets", "px_epochs px_masks", f"SELECT row, col, CASE WHEN hit THEN e1 ELSE e0 END AS cls, hit AS changed FROM (SELECT *, (e0 * 256 + e1 IN {_pairs(IMPOSSIBLE)}) OR (e0 * 256 + e1 IN {_pairs(_STABLE)} AND settlement = 1) AS hit FROM px_epochs JOIN px_masks USING (row, col))")
def _(px: DataFrame, masks: DataFrame) -> DataFrame:
    cls, hit = transitions.enforce(F.col("e0"), F.col("e1"), IMPOSSIBLE, _STABLE, F.col("settlement") == 1)
    return px.join(masks, ["row", "col"]).select("row", "col", cls.alias("cls"), hit.alias("changed"))


@part.add("segment_statistics", "px_bands px_segments", "SELECT seg, count(*) AS n, CASE WHEN count(*) <= 14 THEN round_even(avg(nir), 6) END AS nir_mean, CASE WHEN count(*) <= 14 THEN round_even(stddev_pop(nir), 6) END AS nir_sd FROM px_bands JOIN px_segments USING (row, col) WHERE seg > 0 GROUP BY 1")
def _(bands: DataFrame, segs: DataFrame) -> DataFrame:
    done = fusion.segment_statistics(bands.join(segs, ["row", "col"]), ["nir"], most=14)
    return done.select("seg", "n", F.bround("nir_mean", 6).alias("nir_mean"), F.bround("nir_sd", 6).alias("nir_sd"))


_T = 2003.5
_COEF = ("0.00001", "0.002", "0.001")


def _value(band: str) -> str:
    at = f"greatest(least({_T}::DOUBLE, e), s)"
    return f"{band} / 40000.0::DOUBLE + {_COEF[0]}::DOUBLE * {at} + {_COEF[1]}::DOUBLE * cos(2 * pi() * {at}) + {_COEF[2]}::DOUBLE * sin(2 * pi() * {at})"


_SYN = f"sg AS (SELECT *, (2000 + row % 3)::DOUBLE AS s, (2001 + (3 * row + col) % 5)::DOUBLE AS e FROM px_bands), sy AS (SELECT row, col, " + ", ".join(f"CASE WHEN greatest(s - {_T}::DOUBLE, {_T}::DOUBLE - e, 0) <= 0.6 AND {_value(b)} > -0.05 AND {_value(b)} < 1.5 THEN {_value(b)} END AS {b}" for b in ("red", "nir")) + " FROM sg)"
_SYN += ", fl AS (SELECT a.row, a.col, " + ", ".join(f"CASE WHEN any_value(a.{b}) IS NOT NULL THEN any_value(a.{b}) WHEN count(n.{b}) >= 5 THEN median(n.{b}) END AS {b}" for b in ("red", "nir")) + " FROM sy a JOIN sy n ON abs(a.row - n.row) <= 1 AND abs(a.col - n.col) <= 1 GROUP BY 1, 2)"


@part.add("synthetic_stack", "px_bands", f"WITH {_SYN} SELECT row, col, round_even(red, 6) AS red, round_even(nir, 6) AS nir, CASE WHEN nir + red <> 0 THEN round_even((nir - red) / (nir + red), 5) + 0 END AS ndvi FROM fl")
def _(bands: DataFrame) -> DataFrame:
    coefs = lambda b: F.array(F.col(b) / 40000.0, *[F.lit(float(x)) for x in _COEF], *[F.lit(0.0)] * 4).alias(f"c_{b}")
    px = bands.select("row", "col", (2000 + F.col("row") % 3).cast("double").alias("tStart"), (2001 + (3 * F.col("row") + F.col("col")) % 5).cast("double").alias("tEnd"), coefs("red"), coefs("nir"))
    done = timeseries.synthetic_stack(px, ["red", "nir"], _T, tolerance=0.6, indices=("NDVI",))
    return done.select("row", "col", F.bround("red", 6).alias("red"), F.bround("nir", 6).alias("nir"), F.bround("ndvi", 5).alias("ndvi"))


_HOLE = "SELECT h.row, h.col, arg_min(v.e0, d) AS f0, arg_min(v.e1, d) AS f1 FROM (SELECT h.row, h.col, v.e0, v.e1, (v.row - h.row) * (v.row - h.row) * 1e6 + (v.col - h.col) * (v.col - h.col) * 1e6 + (v.row - h.row) * 100 + (v.col - h.col) AS d FROM px_epochs h JOIN px_epochs v ON v.row BETWEEN h.row - 4 AND h.row + 4 AND v.col BETWEEN h.col - 4 AND h.col + 4 AND (v.row - h.row) * (v.row - h.row) + (v.col - h.col) * (v.col - h.col) <= 16 WHERE h.e0 = 0 AND h.e1 = 0 AND (v.e0 <> 0 OR v.e1 <> 0)) x(row, col, e0, e1, d) GROUP BY 1, 2"
_HOLE = _HOLE.replace("SELECT h.row, h.col, arg_min(v.e0, d) AS f0, arg_min(v.e1, d) AS f1", "SELECT row, col, arg_min(e0, d) AS f0, arg_min(e1, d) AS f1", 1)


@part.add("heal_seams_of_vectors", "px_epochs", f"WITH f AS ({_HOLE}) SELECT row, col, CASE WHEN e0 = 0 AND e1 = 0 THEN coalesce(f0, 0) ELSE e0 END AS e0, CASE WHEN e0 = 0 AND e1 = 0 THEN coalesce(f1, 0) ELSE e1 END AS e1 FROM px_epochs LEFT JOIN f USING (row, col)")
def _(px: DataFrame) -> DataFrame:
    return focal.heal_seams(px, value=["e0", "e1"])


def _fractional(source: str, line: str, along: str, name: str) -> str:
    cells = ", ".join(f"CASE WHEN lag({along}) OVER w = {along} - 1 THEN lag(p{k}) OVER w END AS a{k}, CASE WHEN lead({along}) OVER w = {along} + 1 THEN lead(p{k}) OVER w END AS b{k}" for k in range(N))
    up = lambda k, t: f"(p{k} - a{k} > {t}::DOUBLE AND p{k} - b{k} > {t}::DOUBLE)"
    down = lambda k, t: f"(a{k} - p{k} > {t}::DOUBLE AND b{k} - p{k} > {t}::DOUBLE)"
    hit = f"a0 IS NOT NULL AND b0 IS NOT NULL AND ({' OR '.join(up(k, 0.06) for k in range(N))} OR {' + '.join(f'CAST({up(k, 0.01)} OR {down(k, 0.01)} AS INT)' for k in range(N))} >= 3)"
    out = ", ".join(f"CASE WHEN {hit} THEN (a{k} + b{k}) / 2 ELSE p{k} END AS p{k}" for k in range(N))
    return f"{name}_n AS (SELECT *, {cells} FROM {source} WINDOW w AS (PARTITION BY {line} ORDER BY {along})), {name} AS (SELECT row, col, {out} FROM {name}_n)"


@part.add("heal_fractional_spikes", "px_levels", f"WITH u AS (SELECT row, col, {', '.join(f'p{k} / 10000.0::DOUBLE AS p{k}' for k in range(N))} FROM px_levels), {_fractional('u', 'row', 'col', 'h1')}, {_fractional('h1', 'col', 'row', 'h2')} SELECT row, col, {', '.join(f'round_even(p{k}, 7) AS p{k}' for k in range(N))} FROM h2")
def _(levels: DataFrame) -> DataFrame:
    done = focal.heal_spikes(_p(levels).withColumn("p", F.transform("p", lambda x: x / 10000.0)), bands=N)
    return done.select("row", "col", *[F.bround(F.col("p")[k], 7).alias(f"p{k}") for k in range(N)])


@part.add("feature_stack_of_layers", "px_bands", "SELECT row, col, (nir + swir1) / 2.0::DOUBLE AS B08, red::DOUBLE AS B04, green::DOUBLE AS soil, round_even(((nir + swir1) / 2.0::DOUBLE - red) / ((nir + swir1) / 2.0::DOUBLE + red), 6) AS NDVI FROM px_bands")
def _(bands: DataFrame) -> DataFrame:
    layer = lambda name, b: raster.Layer(name, bands.select("row", "col", F.col(b).cast("double").alias("value")), UTM)
    done, _, _ = raster.create_feature_stack([layer("B08", "nir"), layer("B08", "swir1"), layer("B04", "red")], layers=[layer("data", "green")], aliases={"data": "soil"}, indices=["ndvi"])
    return done.withColumn("NDVI", F.bround("NDVI", 6))


_SMALL = GridSpec(150, 100, 10.0, 0.0, 500000.0, 0.0, -10.0, 9000000.0, 32751)


@part.add("distance_to_polygons", "polygons", "SELECT k.r AS row, l.c AS col, round_even(sqrt(min(pow(10 * greatest(p.c - l.c, 0, l.c - p.c - 3), 2) + pow(10 * greatest(p.r - k.r, 0, k.r - p.r - 2), 2))), 6) AS distance FROM (SELECT unnest(range(150)) AS r) k, (SELECT unnest(range(100)) AS c) l, polygons p GROUP BY 1, 2")
def _(polygons: DataFrame) -> DataFrame:
    x0, y0 = F.col("c") * 10.0 + 500000.0, F.lit(9000000.0) - F.col("r") * 10.0
    inset = F.array(*[F.struct((x0 + a).alias("x"), (y0 - b).alias("y")) for a, b in ((1, 1), (39, 1), (39, 29), (1, 29), (1, 1))])
    done = raster.distance_features({"distance": polygons.select(inset.alias("ring"))}, _SMALL)
    return done.select("row", "col", F.bround("distance", 6).alias("distance"))


@part.add("preview_urls", "scene_list", "SELECT item_id, 'https://preview.example.org/item?collection=scenes&item=' || item_id || '&assets=visual' AS preview_url FROM scene_list")
def _(scenes: DataFrame) -> DataFrame:
    own = scenes.select("item_id", F.lit("scenes").alias("collection"), F.array(F.lit("visual"), F.lit("B04")).alias("assets"))
    return preview_urls(own, "https://preview.example.org/item").select("item_id", "preview_url")


# Patches of eight neighbours by runs along rows; then steps of the mode, as long as a small pixel lacks a class.
_PATCH8 = """k AS (SELECT row, col, e0 AS cls, col - row_number() OVER (PARTITION BY row, e0 ORDER BY col) AS g FROM px_epochs WHERE e0 > 0),
run AS (SELECT row, cls, min(col) AS c0, max(col) AS c1, row * 1000 + min(col) AS id FROM k GROUP BY row, cls, g),
nb AS (SELECT a.id AS a, b.id AS b FROM run a JOIN run b ON b.row IN (a.row - 1, a.row + 1) AND a.cls = b.cls AND a.c0 <= b.c1 + 1 AND b.c0 <= a.c1 + 1),
reach AS (SELECT id AS a, id AS b FROM run UNION SELECT r.a, nb.b FROM reach r JOIN nb ON nb.a = r.b),
root AS (SELECT a AS id, min(b) AS root FROM reach GROUP BY 1),
px AS (SELECT k.row, k.col, k.cls, root FROM k JOIN run ON run.row = k.row AND run.cls = k.cls AND k.col BETWEEN c0 AND c1 JOIN root USING (id)),
sz AS (SELECT root, count(*) AS n FROM px GROUP BY 1)"""


def _least(table: dict[int, int]) -> str:
    return "CASE cls " + " ".join(f"WHEN {k} THEN {v}" for k, v in table.items()) + " ELSE 0 END"


def _steps(many: int) -> str:
    out = [f"m0 AS (SELECT row, col, cls, n < {_least(MMU)} AS small, CASE WHEN n >= {_least(MMU)} THEN cls END AS cur FROM px JOIN sz USING (root))", "o AS (SELECT unnest([-1, 0, 1]) AS dr), oo AS (SELECT a.dr, b.dr AS dc FROM o a, o b)"]
    for k in range(1, many + 1):
        b = f"m{k - 1}"
        votes = f"(SELECT row + dr AS row, col + dc AS col, cur, count(*) AS v FROM {b}, oo WHERE cur IS NOT NULL GROUP BY 1, 2, 3)"
        out.append(f"d{k} AS (SELECT row, col, arg_max(cur, v * 100 - cur) AS mode FROM {votes} GROUP BY 1, 2)")
        out.append(f"m{k} AS (SELECT row, col, cls, small, CASE WHEN (SELECT count(*) FROM {b} WHERE small AND cur IS NULL) > 0 THEN coalesce(mode, cur) ELSE cur END AS cur FROM {b} LEFT JOIN d{k} USING (row, col))")
    return ", ".join(out)


@part.add("mmu_dissolve", "px_epochs", f"WITH RECURSIVE {_PATCH8}, {_steps(6)} SELECT row, col, CASE WHEN small AND cur IS NOT NULL THEN cur ELSE e0 END AS cls FROM px_epochs LEFT JOIN m6 USING (row, col)")
def _(px: DataFrame) -> DataFrame:
    return components.dissolve_small(px.select("row", "col", F.col("e0").alias("cls")), MMU, tile=64)


@part.add("patch_sizes", "px_epochs", f"WITH RECURSIVE {_PATCH8} SELECT row, col, cls, n AS size FROM px JOIN sz USING (root)")
def _(px: DataFrame) -> DataFrame:
    return components.patches(px.where("e0 > 0"), "e0").select("row", "col", F.col("cls").cast("int").alias("cls"), "size")


@part.add("class_area_ordered", "px_epochs", "SELECT e2 AS cls, 'Class ' || e2 AS class_name, count(*) AS n_pixels, round_even(count(*) * 0.01::DOUBLE, 4) AS area_ha FROM px_epochs WHERE e2 > 0 GROUP BY 1")
def _(px: DataFrame) -> DataFrame:
    return areas.class_area(px, UTM, None, "e2")


QUERIES, ORACLES = part.queries, part.oracles
# The same for queries of another module.
ORACLES["mmu_fill"] = ORACLES["mmu_dissolve"]
ORACLES["mmu_small_patches"] = with_fixtures(["px_epochs"], f"WITH RECURSIVE {_PATCH8} SELECT row, col, cls, n < {_least(_TABLE)} AS is_small FROM px JOIN sz USING (root)")
