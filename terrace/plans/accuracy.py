"""Queries on accuracy, samples and flags."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.grid import UTM
from terrace.operators import accuracy, areas, outliers, sampling
from terrace.plans.registry import Part

part = Part()
_M = "m AS (SELECT map_class AS i, ref_class AS j, count(*) AS n FROM ref_samples GROUP BY 1, 2), tot AS (SELECT sum(n)::DOUBLE AS nn FROM m), g AS (SELECT c AS cls, coalesce((SELECT sum(n) FROM m WHERE i = c), 0)::BIGINT AS n_map, coalesce((SELECT sum(n) FROM m WHERE j = c), 0)::BIGINT AS n_ref, coalesce((SELECT sum(n) FROM m WHERE i = c AND j = c), 0)::BIGINT AS hit, nn FROM (SELECT i AS c FROM m UNION SELECT j FROM m), tot)"
_Z = NormalDist().inv_cdf(0.975)


@part.add("confusion_matrix", "ref_samples", "SELECT CAST(map_class AS INT) AS map_class, CAST(ref_class AS INT) AS ref_class, count(*) AS n FROM ref_samples GROUP BY 1, 2")
def _(s: DataFrame) -> DataFrame:
    return accuracy.confusion(s)


@part.add("confusion_table", "ref_samples", "WITH p AS (SELECT CAST(map_class AS VARCHAR) AS map_class, " + ", ".join(f"count(*) FILTER (ref_class = {k}) AS c_{k}" for k in range(1, 7)) + ", count(*) AS total FROM ref_samples GROUP BY 1) SELECT * FROM p UNION ALL SELECT 'total', " + ", ".join(f"CAST(sum(c_{k}) AS BIGINT)" for k in range(1, 7)) + ", CAST(sum(total) AS BIGINT) FROM p")
def _(s: DataFrame) -> DataFrame:
    return accuracy.confusion_table(accuracy.confusion(s), list(range(1, 7)))


@part.add("class_accuracy", "ref_samples", f"""WITH {_M}, x AS (SELECT *, CASE WHEN n_map > 0 THEN hit / n_map::DOUBLE END AS ua, CASE WHEN n_ref > 0 THEN hit / n_ref::DOUBLE END AS pa, (nn - n_map - n_ref + hit) / (nn - n_ref) AS spec FROM g)
SELECT CAST(cls AS INT) AS cls, n_map, n_ref, round_even(ua, 6) AS ua, CASE WHEN n_map > 1 THEN round_even(sqrt(ua * (1 - ua) / (n_map - 1)), 6) END AS ua_se, round_even(pa, 6) AS pa, CASE WHEN n_ref > 1 THEN round_even(sqrt(pa * (1 - pa) / (n_ref - 1)), 6) END AS pa_se,
round_even(spec, 6) AS specificity, CASE WHEN ua + pa > 0 THEN round_even(2 * ua * pa / (ua + pa), 6) ELSE 0 END AS f1, round_even(sqrt(pa * spec), 6) AS g_mean, round_even(sqrt(ua * pa), 6) AS fowlkes_mallows, round_even(1 - ua, 6) AS commission, round_even(1 - pa, 6) AS omission FROM x""")
def _(s: DataFrame) -> DataFrame:
    return accuracy.class_accuracy(accuracy.confusion(s))


@part.add("overall_accuracy", "ref_samples", f"""WITH {_M}, y AS (SELECT *, CASE WHEN n_map > 0 THEN hit / n_map::DOUBLE ELSE 0 END AS ua, CASE WHEN n_ref > 0 THEN hit / n_ref::DOUBLE END AS pa, (nn - n_map - n_ref + hit) / (nn - n_ref) AS spec, 2.0::DOUBLE * hit / (n_map + n_ref) AS f1 FROM g), x AS (SELECT *, sqrt(pa * spec) AS gm, sqrt(ua * pa) AS fm FROM y),
a AS (SELECT count(*) AS many, max(nn) AS n, sum(hit)::DOUBLE AS c, sum(n_map * n_ref)::DOUBLE AS pt, sum(n_map * n_map)::DOUBLE AS pp, sum(n_ref * n_ref)::DOUBLE AS tt, avg(pa) AS bal, avg(f1) AS f1m, sum(f1 * n_ref) AS f1w, min(pa) AS least, avg(CASE WHEN pa > 0 THEN ln(pa) END) AS lnpa, avg(gm) AS gmm, sum(gm * n_ref) AS gmw, avg(fm) AS fmm, sum(fm * n_ref) AS fmw FROM x)
SELECT CAST(n AS BIGINT) AS n, many AS num_classes, round_even(c / n, 6) AS oa, round_even(sqrt(c / n * (1 - c / n) / (n - 1)), 6) AS oa_se, round_even(sqrt(c / n * (1 - c / n) / (n - 1)) * {_Z}::DOUBLE, 6) AS oa_ci, round_even(bal, 6) AS balanced_accuracy, round_even(f1m, 6) AS f1_macro, round_even(f1w / n, 6) AS f1_weighted, round_even(c / n, 6) AS f1_micro,
round_even(gmm, 6) AS g_mean_macro, round_even(gmw / n, 6) AS g_mean_weighted, round_even(fmm, 6) AS fowlkes_macro, round_even(fmw / n, 6) AS fowlkes_weighted,
round_even((c / n - pt / (n * n)) / (1 - pt / (n * n)), 6) AS kappa, round_even((c * n - pt) / sqrt((n * n - pp) * (n * n - tt)), 6) AS mcc, CASE WHEN least > 0 THEN round_even(exp(lnpa), 6) ELSE 0 END AS g_mean_multiclass FROM a""")
def _(s: DataFrame) -> DataFrame:
    return accuracy.overall_accuracy(accuracy.confusion(s))


_W = _M + ", k AS (SELECT e3 AS cls, count(*) AS n FROM px_epochs WHERE e3 BETWEEN 1 AND 6 GROUP BY 1), w AS (SELECT m.i, m.j, k.n / (SELECT sum(n) FROM k)::DOUBLE AS w, m.n / ni::DOUBLE AS q, ni FROM m JOIN k ON k.cls = m.i JOIN (SELECT i, sum(n) AS ni FROM m GROUP BY 1) r ON r.i = m.i), c AS (SELECT i, j, w * q AS p, CASE WHEN ni > 1 THEN w * w * q * (1 - q) / (ni - 1) ELSE 0 END AS v FROM w)"


def _counts(px: DataFrame) -> DataFrame:
    return areas.pixel_counts(px.where("e3 BETWEEN 1 AND 6"), cls="e3")


@part.add("area_weighted_accuracy", "ref_samples px_epochs", f"WITH {_W} SELECT round_even(sum(p), 6) AS oa_area, round_even(sqrt(sum(v)), 6) AS oa_area_se FROM c WHERE i = j")
def _(s: DataFrame, px: DataFrame) -> DataFrame:
    return accuracy.area_weighted_overall(accuracy.confusion(s), _counts(px))


def _unit(name: str, unit: str, k: int) -> str:
    se = f"big * {unit} * sqrt(vj)"
    return (
        f"round_even(mapped * {unit}, {k}) AS mapped_{name}, round_even(big * {unit} * pj, {k}) AS area_{name}, round_even({se}, {k}) AS se_{name}, round_even({se} * {_Z}::DOUBLE, {k}) AS ci_{name}, "
        f"round_even(greatest(0, big * {unit} * pj - {se} * {_Z}::DOUBLE), {k}) AS low_{name}, round_even(big * {unit} * pj + {se} * {_Z}::DOUBLE, {k}) AS high_{name}"
    )


@part.add("adjusted_area", "ref_samples px_epochs", f"""WITH {_W}, per AS (SELECT j, sum(p) AS pj, sum(CASE WHEN i = j THEN p ELSE 0 END) AS pjj, sum(v) AS vj FROM c GROUP BY 1), e AS (SELECT c.j, sum(v * pow(CASE WHEN c.i = c.j THEN 1 ELSE 0 END - pjj / pj, 2)) AS pv FROM c JOIN per USING (j) GROUP BY 1),
t AS (SELECT per.*, pv, k.n AS mapped, (SELECT sum(n) FROM k)::DOUBLE AS big FROM per JOIN e USING (j) JOIN k ON k.cls = per.j)
SELECT CAST(j AS INT) AS cls, mapped AS mapped_pixels, round_even(mapped / big, 6) AS map_weight, round_even(pjj / pj, 6) AS pa_area, round_even(sqrt(pv) / pj, 6) AS pa_area_se, round_even(sqrt(pv) / pj * {_Z}::DOUBLE, 6) AS pa_area_ci, round_even(pj, 6) AS share, round_even(sqrt(vj), 6) AS share_se,
round_even(big * pj, 4) AS pixels, round_even(big * sqrt(vj), 4) AS pixels_se, round_even(big * sqrt(vj) * {_Z}::DOUBLE, 4) AS pixels_ci, {_unit('ha', '0.01::DOUBLE', 4)}, {_unit('km2', '0.0001::DOUBLE', 6)}, round_even(sqrt(vj) / pj, 6) AS cv FROM t""")
def _(s: DataFrame, px: DataFrame) -> DataFrame:
    return accuracy.adjusted_area(accuracy.confusion(s), _counts(px), UTM.mean_pixel_area_m2())


_AT = "CAST(floor((y - 9000000.0::DOUBLE) / -10) AS BIGINT) AS row, CAST(floor((x - 500000.0::DOUBLE) / 10) AS BIGINT) AS col"


@part.add("point_sample_join", "points px_epochs", f"SELECT point_id, class_id, p.row, p.col, e0, e3 FROM (SELECT *, {_AT} FROM points) p JOIN px_epochs USING (row, col)")
def _(points: DataFrame, px: DataFrame) -> DataFrame:
    return sampling.point_pixels(points, px, UTM, bands=["e0", "e3"])


@part.add("map_accuracy_from_points", "points px_epochs", f"SELECT CAST(e3 AS INT) AS map_class, CAST(class_id AS INT) AS ref_class, count(*) AS n FROM (SELECT *, {_AT} FROM points) p JOIN px_epochs USING (row, col) WHERE e3 > 0 GROUP BY 1, 2")
def _(points: DataFrame, px: DataFrame) -> DataFrame:
    got = sampling.point_pixels(points, px.where("e3 > 0"), UTM, bands=["e3"])
    return accuracy.confusion(got, "class_id", "e3")


# The mapping goes step by step over samples (1 to 2, and that to 3), in one step over counts.
_CHAIN = {1: 2, 2: 3, 17: 1}


@part.add("accuracy_with_mapping", "points px_epochs", f"""WITH s AS (SELECT CAST(e3 AS INT) AS m, CAST(class_id AS INT) AS r FROM (SELECT *, {_AT} FROM points) p JOIN px_epochs USING (row, col) WHERE e3 > 0),
d AS (SELECT CASE WHEN m IN (1, 2) THEN 3 WHEN m = 17 THEN 1 ELSE m END AS m, CASE WHEN r IN (1, 2) THEN 3 WHEN r = 17 THEN 1 ELSE r END AS r FROM s) SELECT m AS map_class, r AS ref_class, count(*) AS n FROM d GROUP BY 1, 2""")
def _(points: DataFrame, px: DataFrame) -> DataFrame:
    got = sampling.point_pixels(points, px.where("e3 > 0"), UTM, bands=["e3"])
    return accuracy.confusion(got.select(areas.remap_chain(F.col("class_id"), _CHAIN).alias("ref_class"), areas.remap_chain(F.col("e3"), _CHAIN).alias("map_class")))


def _rings(polygons: DataFrame) -> DataFrame:
    x0, y0 = F.col("c") * 10.0 + 500000.0, F.lit(9000000.0) - F.col("r") * 10.0
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return polygons.withColumn("ring", F.array(corner(x0, y0), corner(x0 + 40, y0), corner(x0 + 40, y0 - 30), corner(x0, y0 - 30), corner(x0, y0)))


_PP = "pp AS (SELECT poly_id, CAST(class_id AS INT) AS ref_class, CAST(e3 AS INT) AS map_class FROM polygons JOIN px_epochs ON row BETWEEN r AND r + 2 AND col BETWEEN c AND c + 3)"


@part.add("polygon_sample_all_pixels", "polygons px_epochs", f"WITH {_PP} SELECT * FROM pp")
def _(polygons: DataFrame, px: DataFrame) -> DataFrame:
    return sampling.polygon_samples(_rings(polygons), px, UTM, mode="all_pixels", cls="e3")


@part.add("polygon_sample_majority", "polygons px_epochs", f"WITH {_PP} SELECT poly_id, ref_class, map_class FROM (SELECT poly_id, ref_class, map_class, row_number() OVER (PARTITION BY poly_id ORDER BY count(*) DESC, map_class) AS k FROM pp GROUP BY 1, 2, 3) WHERE k = 1")
def _(polygons: DataFrame, px: DataFrame) -> DataFrame:
    return sampling.polygon_samples(_rings(polygons), px, UTM, cls="e3")


@part.add("polygon_sample_centroid", "polygons px_epochs", "SELECT poly_id, CAST(class_id AS INT) AS ref_class, CAST(e3 AS INT) AS map_class FROM polygons JOIN px_epochs ON row = r + 1 AND col = c + 2")
def _(polygons: DataFrame, px: DataFrame) -> DataFrame:
    return sampling.polygon_samples(_rings(polygons), px, UTM, mode="centroid", cls="e3")


@part.add("polygon_sample_concave", "polygons px_epochs", "SELECT poly_id, CAST(class_id AS INT) AS ref_class, CAST(e3 AS INT) AS map_class FROM polygons JOIN px_epochs ON row = r + 2 AND col = c")
def _(polygons: DataFrame, px: DataFrame) -> DataFrame:
    # An L of six by six pixels, one wide: the mean of its corners lies outside, the inner point in its upright.
    x0, y0 = F.col("c") * 10.0 + 500000.0, F.lit(9000000.0) - F.col("r") * 10.0
    corners = [(0, 0), (10, 0), (10, -50), (60, -50), (60, -60), (0, -60), (0, 0)]
    ell = polygons.withColumn("ring", F.array(*[F.struct((x0 + a).alias("x"), (y0 + b).alias("y")) for a, b in corners]))
    return sampling.polygon_samples(ell, px, UTM, mode="centroid", cls="e3")


@part.add("drop_invalid_samples", "px_bands px_epochs", "SELECT b.row, b.col, blue, nir, e0 FROM px_bands b JOIN px_epochs USING (row, col) WHERE e0 IS NOT NULL AND blue > 500")
def _(bands: DataFrame, px: DataFrame) -> DataFrame:
    j = bands.join(px, ["row", "col"]).select("row", "col", F.when(F.col("blue") > 500, F.col("blue")).alias("blue"), "nir", "e0")
    return sampling.clean_samples(j, ["blue", "nir"], "e0")


@part.add("stratified_split", "points", "SELECT class_id, CAST(round_even(count(*) * 0.3::DOUBLE, 0) AS BIGINT) AS n_test, count(*) AS n FROM points GROUP BY 1")
def _(points: DataFrame) -> DataFrame:
    done = sampling.stratified_split(points, "class_id", "point_id")
    return done.groupBy("class_id").agg(F.count_if("is_test").alias("n_test"), F.count(F.lit(1)).alias("n"))


@part.add("flag_left_join", "points flags", "SELECT point_id, class_id, coalesce(outlier, false) AS outlier, score FROM points LEFT JOIN flags USING (point_id)")
def _(points: DataFrame, flags: DataFrame) -> DataFrame:
    return sampling.join_flags(points.select("point_id", "class_id"), flags)


@part.add("remove_anti_join", "points flags", "SELECT point_id, class_id FROM points WHERE point_id NOT IN (SELECT point_id FROM flags WHERE outlier)")
def _(points: DataFrame, flags: DataFrame) -> DataFrame:
    return sampling.remove_flagged(points.select("point_id", "class_id"), flags)


@part.add("log_loss_by_class", "px_levels px_epochs", "SELECT e0, count(*) AS n, round_even(avg(-ln(p0 / 10000.0::DOUBLE + 1e-7)), 6) AS log_loss FROM px_levels JOIN px_epochs USING (row, col) GROUP BY 1")
def _(p: DataFrame, px: DataFrame) -> DataFrame:
    return accuracy.log_loss(p.join(px, ["row", "col"]).withColumn("p", F.col("p0") / 10000.0), "p", "e0")


@part.add("log_loss_overall", "px_levels px_epochs", "SELECT count(*) AS n, round_even(avg(-ln(greatest(p0 / 10000.0::DOUBLE, 0.001::DOUBLE))), 6) AS log_loss FROM px_levels JOIN px_epochs USING (row, col)")
def _(p: DataFrame, px: DataFrame) -> DataFrame:
    return accuracy.overall_log_loss(p.join(px, ["row", "col"]).withColumn("p", F.col("p0") / 10000.0), "p")


@part.add("outliers_per_class", "px_bands px_segments")
def _(bands: DataFrame, segs: DataFrame) -> DataFrame:
    t = bands.withColumn("point_id", F.col("row") * 25 + F.col("col")).withColumn("class_id", F.col("row") % 3)
    return outliers.outliers(t, ["blue", "green", "red"])


_F3 = ("blue", "green", "red")
_D = [f"({f} - m_{f})" for f in _F3]


def _c(i: int, j: int) -> str:
    return f"c{min(i, j)}{max(i, j)}"


def _cofactor(i: int, j: int) -> str:
    r, k = [x for x in range(3) if x != i], [x for x in range(3) if x != j]
    sign = "" if (i + j) % 2 == 0 else "-"
    return f"{sign}({_c(r[0], k[0])} * {_c(r[1], k[1])} - {_c(r[0], k[1])} * {_c(r[1], k[0])})"


_COV = ", ".join(f"avg({a}::DOUBLE * {b}) - avg({a}) * avg({b}) AS c{i}{j}" for i, a in enumerate(_F3) for j, b in enumerate(_F3) if i <= j)
_QUAD = " + ".join(f"{_D[i]} * {_D[j]} * ({_cofactor(i, j)})" for i in range(3) for j in range(3))


@part.add("outliers_robust", "px_bands")
def _(px: DataFrame) -> DataFrame:
    t = px.select((F.col("row") * 25 + F.col("col")).alias("point_id"), (F.col("row") % 3).alias("class_id"), "blue", "green", "red")
    return outliers.outliers(t, ["blue", "green", "red"], method="elliptic_envelope")


@part.add("outliers_elliptic", "px_bands", f"""WITH t AS (SELECT row * 25 + col AS point_id, row % 3 AS class_id, blue, green, red FROM px_bands), s AS (SELECT class_id, {', '.join(f'avg({f}) AS m_{f}' for f in _F3)}, {_COV} FROM t GROUP BY 1),
d AS (SELECT point_id, class_id, ({_QUAD}) / ({' + '.join(f'{_c(0, j)} * ({_cofactor(0, j)})' for j in range(3))}) AS d FROM t JOIN s USING (class_id)), e AS (SELECT class_id, quantile_cont(d, 0.95) AS e FROM d GROUP BY 1)
SELECT point_id, class_id, d > e AS outlier, round_even(d, 5) AS score FROM d JOIN e USING (class_id)""")
def _(bands: DataFrame) -> DataFrame:
    t = bands.withColumn("point_id", F.col("row") * 25 + F.col("col")).withColumn("class_id", F.col("row") % 3)
    return outliers.outliers(t, ["blue", "green", "red"], method="elliptic").withColumn("score", F.bround("score", 5))


QUERIES, ORACLES = part.queries, part.oracles
