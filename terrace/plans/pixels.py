"""Queries on fusion, rules, neighbourhoods and patches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.functions import scalars
from terrace.operators import components, focal, fusion
from terrace.plans.registry import Part
from terrace.schema import MMU, SMOOTHNESS

part = Part()
N = 10


def _p(levels: DataFrame) -> DataFrame:
    return levels.select("row", "col", F.array(*[F.col(f"p{k}") for k in range(N)]).alias("p"))


_LONG = "lv AS (SELECT row, col, unnest(range(10)) AS k, unnest([p0, p1, p2, p3, p4, p5, p6, p7, p8, p9]) AS v FROM px_levels)"
_MEANS = _LONG + ", sm AS (SELECT seg, k, avg(v / 10000.0::DOUBLE) AS o FROM lv JOIN px_segments USING (row, col) WHERE seg > 0 GROUP BY 1, 2)"
_W = "[" + ", ".join(f"{max(0.2, min(0.9, s / 5))}::DOUBLE" for s in SMOOTHNESS[:N]) + "]"
_FUSE = _MEANS + f""", bl AS (SELECT row, col, seg, k, v, CASE WHEN o IS NULL THEN r ELSE o * w + r * (1 - w) END AS b FROM (SELECT lv.row, lv.col, s.seg, lv.k, v, o, v / 10000.0::DOUBLE AS r, {_W}[lv.k + 1] * (1 - 0.6::DOUBLE * least(1, abs(o - v / 10000.0::DOUBLE))) AS w FROM lv JOIN px_segments s USING (row, col) LEFT JOIN sm ON sm.seg = s.seg AND sm.k = lv.k)),
rk AS (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY b DESC, k) AS n FROM bl),
tt AS (SELECT row, col, max(CASE WHEN n = 1 THEN b END) AS w, max(CASE WHEN n = 1 THEN k END) + 1 AS wi, max(CASE WHEN n = 2 THEN b END) AS s, max(CASE WHEN n = 2 THEN k END) + 1 AS si FROM rk GROUP BY 1, 2),
ci AS (SELECT *, CASE WHEN w > 1e-4 THEN greatest(0, least(1, s / w)) ELSE 0 END AS ci FROM tt)"""


@part.add("segment_mean_probs", "px_levels px_segments", f"WITH {_MEANS} SELECT seg, CAST(k AS INT) AS k, round_even(o, 8) AS mean FROM sm")
def _(levels: DataFrame, segs: DataFrame) -> DataFrame:
    own = _p(levels).join(segs, ["row", "col"]).withColumn("p", F.transform("p", lambda x: x / 10000.0))
    done = fusion.segment_means(own, bands=N)
    return done.select("seg", F.posexplode("mean").alias("k", "m")).select("seg", "k", F.bround("m", 8).alias("mean"))


@part.add("hybrid_blend_top2", "px_levels px_segments", f"WITH {_FUSE} SELECT row, col, CAST(wi AS INT) AS wi, CAST(si AS INT) AS si, round_even(w, 6) AS w, round_even(s, 6) AS s FROM tt")
def _(levels: DataFrame, segs: DataFrame) -> DataFrame:
    own = _p(levels).join(segs, ["row", "col"]).withColumn("p", F.transform("p", lambda x: x / 10000.0))
    mixed = own.join(fusion.segment_means(own, bands=N), "seg", "left").withColumn("t", scalars.top_two(fusion.blend(F.col("p"), F.col("mean"), SMOOTHNESS[:N])))
    return mixed.select("row", "col", "t.wi", "t.si", F.bround("t.w", 6).alias("w"), F.bround("t.s", 6).alias("s"))


_OBJ = _MEANS + f""", ob AS (SELECT lv.row, lv.col, lv.k, v / 10000.0::DOUBLE AS r, coalesce(o, v / 10000.0::DOUBLE) AS o FROM lv JOIN px_segments s USING (row, col) LEFT JOIN sm ON sm.seg = s.seg AND sm.k = lv.k),
oc AS (SELECT row, col, 1 - 0.6::DOUBLE * greatest(0, least(1, max(CASE WHEN n = 2 THEN o END) / max(o))) AS d FROM (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY o DESC, k) AS n FROM ob) GROUP BY 1, 2),
mx AS (SELECT ob.row, ob.col, k, o * ({_W}[k + 1] * d) + r * (1 - {_W}[k + 1] * d) AS b FROM ob JOIN oc USING (row, col)),
nm AS (SELECT row, col, k, b / sum(b) OVER (PARTITION BY row, col) AS b FROM mx), rn AS (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY b DESC, k) AS n FROM nm),
t2 AS (SELECT row, col, max(CASE WHEN n = 1 THEN b END) AS w, max(CASE WHEN n = 1 THEN k END) + 1 AS wi, max(CASE WHEN n = 2 THEN b END) AS s, max(CASE WHEN n = 2 THEN k END) + 1 AS si FROM rn GROUP BY 1, 2)"""


@part.add("object_confusion_blend", "px_levels px_segments", f"WITH {_OBJ} SELECT row, col, CAST(wi AS INT) AS lulc, CAST(round_even(w * 100, 0) AS INT) AS conf, CAST(round_even(s / w * 100, 0) AS INT) AS ci, CAST(si AS INT) AS runner_up, CAST(s / w <= 0.65 AS INT) AS is_stable FROM t2")
def _(levels: DataFrame, segs: DataFrame) -> DataFrame:
    return fusion.fuse_by_object(_p(levels).join(segs, ["row", "col"]), bands=N)


_RULES = [fusion.MaskRule((1, 2, 3), 16, "corridor", 1, "settlement", 1), fusion.MaskRule((16, 7), 8, "settlement", 1)]
_R1 = "CASE WHEN {c} IN (1, 2, 3) AND corridor = 1 AND settlement <> 1 THEN 16 ELSE {c} END"
_R2 = "CASE WHEN {c} IN (16, 7) AND settlement = 1 THEN 8 ELSE {c} END"


@part.add("confusion_index_stability", "px_levels px_segments px_masks", f"WITH {_FUSE}, r1 AS (SELECT row, col, ci, settlement, {_R1.format(c='wi')} AS c FROM ci LEFT JOIN px_masks USING (row, col)) SELECT row, col, CAST({_R2.format(c='c')} AS INT) AS lulc, CAST(ci <= 0.65 AS INT) AS is_stable, round_even(ci * 0.9973::DOUBLE, 6) AS ci_scaled FROM r1")
def _(levels: DataFrame, segs: DataFrame, masks: DataFrame) -> DataFrame:
    own = _p(levels).join(segs, ["row", "col"]).join(masks, ["row", "col"], "left")
    # The factor keeps ratios of small whole numbers off the ties of rounding.
    return fusion.fuse(own, bands=N, rules=_RULES).select("row", "col", "lulc", "is_stable", F.bround(F.col("ci") * 0.9973, 6).alias("ci_scaled"))


# Each pixel's first and second class by probability, out of 18: e0 with 5000, e1 (if another) with 5 times z.
_TWO = """WITH q AS (SELECT row, col, e0 AS a, e1 AS b, e0 = e1 AS alone, z * 5 AS v FROM px_epochs JOIN px_dem USING (row, col) WHERE e0 > 0 AND e1 > 0),
t AS (SELECT row, col, CASE WHEN alone THEN a WHEN v > 5000 OR v = 5000 AND b < a THEN b ELSE a END AS w, CASE WHEN alone OR v = 0 THEN 0 WHEN v > 5000 OR v = 5000 AND b < a THEN a ELSE b END AS s, CASE WHEN alone THEN 0 ELSE least(v, 5000) / greatest(v, 5000)::DOUBLE END AS ci FROM q)
SELECT row, col, CASE WHEN c = 18 THEN 17 ELSE c END AS cls FROM (SELECT row, col, CASE WHEN w IN (17, 18) AND s IN (15, 16) AND ci > 0.65 THEN s ELSE w END AS c FROM t)"""


@part.add("false_hydrology_refine", "px_epochs px_dem", _TWO)
def _(px: DataFrame, dem: DataFrame) -> DataFrame:
    j = px.join(dem, ["row", "col"]).where("e0 > 0 AND e1 > 0")
    p = F.transform(F.sequence(F.lit(1), F.lit(18)), lambda k: F.when(k == F.col("e0"), F.lit(5000)).when(k == F.col("e1"), (F.col("z") * 5).cast("int")).otherwise(0))
    done = fusion.fuse(j.select("row", "col", p.alias("p"), F.lit(0).cast("long").alias("seg")), bands=18)
    return done.select("row", "col", F.col("lulc").alias("cls"))


_TOWN = "r1 AS (SELECT *, CASE WHEN e3 = 16 AND corridor = 1 AND settlement <> 1 THEN 17 ELSE e3 END AS c1 FROM px_epochs JOIN px_masks USING (row, col)), r2 AS (SELECT *, CASE WHEN c1 IN (17, 18) AND settlement = 1 AND corridor <> 1 THEN 16 ELSE c1 END AS c2 FROM r1)"


@part.add("mask_rule_refine", "px_epochs px_masks", f"WITH {_TOWN} SELECT row, col, c2 AS cls FROM r2")
def _(px: DataFrame, masks: DataFrame) -> DataFrame:
    rules = fusion.river_and_town_rules("corridor", "settlement")
    return px.join(masks, ["row", "col"]).select("row", "col", fusion.apply_rules(F.col("e3"), rules).alias("cls"))


@part.add("mask_rule_counts", "px_epochs px_masks", f"WITH {_TOWN}, n AS (SELECT count(*) AS n, count(*) FILTER (c1 <> e3) AS a, count(*) FILTER (c2 <> c1) AS b FROM r2) SELECT 1 AS rule, a AS n_changed, round_even(a / n::DOUBLE * 100, 4) AS pct FROM n UNION ALL SELECT 2, b, round_even(b / n::DOUBLE * 100, 4) FROM n")
def _(px: DataFrame, masks: DataFrame) -> DataFrame:
    return fusion.rule_counts(px.join(masks, ["row", "col"]), fusion.river_and_town_rules("corridor", "settlement"), "e3")


@part.add("argmax_classify", "px_levels", f"WITH {_LONG} SELECT row, col, CAST(arg_max(k, v * 100 - k) AS INT) AS cls FROM lv GROUP BY 1, 2")
def _(levels: DataFrame) -> DataFrame:
    return _p(levels).select("row", "col", scalars.argmax(F.col("p")).alias("cls"))


@part.add("logit_roundtrip", "px_levels", f"WITH {_LONG}, q AS (SELECT row, col, k, greatest(0.001::DOUBLE, least(0.999::DOUBLE, v / 10000.0::DOUBLE)) AS c FROM lv) SELECT row, col, CAST(k AS INT) AS k, round_even(ln(c) - ln(1 - c), 5) AS logit, round_even(c / sum(c) OVER (PARTITION BY row, col), 5) AS p FROM q")
def _(levels: DataFrame) -> DataFrame:
    lo = scalars.to_logits(F.transform("p", lambda x: x / 10000.0))
    t = _p(levels).select("row", "col", lo.alias("l")).select("row", "col", F.posexplode(F.arrays_zip("l", scalars.to_probs(F.col("l")).alias("p"))).alias("k", "x"))
    return t.select("row", "col", "k", F.bround("x.l", 5).alias("logit"), F.bround("x.p", 5).alias("p"))


def _mv(v: str, radius: int) -> str:
    near = f"abs(a.row - b.row) <= {radius} AND abs(a.col - b.col) <= {radius} AND a.k = b.k"
    return f"""x AS ({v}), th AS (SELECT a.row, a.col, a.k, a.v, quantile_cont(b.v, 0.5) AS t FROM x a JOIN x b ON {near} GROUP BY 1, 2, 3, 4), ch AS (SELECT row, col, k, v FROM th WHERE v >= t),
mv AS (SELECT a.row, a.col, a.k, a.v, coalesce(avg(b.v), a.v) AS m, CASE WHEN count(b.v) = 0 OR var_pop(b.v) <= 0 THEN 1 ELSE var_pop(b.v) END AS s FROM x a LEFT JOIN ch b ON {near} GROUP BY 1, 2, 3, 4)"""


@part.add("local_mean_variance", "px_bands", f"WITH {_mv('SELECT row, col, 0 AS k, nir / 997.0::DOUBLE AS v FROM px_bands', 3)} SELECT row, col, round_even(m, 5) AS mean, round_even(s, 6) AS var FROM mv")
def _(bands: DataFrame) -> DataFrame:
    done = focal.local_mean_variance(bands.withColumn("v", F.col("nir") / 997.0), "v", window=7)
    return done.select("row", "col", F.bround("mean", 5).alias("mean"), F.bround("var", 6).alias("var"))


_LOGIT = "SELECT row, col, k, ln(c) - ln(1 - c) AS v FROM (SELECT row, col, k, greatest(0.001::DOUBLE, least(0.999::DOUBLE, v / 10000.0::DOUBLE)) AS c FROM lv)"
_SM = "[" + ", ".join(f"{s}::DOUBLE" for s in SMOOTHNESS[:N]) + "]"


@part.add("bayesian_smooth", "px_levels", f"WITH {_LONG}, {_mv(_LOGIT, 1)}, po AS (SELECT row, col, k, 1 / (1 + exp(-(v * s / ({_SM}[k + 1] + s) + m * {_SM}[k + 1] / ({_SM}[k + 1] + s)))) AS e FROM mv) SELECT row, col, CAST(k AS INT) AS k, round_even(e / sum(e) OVER (PARTITION BY row, col), 5) AS p FROM po")
def _(levels: DataFrame) -> DataFrame:
    done = focal.bayesian_smooth(_p(levels), smoothness=SMOOTHNESS[:N], window=3, scale=10000.0)
    return done.select("row", "col", F.posexplode("p").alias("k", "x")).select("row", "col", "k", F.bround("x", 5).alias("p"))


_NEAR = "SELECT h.row, h.col, arg_min(v.e0, (v.row - h.row) * (v.row - h.row) * 1e6 + (v.col - h.col) * (v.col - h.col) * 1e6 + (v.row - h.row) * 100 + (v.col - h.col)) AS f FROM px_epochs h JOIN px_epochs v ON v.row BETWEEN h.row - 4 AND h.row + 4 AND v.col BETWEEN h.col - 4 AND h.col + 4 AND (v.row - h.row) * (v.row - h.row) + (v.col - h.col) * (v.col - h.col) <= 16 WHERE h.e0 = 0 AND v.e0 <> 0 GROUP BY 1, 2"


@part.add("heal_seams_nearest", "px_epochs", f"WITH f AS ({_NEAR}) SELECT row, col, CASE WHEN e0 = 0 THEN coalesce(f, 0) ELSE e0 END AS cls FROM px_epochs LEFT JOIN f USING (row, col)")
def _(px: DataFrame) -> DataFrame:
    return focal.heal_seams(px.select("row", "col", F.col("e0").alias("cls")))


def _spikes(source: str, line: str, along: str, name: str) -> str:
    cells = ", ".join(f"CASE WHEN lag({along}) OVER w = {along} - 1 THEN lag(p{k}) OVER w END AS a{k}, CASE WHEN lead({along}) OVER w = {along} + 1 THEN lead(p{k}) OVER w END AS b{k}" for k in range(N))
    up = lambda k, t: f"(p{k} - a{k} > {t} AND p{k} - b{k} > {t})"
    down = lambda k, t: f"(a{k} - p{k} > {t} AND b{k} - p{k} > {t})"
    hit = f"a0 IS NOT NULL AND b0 IS NOT NULL AND ({' OR '.join(up(k, 600) for k in range(N))} OR {' + '.join(f'CAST({up(k, 100)} OR {down(k, 100)} AS INT)' for k in range(N))} >= 3)"
    out = ", ".join(f"CASE WHEN {hit} THEN (a{k} + b{k}) / 2.0::DOUBLE ELSE p{k} END AS p{k}" for k in range(N))
    return f"{name}_n AS (SELECT *, {cells} FROM {source} WINDOW w AS (PARTITION BY {line} ORDER BY {along})), {name} AS (SELECT row, col, {out} FROM {name}_n)"


@part.add("heal_probability_spikes", "px_levels", f"WITH {_spikes('px_levels', 'row', 'col', 'h1')}, {_spikes('h1', 'col', 'row', 'h2')} SELECT row, col, {', '.join(f'CAST(round_even(p{k}, 0) AS BIGINT) AS p{k}' for k in range(N))} FROM h2")
def _(levels: DataFrame) -> DataFrame:
    done = focal.heal_spikes(_p(levels), bands=N)
    return done.select("row", "col", *[F.col("p")[k].alias(f"p{k}") for k in range(N)])


_TABLE = {1: 6, 2: 8, 3: 6, 4: 30, 5: 6, 6: 8, 7: 6, 8: 6, 9: 6, 10: 6}


@part.add("mmu_small_patches", "px_epochs")
def _(px: DataFrame) -> DataFrame:
    return components.small_patches(px.where("e0 > 0").withColumn("cls", F.col("e0")), _TABLE)


@part.add("mmu_fill", "px_epochs")
def _(px: DataFrame) -> DataFrame:
    return components.dissolve_small(px.select("row", "col", F.col("e0").alias("cls")), MMU)


# Patches of four neighbours: runs along rows, linked between rows, and the least label by recursion over the runs.
_CLAMP = """cl AS (SELECT row, col, CASE WHEN e0 % 3 = 0 THEN 2147483647 ELSE e1 END AS seg FROM px_epochs),
k AS (SELECT row, col, col - row_number() OVER (PARTITION BY row ORDER BY col) AS g FROM cl WHERE seg = 2147483647),
run AS (SELECT row, min(col) AS c0, max(col) AS c1, row * 2147483648 + min(col) AS id FROM k GROUP BY row, g),
nb AS (SELECT a.id AS a, b.id AS b FROM run a JOIN run b ON b.row IN (a.row - 1, a.row + 1) AND a.c0 <= b.c1 AND b.c0 <= a.c1),
reach AS (SELECT id AS a, id AS b FROM run UNION SELECT r.a, nb.b FROM reach r JOIN nb ON nb.a = r.b),
patch AS (SELECT a AS id, min(b) AS root FROM reach GROUP BY 1),
px AS (SELECT k.row, k.col, root FROM k JOIN run ON run.row = k.row AND k.col BETWEEN c0 AND c1 JOIN patch USING (id)),
sz AS (SELECT root, count(*) AS n FROM px GROUP BY 1)"""


@part.add("clamped_segments", "px_epochs", f"WITH RECURSIVE {_CLAMP} SELECT cl.row, cl.col, CASE WHEN root IS NULL THEN seg WHEN n > 40 THEN 0 ELSE -root - 2 END AS seg FROM cl LEFT JOIN px USING (row, col) LEFT JOIN sz USING (root)")
def _(px: DataFrame) -> DataFrame:
    return components.localise_clamped(px.select("row", "col", F.when(F.col("e0") % 3 == 0, 2147483647).otherwise(F.col("e1")).alias("seg")), most=40)


QUERIES, ORACLES = part.queries, part.oracles
