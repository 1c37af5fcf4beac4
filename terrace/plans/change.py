"""Queries on areas and change of classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.grid import LONLAT, UTM
from terrace.operators import areas, transitions
from terrace.plans.registry import Part
from terrace.schema import BACKWARD, CLASSES_18, FORWARD, IMPOSSIBLE

part = Part()
EPOCHS = ["e0", "e1", "e2", "e3"]
ALL = list(range(1, 19))
_NAMES = "CASE cls " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in CLASSES_18.items()) + " ELSE 'Class ' || cls END"


def _in(pairs: list[tuple[int, int]], a: str, b: str) -> str:
    return f"({a} * 256 + {b}) IN ({', '.join(str(x * 256 + y) for x, y in pairs)})"


def _area_sql(ha: str) -> str:
    return f"SELECT e3 AS cls, {_NAMES.replace('cls ', 'e3 ').replace('|| cls', '|| e3')} AS class_name, count(*) AS n_pixels, round_even(sum({ha}), 4) AS area_ha FROM px_epochs WHERE e3 <> 0 GROUP BY e3"


_LAT = "radians(-8.5 + (row + 0.5) * -0.0001)"
_D = f"(1 - 0.081819190842622 * 0.081819190842622 * sin({_LAT}) * sin({_LAT}))"
_HA = f"(6378137.0::DOUBLE * (1 - 0.081819190842622::DOUBLE * 0.081819190842622) / ({_D} * sqrt({_D})) * radians(0.0001) * 6378137.0 / sqrt({_D}) * cos({_LAT}) * radians(0.0001) / 1e4)"


@part.add("class_area", "px_epochs", _area_sql("0.01::DOUBLE"))
def _(px: DataFrame) -> DataFrame:
    return areas.class_area(px, UTM, CLASSES_18, "e3")


@part.add("class_area_geographic", "px_epochs", _area_sql(_HA))
def _(px: DataFrame) -> DataFrame:
    return areas.class_area(px, LONLAT, CLASSES_18, "e3")


@part.add("pixel_counts_remap", "px_epochs", "SELECT CASE e3 WHEN 18 THEN 17 WHEN 2 THEN 1 ELSE e3 END AS cls, count(*) AS n_pixels FROM px_epochs WHERE e3 NOT IN (0, -1, 255) GROUP BY 1")
def _(px: DataFrame) -> DataFrame:
    return areas.pixel_counts(px, {18: 17, 2: 1}, "e3")


@part.add("class_distribution", "points", "SELECT class_id, count(*) AS n FROM points GROUP BY 1")
def _(points: DataFrame) -> DataFrame:
    return areas.class_distribution(points, "class_id")


_MATRIX = "SELECT a.c AS from_cls, b.c AS to_cls, count(e0) AS n_pixels, round_even(count(e0) * 0.01, 4)::DOUBLE AS area_ha FROM (SELECT CAST(unnest(range(1, 19)) AS INT) AS c) a CROSS JOIN (SELECT CAST(unnest(range(1, 19)) AS INT) AS c) b LEFT JOIN px_epochs ON e0 = a.c AND e1 = b.c GROUP BY 1, 2"


@part.add("transition_matrix", "px_epochs", _MATRIX)
def _(px: DataFrame) -> DataFrame:
    return transitions.transition_matrix(px, "e0", "e1", ALL, UTM)


PAIRS = [("2005-2015", "e0", "e1"), ("2015-2020", "e1", "e2"), ("2020-2025", "e2", "e3"), ("2005-2025", "e0", "e3")]
_M = "m AS (" + " UNION ALL ".join(f"SELECT '{k}' AS interval, {a} AS from_cls, {b} AS to_cls, count(*) AS n_pixels, round_even(count(*) * 0.01, 4)::DOUBLE AS area_ha FROM px_epochs WHERE {a} > 0 AND {b} > 0 GROUP BY 1, 2, 3" for k, a, b in PAIRS) + ")"


def _matrices(px: DataFrame) -> DataFrame:
    return transitions.transition_counts(px, PAIRS, ALL, UTM)


@part.add("multi_interval_matrices", "px_epochs", f"WITH {_M} SELECT * FROM m")
def _(px: DataFrame) -> DataFrame:
    return _matrices(px)


@part.add("sankey_links", "px_epochs", f"WITH {_M} SELECT interval, from_cls AS source, to_cls AS target, area_ha FROM m WHERE area_ha >= 0.1")
def _(px: DataFrame) -> DataFrame:
    return transitions.sankey_links(_matrices(px), 0.1)


@part.add("sankey_top", "px_epochs", f"WITH {_M} SELECT interval, from_cls AS source, to_cls AS target, area_ha FROM m WHERE area_ha >= 0.05 QUALIFY row_number() OVER (PARTITION BY interval ORDER BY area_ha DESC, from_cls, to_cls) <= 5")
def _(px: DataFrame) -> DataFrame:
    return transitions.sankey_links(_matrices(px), 0.05, 5)


_S = _M + """, i AS (SELECT interval, from_cls AS cls, area_ha AS t1, 0 AS t2, CASE WHEN from_cls = to_cls THEN area_ha ELSE 0 END AS same FROM m
  UNION ALL SELECT interval, to_cls, 0, area_ha, 0 FROM m),
per AS (SELECT interval, cls, sum(t1)::DOUBLE AS t1, sum(t2)::DOUBLE AS t2, sum(same)::DOUBLE AS same FROM i GROUP BY ALL),
swap AS (SELECT a.interval, a.from_cls AS cls, 2 * sum(least(a.area_ha, b.area_ha)) AS ex FROM m a JOIN m b ON a.interval = b.interval AND a.from_cls = b.to_cls AND a.to_cls = b.from_cls WHERE a.from_cls <> a.to_cls GROUP BY ALL),
t AS (SELECT per.*, coalesce(ex, 0) AS ex, t1 - same AS loss, t2 - same AS gain, 2 * least(t1 - same, t2 - same) AS alloc, greatest(land, 1e-6) AS land FROM per LEFT JOIN swap USING (interval, cls) JOIN (SELECT interval, sum(area_ha) AS land FROM m GROUP BY 1) USING (interval)),
s AS (SELECT interval, cls, round_even(t1, 4) AS area_t1, round_even(t2, 4) AS area_t2, round_even(loss, 4) AS loss, round_even(gain, 4) AS gain, round_even(t2 - t1, 4) AS net, round_even(abs(gain - loss), 4) AS quantity,
  round_even(alloc, 4) AS allocation, round_even(ex, 4) AS exchange, round_even(greatest(0, alloc - ex), 4) AS shift, round_even(loss + gain, 4) AS total, round_even((loss + gain) / land * 100, 3) AS total_pct,
  CASE WHEN t1 > 0 AND t2 > 0 THEN round_even(ln(t2 / t1) / 10 * 100, 3) ELSE 0 END AS rate_pct FROM t)"""


@part.add("pontius_summary", "px_epochs", f"WITH {_S} SELECT * FROM s")
def _(px: DataFrame) -> DataFrame:
    return transitions.change_summary(_matrices(px), 10)


_HALF = ", ".join(f"round_even(sum({c}) / 2, 2) AS {c}" for c in ("quantity", "allocation", "exchange", "shift"))
_OVERALL = f"o AS (SELECT interval, sum(area_t1) AS land, round_even(sum(area_t1 - loss), 2) AS persistence, {_HALF} FROM s GROUP BY 1), w AS (SELECT *, round_even(quantity + allocation, 2) AS total FROM o)"


@part.add("pontius_overall", "px_epochs", f"WITH {_S}, {_OVERALL} SELECT interval, round_even(land, 2) AS landscape, persistence, quantity, allocation, exchange, shift, total, " + ", ".join(f"round_even({c} / land * 100, 3) AS {c}_pct" for c in ("quantity", "allocation", "total")) + " FROM w")
def _(px: DataFrame) -> DataFrame:
    return transitions.change_overall(transitions.change_summary(_matrices(px), 10))


@part.add("transition_consistency_t2", "px_epochs", f"SELECT row, col, CASE WHEN {_in(IMPOSSIBLE, 'e0', 'e1')} THEN e0 ELSE e1 END AS cls, {_in(IMPOSSIBLE, 'e0', 'e1')} AS changed FROM px_epochs")
def _(px: DataFrame) -> DataFrame:
    cls, hit = transitions.consistent(F.col("e0"), F.col("e1"), IMPOSSIBLE)
    return px.select("row", "col", cls.alias("cls"), hit.alias("changed"))


@part.add("transition_consistency_t1_replacement", "px_epochs", f"SELECT row, col, CASE WHEN e0 = 2 AND e1 = 1 THEN 14 WHEN {_in(IMPOSSIBLE, 'e0', 'e1')} THEN e1 ELSE e0 END AS cls, {_in(IMPOSSIBLE, 'e0', 'e1')} AS changed FROM px_epochs")
def _(px: DataFrame) -> DataFrame:
    cls, hit = transitions.consistent(F.col("e0"), F.col("e1"), IMPOSSIBLE, target="t1", replacement={(2, 1): 14})
    return px.select("row", "col", cls.alias("cls"), hit.alias("changed"))


@part.add("consistency_stable_mask", "px_epochs px_masks", f"SELECT row, col, CASE WHEN settlement = 0 AND {_in(IMPOSSIBLE, 'e0', 'e1')} THEN e0 ELSE e1 END AS cls FROM px_epochs JOIN px_masks USING (row, col)")
def _(px: DataFrame, masks: DataFrame) -> DataFrame:
    cls, _hit = transitions.consistent(F.col("e0"), F.col("e1"), IMPOSSIBLE, stable=F.col("settlement") == 0)
    return px.join(masks, ["row", "col"]).select("row", "col", cls.alias("cls"))


@part.add("two_date_consistency", "px_epochs", f"SELECT row, col, CASE WHEN {_in(BACKWARD, 'e0', 'e1')} THEN e1 ELSE e0 END AS t1, CASE WHEN {_in(FORWARD, 'e0', 'e1')} THEN e0 ELSE e1 END AS t2, CASE WHEN {_in(FORWARD, 'e0', 'e1')} THEN 2 WHEN {_in(BACKWARD, 'e0', 'e1')} THEN 1 ELSE 0 END AS qa FROM px_epochs")
def _(px: DataFrame) -> DataFrame:
    t1, t2, qa = transitions.two_date(F.col("e0"), F.col("e1"), BACKWARD, FORWARD)
    return px.select("row", "col", t1.alias("t1"), t2.alias("t2"), qa.alias("qa"))


def _cascade(anchor: str) -> str:
    if anchor == "last":
        steps = [(2, 3), (1, 2), (0, 1)]
        sql = "d3 AS (SELECT row, col, e0, e1, e2, e3 FROM px_epochs)"
        for own, other in steps:
            sql += f", d{own} AS (SELECT * REPLACE (CASE WHEN {_in(IMPOSSIBLE, f'e{own}', f'e{other}')} THEN e{other} ELSE e{own} END AS e{own}) FROM d{other})"
        return f"WITH {sql} SELECT row, col, e0, e1, e2, e3 FROM d0"
    sql = "d0 AS (SELECT row, col, e0, e1, e2, e3 FROM px_epochs)"
    for other, own in [(0, 1), (1, 2), (2, 3)]:
        sql += f", d{own} AS (SELECT * REPLACE (CASE WHEN {_in(IMPOSSIBLE, f'e{other}', f'e{own}')} THEN e{other} ELSE e{own} END AS e{own}) FROM d{other})"
    return f"WITH {sql} SELECT row, col, e0, e1, e2, e3 FROM d3"


@part.add("multi_epoch_cascade_last", "px_epochs", _cascade("last"))
def _(px: DataFrame) -> DataFrame:
    return px.select("row", "col", *transitions.consistent_series(EPOCHS, IMPOSSIBLE, anchor="last"))


@part.add("multi_epoch_cascade_first", "px_epochs", _cascade("first"))
def _(px: DataFrame) -> DataFrame:
    return px.select("row", "col", *transitions.consistent_series(EPOCHS, IMPOSSIBLE, anchor="first"))


def _both_ways() -> str:
    sql = "s0 AS (SELECT *, 0 AS e0_qa, 0 AS e1_qa, 0 AS e2_qa, 0 AS e3_qa, e0 > 0 AND e1 > 0 AND e2 > 0 AND e3 > 0 AS ok FROM px_epochs)"
    n = 0
    for own, other, rules, bit in [(2, 3, BACKWARD, 1), (1, 2, BACKWARD, 1), (0, 1, BACKWARD, 1), (1, 0, FORWARD, 2), (2, 1, FORWARD, 2), (3, 2, FORWARD, 2)]:
        a, b = (own, other) if bit == 1 else (other, own)
        hit = f"ok AND {_in(rules, f'e{a}', f'e{b}')}"
        sql += f", s{n + 1} AS (SELECT * REPLACE (CASE WHEN {hit} THEN e{other} ELSE e{own} END AS e{own}, CASE WHEN {hit} THEN e{own}_qa | {bit} ELSE e{own}_qa END AS e{own}_qa) FROM s{n})"
        n += 1
    return f"WITH {sql} SELECT * EXCLUDE ok FROM s{n}"


@part.add("bidirectional_cascade_qa", "px_epochs", _both_ways())
def _(px: DataFrame) -> DataFrame:
    return transitions.bidirectional(px, EPOCHS, BACKWARD, FORWARD)


def _traj() -> str:
    es, pairs = [f"e{k}" for k in range(4)], [("e0", "e1"), ("e1", "e2"), ("e2", "e3")]
    odd = " OR ".join(f"({a} <> 1 AND {b} = 1) OR ({a} = 16 AND {b} IN (1, 2, 3, 4, 11, 12, 13, 14))" for a, b in pairs)
    return (
        "CASE WHEN e0 = e1 AND e1 = e2 AND e2 = e3 THEN 1 "
        f"WHEN {odd} OR (e0 = e3 AND (e1 <> e0 OR e2 <> e0)) THEN 9 WHEN {' AND '.join(f'{e} IN (17, 18)' for e in es)} THEN 7 WHEN e0 <> 16 AND e3 = 16 THEN 6 "
        f"WHEN e0 NOT BETWEEN 5 AND 9 AND e3 BETWEEN 5 AND 9 THEN 5 WHEN {' AND '.join(f'{e} BETWEEN 10 AND 15' for e in es)} THEN 4 WHEN e0 BETWEEN 10 AND 15 AND e3 BETWEEN 1 AND 4 THEN 3 WHEN e0 BETWEEN 1 AND 4 AND (e3 BETWEEN 10 AND 15 OR e3 = 16) THEN 2 ELSE 8 END"
    )


@part.add("trajectory_classes", "px_epochs", f"SELECT row, col, {_traj()} AS trajectory FROM px_epochs WHERE e0 > 0 AND e1 > 0 AND e2 > 0 AND e3 > 0")
def _(px: DataFrame) -> DataFrame:
    maps = {2005 + 5 * k: px.where(f"{e} > 0").select("row", "col", F.col(e).alias("cls")) for k, e in enumerate(EPOCHS)}
    return transitions.align(maps).select("row", "col", transitions.trajectory_class(F.col("traj")).alias("trajectory"))


_LABELS = """(VALUES (1, 'Persistent / Stable Matrix'), (2, 'Unidirectional Forest Loss'), (3, 'Forest Regrowth / Succession'), (4, 'Rotational Swidden / Fallow Cycle'),
(5, 'Agroforestry / Plantation Adoption'), (6, 'Urban / Built-up Expansion'), (7, 'Water / Riverbed Dynamics'), (8, 'Other Multi-Directional Changes'), (9, 'Potential Spurious Noise (QA Flag)')) l(trajectory, label)"""


@part.add("trajectory_area", "px_epochs", f"""WITH c AS (SELECT {_traj()} AS trajectory, count(*) AS n FROM px_epochs WHERE e0 > 0 AND e1 > 0 AND e2 > 0 AND e3 > 0 GROUP BY 1),
t AS (SELECT l.trajectory, label, coalesce(n, 0) AS n_pixels, round_even(coalesce(n, 0) * 0.01, 2)::DOUBLE AS area_ha FROM {_LABELS} LEFT JOIN c ON c.trajectory = l.trajectory)
SELECT *, round_even(area_ha / (SELECT sum(area_ha) FROM t) * 100, 2) AS share_pct FROM t""")
def _(px: DataFrame) -> DataFrame:
    return transitions.trajectory_area(px, EPOCHS, UTM)


QUERIES, ORACLES = part.queries, part.oracles
