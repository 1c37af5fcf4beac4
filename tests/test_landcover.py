"""Hand-computed cases and invariants of the land-cover operators."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrace.functions import scalars
from terrace.grid import LONLAT, UTM, GridSpec
from terrace.operators import accuracy, areas, components, focal, fusion, learning, outliers, raster, sampling, transitions
from terrace.schema import BACKWARD, MMU


def grid_df(spark, a, name="cls", skip=None):
    rows = [(r, c, x) for r, line in enumerate(a) for c, x in enumerate(line) if x != skip]
    return spark.createDataFrame(rows, f"row int, col int, {name} {'double' if isinstance(rows[0][2], float) else 'int'}")


def to_grid(df, name="cls"):
    rows = df.collect()
    out = [[None] * (max(r.col for r in rows) + 1) for _ in range(max(r.row for r in rows) + 1)]
    for r in rows:
        out[r.row][r.col] = r[name]
    return out


def test_class_area(spark):
    got = {r.cls: (r.n_pixels, r.area_ha) for r in areas.class_area(grid_df(spark, [[1, 1, 2], [2, 0, 3], [1, 3, 3]]), UTM).collect()}
    assert got == {1: (3, 0.03), 2: (2, 0.02), 3: (3, 0.03)}


def test_class_area_rejects_non_classes(spark):
    with pytest.raises(Exception, match="not a class"):
        areas.class_area(spark.createDataFrame([(0, 0, 1.5)], "row int, col int, cls double"), UTM).collect()


def test_geographic_area_is_near_a_square(spark):
    ha = spark.range(1).select(LONLAT.pixel_area_ha(F.lit(0)).alias("a")).first().a
    assert abs(ha * 1e4 - LONLAT.mean_pixel_area_m2()) < 1


def test_alignment():
    UTM.assert_aligned(UTM)
    with pytest.raises(ValueError):
        UTM.assert_aligned(LONLAT)


def test_ten_samples(spark):
    t, p = "1111222333", "1112221332"
    m = accuracy.confusion(spark.createDataFrame([(int(a), int(b)) for a, b in zip(t, p)], "ref_class int, map_class int"))
    assert accuracy.overall_accuracy(m).first().oa == 0.7
    one = accuracy.class_accuracy(m).where("cls = 1").first()
    assert (one.ua, one.pa) == (0.75, 0.75)


def test_empty_samples(spark):
    m = accuracy.confusion(spark.createDataFrame([], "ref_class int, map_class int"))
    assert accuracy.class_accuracy(m).count() == 0


def test_logits_and_back(spark):
    r = spark.range(1).select(scalars.to_probs(scalars.to_logits(F.array(F.lit(0.0), F.lit(1.0)))).alias("p")).first().p
    assert abs(sum(r) - 1) < 1e-12 and 0 < r[0] < r[1] < 1


def test_argmax_without_finite_values(spark):
    r = spark.range(1).select(scalars.argmax(F.array(F.lit(float("nan")), F.lit(None))).alias("a"), scalars.argmax(F.array(F.lit(4.0), F.lit(9.0)), [4, 9]).alias("b")).first()
    assert (r.a, r.b) == (-1, 9)


def test_top_two_ties_and_zeros(spark):
    t = lambda *x: scalars.top_two(F.array(*map(F.lit, x)))
    r = spark.range(1).select(t(2.0, 3.0, 3.0).alias("a"), t(0.0, 0.0).alias("b")).first()
    assert (r.a.wi, r.a.si, r.b.wi) == (2, 3, 0)


@pytest.mark.parametrize("size", [0, 2, -3])
def test_bad_windows(size):
    with pytest.raises(ValueError):
        focal.check_window(size)


def test_constant_probabilities_stay(spark):
    px = spark.createDataFrame([(r, c, [0.7, 0.3]) for r in range(4) for c in range(5)], "row int, col int, p array<double>")
    for r in focal.bayesian_smooth(px, smoothness=[1.0, 1.0], window=3).collect():
        assert np.allclose(r.p, [0.7, 0.3])


def test_smoothing_moves_the_centre_and_sums_to_one(spark):
    px = spark.createDataFrame([(r, c, [0.95, 0.05] if (r, c) == (2, 2) else [0.5, 0.5]) for r in range(5) for c in range(5)], "row int, col int, p array<double>")
    got = {(r.row, r.col): r.p for r in focal.bayesian_smooth(px, smoothness=[2.0, 0.5], window=3).collect()}
    assert abs(got[2, 2][0] - 0.95) > 1e-3 and all(abs(sum(p) - 1) < 1e-9 for p in got.values())


def test_nothing_finite(spark):
    px = spark.createDataFrame([(r, c, float("nan")) for r in range(2) for c in range(2)], "row int, col int, v double")
    assert [(r["mean"], r["var"]) for r in focal.local_mean_variance(px, window=3).collect()] == [(None, 1.0)] * 4


def test_mmu_fill_and_mask(spark):
    a = [[1] * 5 for _ in range(5)]
    a[2][2], a[0][0] = 2, 255
    out = to_grid(components.dissolve_small(grid_df(spark, a), {1: 0, 2: 2}, iterations=1, nodata=255))
    assert out[2][2] == 1 and out[0][0] == 255


def test_mmu_keeps_diagonal_pair(spark):
    a = [[1] * 5 for _ in range(5)]
    a[1][1] = a[2][2] = 2
    assert to_grid(components.dissolve_small(grid_df(spark, a), {1: 0, 2: 2}, iterations=1)) == a


def _mmu(a, table, iterations):
    """Plain: patches by flood, then steps of the window's mode."""
    h, w = len(a), len(a[0])
    near = lambda r, c: [(r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if 0 <= r + i < h and 0 <= c + j < w]
    small, seen = set(), set()
    for r in range(h):
        for c in range(w):
            if a[r][c] and (r, c) not in seen:
                patch, stack = {(r, c)}, [(r, c)]
                while stack:
                    for q in near(*stack.pop()):
                        if q not in patch and a[q[0]][q[1]] == a[r][c]:
                            patch.add(q)
                            stack.append(q)
                seen |= patch
                if len(patch) < table.get(a[r][c], 0):
                    small |= patch
    cur = {(r, c): a[r][c] for r in range(h) for c in range(w) if a[r][c] and (r, c) not in small}
    for _ in range(iterations):
        if not small - cur.keys():
            break
        new = {}
        for p in [*cur, *(small - cur.keys())]:
            votes = {}
            for q in near(*p):
                if q in cur:
                    votes[cur[q]] = votes.get(cur[q], 0) + 1
            if votes:
                new[p] = min(votes, key=lambda k: (-votes[k], k))
        cur = new
    return [[cur.get((r, c), a[r][c]) if (r, c) in small else a[r][c] for c in range(w)] for r in range(h)]


@pytest.mark.parametrize("tile", [4, 64])
def test_mmu_equals_plain_code(spark, tile):
    rng = random.Random(4)
    a = [[rng.choice([0, 1, 1, 1, 2, 2, 3]) for _ in range(14)] for _ in range(13)]
    table = {1: 3, 2: 6, 3: 4}
    assert to_grid(components.dissolve_small(grid_df(spark, a), table, iterations=3, tile=tile)) == _mmu(a, table, 3)


def test_patches_do_not_depend_on_tiles(spark):
    rng = random.Random(5)
    df = grid_df(spark, [[rng.choice([1, 2]) for _ in range(20)] for _ in range(20)])
    sizes = lambda t: sorted((r.row, r.col, r.size) for r in components.patches(df, tile=t).collect())
    assert sizes(3) == sizes(100)


def test_seams(spark):
    a = [[1, 1, 0, 2, 2] for _ in range(5)]
    out = to_grid(focal.heal_seams(grid_df(spark, a), width=2))
    assert all(x in (1, 2) for line in out for x in line) and out[0][2] == 1


def test_spike_is_damped(spark):
    p = [[[3300, 3300, 3300] for _ in range(5)] for _ in range(5)]
    p[2][2] = [9900, 50, 50]
    df = spark.createDataFrame([(r, c, p[r][c]) for r in range(5) for c in range(5)], "row int, col int, p array<int>")
    assert {(r.row, r.col): r.p for r in focal.heal_spikes(df, bands=3).collect()}[2, 2] == [3300, 3300, 3300]


def test_trajectories(spark):
    rows = spark.createDataFrame([([1, 1, 16, 1],), ([1, 1, 1, 1],), ([1, 14, 14, 14],)], "t array<int>")
    assert [r[0] for r in rows.select(transitions.trajectory_class(F.col("t"))).collect()] == [9, 1, 2]


def test_trajectory_priority_equals_sequential_rules(spark):
    rng = random.Random(6)
    seqs = [[rng.choice([1, 2, 5, 9, 10, 15, 16, 17, 18]) for _ in range(rng.choice([2, 3, 4]))] for _ in range(400)]

    def plain(t):
        k = 8
        if t[0] in (1, 2, 3, 4) and (10 <= t[-1] <= 15 or t[-1] == 16):
            k = 2
        if 10 <= t[0] <= 15 and t[-1] in (1, 2, 3, 4):
            k = 3
        if all(10 <= x <= 15 for x in t):
            k = 4
        if not 5 <= t[0] <= 9 and 5 <= t[-1] <= 9:
            k = 5
        if t[0] != 16 and t[-1] == 16:
            k = 6
        if all(x in (17, 18) for x in t):
            k = 7
        steps = list(zip(t, t[1:]))
        if any(a != 1 and b == 1 or a == 16 and b in (1, 2, 3, 4, 11, 12, 13, 14) for a, b in steps) or len(t) >= 3 and t[0] == t[-1] and any(x != t[0] for x in t[1:-1]):
            k = 9
        return 1 if len(set(t)) == 1 else k

    df = spark.createDataFrame([(s,) for s in seqs], "t array<int>")
    assert [r[0] for r in df.select(transitions.trajectory_class(F.col("t"))).collect()] == [plain(s) for s in seqs]


def test_two_by_two_transitions(spark):
    px = spark.createDataFrame([(0, 0, 1, 1), (0, 1, 1, 2), (1, 0, 2, 2), (1, 1, 2, 1)], "row int, col int, a int, b int")
    assert [r.n_pixels for r in transitions.transition_matrix(px, "a", "b", [1, 2], UTM).collect()] == [1, 1, 1, 1]


def test_forbidden_transition(spark):
    px = spark.createDataFrame([(2, 1)], "a int, b int")
    cls, hit = transitions.consistent(F.col("a"), F.col("b"), [(2, 1)])
    assert px.select(cls, hit).first()[:] == (2, True)
    with pytest.raises(ValueError):
        transitions.consistent(F.col("a"), F.col("b"), [(2, 300)])


def test_change_is_quantity_plus_allocation(spark):
    rows = [("x", random.Random(k).randint(1, 4), random.Random(k + 99).randint(1, 4), float(k)) for k in range(1, 30)]
    m = spark.createDataFrame(rows, "interval string, from_cls int, to_cls int, area_ha double").groupBy("interval", "from_cls", "to_cls").agg(F.sum("area_ha").alias("area_ha"))
    for r in transitions.change_summary(m, 10).collect():
        assert abs(r.total - r.quantity - r.allocation) < 1e-3


def test_backward_rules():
    assert len(BACKWARD) == 85


def test_mask_rule_and_counts(spark):
    px = grid_df(spark, [[1] * 4 for _ in range(4)]).withColumn("m", (F.col("row") == 0).cast("int"))
    rules = [fusion.MaskRule((1,), 9, "m")]
    assert to_grid(px.select("row", "col", fusion.apply_rules(F.col("cls"), rules).alias("cls")))[0] == [9] * 4
    assert fusion.rule_counts(px, rules).first()[:] == (1, 4, 25.0)
    with pytest.raises(ValueError):
        fusion.rule_counts(px, [])


def test_uniform_probabilities_fuse_to_one_class(spark):
    px = spark.createDataFrame([(r, c, [8000, 2000], 1) for r in range(8) for c in range(8)], "row int, col int, p array<int>, seg long")
    assert {(r.lulc, r.is_stable) for r in fusion.fuse(px, bands=2).collect()} == {(1, 1)}


def test_background_is_zero(spark):
    px = spark.createDataFrame([(0, 0, [0, 0], 0)], "row int, col int, p array<int>, seg long")
    assert fusion.fuse(px, bands=2).first()[2:] == (0, 0, 0.0)


def test_distances(spark):
    px = grid_df(spark, [[1 if (r, c) == (0, 0) else 0 for c in range(3)] for r in range(3)])
    d = to_grid(focal.distance_to(px, F.col("cls") == 1), "distance")
    assert np.allclose(d, [[0, 10, 20], [10, math.sqrt(200), math.sqrt(500)], [20, math.sqrt(500), math.sqrt(800)]])


def test_feature_stack(spark):
    px = spark.createDataFrame([(r, c, 1.0, 2.0, 3.0, 5.0, 4.0) for r in range(2) for c in range(2)], "row int, col int, B02 double, B03 double, B04 double, B08 double, B11 double")
    dem = spark.createDataFrame([(r, c, 2 * r + c) for r in range(2) for c in range(2)], "row int, col int, z int")
    out = raster.feature_stack(px, ["NDVI", "NDBI"], dem)
    assert out.columns == ["row", "col", "B02", "B03", "B04", "B08", "B11", "ndvi", "ndbi", "slope", "aspect"]
    assert out.first().ndvi == 0.25


def test_mosaic_of_two_tiles(spark):
    a, b = grid_df(spark, [[0, 1], [0, 0]]), grid_df(spark, [[1, 0], [0, 0]]).withColumn("col", F.col("col") + 2)
    assert to_grid(raster.mosaic([a, b])) == [[0, 1, 1, 0], [0, 0, 0, 0]]


def test_flags(spark):
    pts = spark.createDataFrame([("p1", 1), ("p2", 1), ("p3", 2)], "point_id string, class_id int")
    flags = spark.createDataFrame([("p1", False, 0.1), ("p2", True, 0.9)], "point_id string, outlier boolean, score double")
    assert sorted(r.point_id for r in sampling.remove_flagged(pts, flags).collect()) == ["p1", "p3"]
    assert {r.point_id: (r.outlier, r.score) for r in sampling.join_flags(pts, flags).collect()} == {"p1": (False, 0.1), "p2": (True, 0.9), "p3": (False, None)}
    with pytest.raises(Exception, match="twice"):
        sampling.join_flags(pts, flags.union(flags)).collect()


def test_point_pixels(spark):
    g = GridSpec(2, 2, 1.0, 0.0, 0.0, 0.0, -1.0, 2.0, 4326)
    px = spark.createDataFrame([(0, 0, 1.0, 10.0), (0, 1, 2.0, 20.0), (1, 0, 3.0, 30.0), (1, 1, 4.0, 40.0)], "row int, col int, B2 double, NDVI double")
    pts = spark.createDataFrame([("a", 1, 0.5, 1.5), ("b", 2, 1.5, 0.5), ("c", None, 0.5, 0.5), ("d", 1, 9.0, 9.0)], "point_id string, class_id int, x double, y double")
    assert sorted((r.B2, r.NDVI) for r in sampling.point_pixels(pts, px, g, bands=["B2", "NDVI"]).collect()) == [(1.0, 10.0), (4.0, 40.0)]


def test_outlier_stands_out(spark):
    rng = np.random.default_rng(1)
    rows = [(k, 1, float(a), float(b)) for k, (a, b) in enumerate(rng.normal(size=(80, 2)))] + [(99, 1, 30.0, -30.0), (100, 2, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "point_id long, class_id int, a double, b double")
    for method in ("isolation_forest", "elliptic"):
        got = {r.point_id: r for r in outliers.outliers(df, ["a", "b"], method=method).collect()}
        assert got[99].outlier and got[99].score == max(r.score for r in got.values() if r.score is not None)
        assert not got[100].outlier and got[100].score is None


def test_python_model_on_pixels(spark):
    px = spark.createDataFrame([(0, 0, 10.0, 5.0), (0, 1, 2.0, 8.0), (1, 0, 5.0, 5.0), (1, 1, 1.0, None)], "row int, col int, b1 double, b2 double")
    model = lambda t: [1 if a > b else 2 for a, b in zip(t["b1"], t["b2"])]
    assert to_grid(learning.classify_pixels(px, ["b1", "b2"], model)) == [[1, 2], [2, 0]]
    proba = lambda t: [[0.8, 0.2] if a > b else [0.2, 0.8] for a, b in zip(t["b1"], t["b2"])]
    assert to_grid(learning.classify_pixels(px, ["b1", "b2"], proba, mode="proba"), "p")[0] == [[8000, 2000], [2000, 8000]]


def test_manifest():
    learning.check_manifest({"feature_names": ["a"]}, 1, ["a"])
    with pytest.raises(ValueError):
        learning.check_manifest({"feature_names": ["a"]}, 2, ["a"])


def test_default_table_has_no_class_18():
    assert 18 not in MMU and len(MMU) == 17
