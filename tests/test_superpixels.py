"""Superpixels against plain code, whatever the tiles, and what they hold."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrace.operators import fusion
from terrace.operators.superpixels import STEPS, gathered, superpixels


def _image(height=26, width=23, seed=3):
    rng = np.random.default_rng(seed)
    r, c = np.mgrid[:height, :width]
    a = np.where((r - 12) ** 2 + (c - 10) ** 2 < 60, 0.8, 0.2) + rng.normal(size=r.shape) * 0.05
    b = np.where(c > 14, 0.7, 0.3) + rng.normal(size=r.shape) * 0.05
    a[3:6, 3:9] = np.nan
    return a, b


def _frame(spark, a, b):
    rows = [(i, j, float(a[i, j]), float(b[i, j])) for i in range(a.shape[0]) for j in range(a.shape[1])]
    return spark.createDataFrame(rows, "row int, col int, a double, b double").repartition(3)


def _steps(v):
    return int(np.round(v * STEPS))


def _plain(a, b, spacing, compactness, rounds):
    px = {(i, j): (_steps(a[i, j]), _steps(b[i, j])) for i in range(a.shape[0]) for j in range(a.shape[1]) if np.isfinite(a[i, j]) and np.isfinite(b[i, j])}

    def means(of):
        sums = defaultdict(lambda: [0, 0, 0, 0, 0])
        for (i, j), s in of.items():
            for k, v in enumerate((1, i, j, *px[i, j])):
                sums[s][k] += v
        return {s: tuple(v / n for v in rest) for s, (n, *rest) in sums.items()}

    def nearest(seeds):
        out = {}
        for (i, j), x in px.items():
            near = [(u, v) for u in range(i // spacing - 1, i // spacing + 2) for v in range(j // spacing - 1, j // spacing + 2) if (u, v) in seeds]
            away = lambda s: (sum((p - q) * (p - q) for p, q in zip(x, seeds[s][2:])) / float(STEPS) ** 2 + (compactness / spacing) ** 2 * ((i - seeds[s][0]) ** 2 + (j - seeds[s][1]) ** 2), s)
            out[i, j] = min(map(away, near))[1]
        return out

    seeds = means({p: (p[0] // spacing, p[1] // spacing) for p in px})
    for _ in range(rounds):
        of = nearest(seeds)
        moved = means(of)
        same = all(moved[s] == seeds[s] for s in moved)
        seeds = moved
        if same:
            break
    return of


def _patches(of):
    left, out = set(of), []
    while left:
        todo, own = [min(left)], set()
        while todo:
            p = todo.pop()
            if p in left and of[p] == of.get(next(iter(own), p)):
                left.discard(p)
                own.add(p)
                todo += [q for q in ((p[0] + 1, p[1]), (p[0] - 1, p[1]), (p[0], p[1] + 1), (p[0], p[1] - 1)) if q in left and of[q] == of[p]]
        out.append(own)
    return out


def _plain_segments(of, least):
    parts = sorted(_patches(of), key=min)
    at = {p: k for k, part in enumerate(parts) for p in part}
    by = defaultdict(list)
    for k, part in enumerate(parts):
        by[of[min(part)]].append(k)
    stays = {ks[0] for ks in (sorted(v, key=lambda k: (-len(parts[k]), min(parts[k]))) for v in by.values()) if len(parts[ks[0]]) >= least}
    to = {}
    for k, part in enumerate(parts):
        if k not in stays:
            border = Counter(at[q] for p in part for q in ((p[0] + 1, p[1]), (p[0] - 1, p[1]), (p[0], p[1] + 1), (p[0], p[1] - 1)) if q in at and at[q] != k)
            if border:
                to[k] = max(border, key=lambda o: (o in stays, border[o], [-v for v in min(parts[o])]))
    root = list(range(len(parts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in to.items():
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {p: find(k) for p, k in at.items()}


@pytest.mark.parametrize("spacing, compactness, tile", [(5, 0.1, 512), (5, 0.1, 7), (4, 0.02, 9)])
def test_segments_equal_plain_code(spark, spacing, compactness, tile):
    a, b = _image()
    df = _frame(spark, a, b)
    of = _plain(a, b, spacing, compactness, 6)
    assert {(r.row, r.col): (r.sr, r.sc) for r in gathered(df, ["a", "b"], spacing=spacing, compactness=compactness, rounds=6).collect()} == of
    want = _plain_segments(of, max(1, spacing * spacing // 4))
    got = {(r.row, r.col): r.seg for r in superpixels(df, ["a", "b"], spacing=spacing, compactness=compactness, rounds=6, tile=tile).collect()}
    assert set(got) == set(want)
    groups = lambda m: {frozenset(p for p in m if m[p] == s) for s in set(m.values())}
    assert groups(got) == groups(want)
    assert all(len(_patches({p: 1 for p in g})) == 1 for g in groups(got))


def test_segments_feed_segment_means(spark):
    a, b = _image()
    df = _frame(spark, a, b)
    segs = superpixels(df, ["a", "b"], spacing=5)
    px = df.where("NOT isnan(a)").join(segs, ["row", "col"]).select("row", "col", (F.col("seg") + 1).alias("seg"), F.array("a", "b").alias("p"))
    means = {r.seg: list(r.mean) for r in fusion.segment_means(px, bands=2).collect()}
    assert px.count() == 26 * 23 - 18 and set(means) == {r.seg + 1 for r in segs.collect()}
    flat = sum(v[0] > 0.7 or v[0] < 0.3 for v in means.values())
    assert flat >= 0.8 * len(means)  # segments keep to one side of the edge
    assert superpixels(df.limit(0), ["a"]).count() == 0
    lone = spark.createDataFrame([(0, 0, 0.5), (50, 50, 0.1), (None, 1, 0.2), (3, 3, None)], "row int, col int, a double")
    assert superpixels(lone, ["a"], least=3).select("seg").distinct().count() == 2  # nothing beside them to join
    for bad in (dict(spacing=0), dict(compactness=-1.0), dict(rounds=0)):
        with pytest.raises(ValueError):
            superpixels(df, ["a"], **bad)
