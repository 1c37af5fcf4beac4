"""Robust moments against plain code, and planted contamination."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrace.operators import outliers, robust


def _classes(seed=2):
    rng, rows, planted = np.random.default_rng(seed), [], {}
    for c, n in ((1, 300), (2, 90), (3, 12)):
        a = rng.normal(size=(3, 3))
        x = rng.normal(size=(n, 3)) @ a + 10 * c
        bad = np.zeros(n, bool)
        if c == 1:
            bad[: n // 5] = True
            x[bad] = x[~bad].mean(axis=0) + 9 * a[0] + rng.normal(size=(n // 5, 3)) * 0.1  # a tight heap that pulls the plain moments
        rows += [(1000 * c + k, c, *map(float, v)) for k, v in enumerate(x)]
        planted |= {1000 * c + k: bool(b) for k, b in enumerate(bad)}
    return rows, planted


def _plain(x, seed=42):
    """Concentration steps over all points by numpy, from the same starts."""
    n, d = x.shape
    h = math.ceil((n + d + 1) / 2)
    mean, cov = robust.start(x, seed)
    best = (np.linalg.slogdet(cov)[1], mean, cov)
    while True:
        away = np.einsum("nd,de,ne->n", x - mean, np.linalg.inv(cov), x - mean)
        near = np.argsort(away)[:h]
        mean, cov = x[near].mean(axis=0), np.cov(x[near].T, bias=True)
        now = np.linalg.slogdet(cov)[1]
        if best[0] - now < 1e-9:
            break
        best = (now, mean, cov)
    _, mean, cov = best
    away = np.einsum("nd,de,ne->n", x - mean, np.linalg.inv(cov), x - mean)
    cov = cov * np.median(away) / 2.365974
    keep = np.einsum("nd,de,ne->n", x - mean, np.linalg.inv(cov), x - mean) < 9.348404
    return x[keep].mean(axis=0), np.cov(x[keep].T, bias=True)


def test_moments_equal_plain_steps(spark):
    rows, _ = _classes()
    df = spark.createDataFrame([(r[1], list(r[2:])) for r in rows if r[1] < 3] + [(None, [1.0, 2.0, 3.0])], "cls int, x array<double>")
    # The sample is what starts take: here all points, in the order of plain code.
    held = {c: np.array([r[2:] for r in rows if r[1] == c]) for c in (1, 2)}
    samples = spark.createDataFrame([(c, x.tolist()) for c, x in held.items()], "cls int, sample array<array<double>>")
    got = robust.robust_moments(df, samples, "cls", 3)
    assert set(got) == {1, 2}
    for c, (mean, cov) in got.items():
        want = _plain(held[c])
        assert mean == pytest.approx(want[0], rel=1e-6) and cov == pytest.approx(want[1], rel=1e-5, abs=1e-8)


def test_planted_heap_is_found(spark):
    rows, planted = _classes()
    df = spark.createDataFrame(rows, "point_id long, class_id int, a double, b double, c double").repartition(3)
    flagged = {m: {r.point_id for r in outliers.outliers(df, ["a", "b", "c"], method=m, contamination=0.2).where("outlier AND class_id = 1").collect()} for m in ("elliptic", "elliptic_envelope")}
    bad = {k for k, b in planted.items() if b}
    assert flagged["elliptic_envelope"] == bad and len(flagged["elliptic"] & bad) < 0.5 * len(bad)
    done = outliers.outliers(df, ["a", "b", "c"], method="elliptic_envelope", contamination=0.1)
    assert done.count() == len(rows) and done.where("score IS NULL").count() == 0  # the class of 12 goes by trees
    # Scores don't depend on the features' units.
    other = outliers.outliers(df.withColumn("a", F.col("a") * 1000 + 5), ["a", "b", "c"], method="elliptic_envelope", contamination=0.1)
    both = done.where("class_id < 3").select("point_id", "score").join(other.select("point_id", F.col("score").alias("again")), "point_id")
    assert both.where("abs(score - again) > 1e-6 * (1 + score)").count() == 0


def test_flat_and_bad_classes(spark):
    flat = spark.createDataFrame([(k, 1, float(k % 7), 5.0) for k in range(60)], "point_id long, class_id int, a double, b double")
    assert outliers.outliers(flat, ["a", "b"], method="elliptic_envelope").count() == 60
    for bad in (dict(method="luck"), dict(contamination=0.0), dict(contamination=0.6)):
        with pytest.raises(ValueError):
            outliers.outliers(flat, ["a", "b"], **bad)
    with pytest.raises(ValueError):
        outliers.outliers(flat, [])
