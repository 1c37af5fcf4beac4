"""Change detection against a plain loop, least squares and planted breaks."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrace.operators import segmentation, timeseries
from terrace.operators.segmentation import Detection, chi_square_quantile, detect_changes


def _wave(t, level, slope, a, b):
    return level + slope * (t - 2015) + a * math.cos(2 * math.pi * t) + b * math.sin(4 * math.pi * t)


def _rows(seed=3):
    """Pixels with planted breaks (or none), their observations, and when they change."""
    rnd, rows, breaks = random.Random(seed), [], {}
    for p in range(12):
        ts = sorted(2015 + rnd.random() * 8 for _ in range(170))
        at = [] if p % 3 == 0 else [2019.2 + p / 20] if p % 3 == 1 else [2018.1, 2020.6]
        breaks[p] = at
        for t in ts:
            k = sum(t >= x for x in at)
            y = [_wave(t, 0.2 + 0.3 * k, 0.01, 0.05 + 0.05 * k, 0.02) + rnd.gauss(0, 0.01), _wave(t, 0.5 - 0.1 * k, -0.01, 0.03, 0.01) + rnd.gauss(0, 0.01)]
            if t > 2017 and rnd.random() < 0.03:
                y[0] += 0.8  # a cloud
            rows.append((p, t, *y))
    return rows, breaks


def _plain(ts, ys, how):
    """One pixel by lists of rows and numpy's least squares."""
    design = lambda t, k: np.array([1, t, *[f(2 * math.pi * h * t) for h in range(1, k + 1) for f in (math.cos, math.sin)]])
    limit = chi_square_quantile(how.probability, len(ys[0]))

    def fit(rows):
        h = min(how.harmonics, len(rows) // 6 - 1)
        x, y = np.array([design(t, h) for t, _ in rows]), np.array([v for _, v in rows])
        c = np.linalg.lstsq(x, y, rcond=None)[0]
        return h, c, np.maximum(np.sqrt(((y - x @ c) ** 2).sum(axis=0) / max(len(rows) - 2 - 2 * h, 1)), how.least_rmse)

    out, rows, waiting, model, size = [], [], [], None, 0
    for t, y in zip(ts, ys):
        if model is not None and ((((np.array(y) - design(t, model[0]) @ model[1]) / model[2]) ** 2).sum() > limit):
            waiting.append((t, y))
            if len(waiting) == how.consecutive:
                out.append((rows[0][0], rows[-1][0], waiting[0][0], len(rows), fit(rows)))
                rows, waiting, model, size = waiting, [], None, 0
        else:
            waiting = []
            rows = rows + [(t, y)]
        if len(rows) >= how.least and rows[-1][0] - rows[0][0] >= how.least_years and len(rows) >= how.refit * size and len(rows) > size:
            model, size = fit(rows), len(rows)
    if model is not None:
        out.append((rows[0][0], rows[-1][0], None, len(rows), fit(rows)))
    return out


@pytest.mark.parametrize("cells", [64, 1 << 20])
def test_segments_equal_plain_loop(spark, monkeypatch, cells):
    rows, breaks = _rows()
    how = Detection(probability=0.999)
    df = spark.createDataFrame(rows + [(99, None, 1.0, 1.0), (None, 2015.5, 1.0, 1.0), (0, 2016.0, float("nan"), 1.0), (77, 2016.0, 1.0, 1.0)], "pixel long, t double, red double, nir double").repartition(5)
    # One task for all, in pieces of a few rows or at once.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        if cells == 64:
            source = segmentation.detect_changes.__globals__
            monkeypatch.setitem(source, "CELLS", 64)
        got = detect_changes(df, ["red", "nir"], how).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    by = {}
    for r in sorted(got, key=lambda r: (r.pixel, r.tStart)):
        by.setdefault(r.pixel, []).append(r)
    assert set(by) == set(range(12))
    for p, segs in by.items():
        own = sorted(r[1:] for r in rows if r[0] == p)
        want = _plain([r[0] for r in own], [r[1:] for r in own], how)
        assert [(s.tStart, s.tEnd, s.tBreak, s.n) for s in segs] == [w[:4] for w in want]
        for s, (*_, (h, c, rmse)) in zip(segs, want):
            for b, (coefs, err) in enumerate(((s.coefs_red, s.rmse_red), (s.coefs_nir, s.rmse_nir))):
                at = np.linspace(s.tStart, s.tEnd, 9)
                value = lambda k, c, t: sum(x * y for x, y in zip(c, [1, t, *[f(2 * math.pi * j * t) for j in range(1, k + 1) for f in (math.cos, math.sin)]]))
                assert [value(3, coefs, t) for t in at] == pytest.approx([value(h, c[:, b], t) for t in at], abs=1e-6)
                assert err == pytest.approx(rmse[b], abs=1e-6)
        found = [s.tBreak for s in segs if s.tBreak is not None]
        times = [r[0] for r in own]
        assert len(found) == len(breaks[p])
        for f, true in zip(found, breaks[p]):
            assert abs(times.index(f) - next(i for i, t in enumerate(times) if t >= true)) <= 1


def test_segments_feed_what_reads_them(spark):
    rows, breaks = _rows(5)
    df = spark.createDataFrame(rows, "pixel long, t double, red double, nir double")
    segs = detect_changes(df, ["red", "nir"], Detection(probability=0.999))
    near = timeseries.nearest_segment(spark.range(12).select(F.col("id").alias("pixel"), F.lit(2016.5).alias("t")), segs, "pixel").collect()
    assert len(near) == 12 and all(r.gap == 0 for r in near)
    counts = {r.pixel: r.n_breaks for r in timeseries.break_count(segs, "pixel", first=2015.0, last=2023.0).collect()}
    assert counts == {p: len(b) for p, b in breaks.items()}
    made = timeseries.yearly_synthetic(segs, [2016], "coefs_red").collect()
    for r in made:
        assert r.value == pytest.approx(_wave(2016.5, 0.2, 0.01, 0.05, 0.02), abs=0.02)
    assert detect_changes(df.limit(0), ["red"]).count() == 0
    with pytest.raises(ValueError):
        detect_changes(df, [])


def test_chi_square():
    assert chi_square_quantile(0.99, 1) == pytest.approx(6.634897, abs=1e-5) and chi_square_quantile(0.99, 6) == pytest.approx(16.811894, abs=1e-5) and chi_square_quantile(0.5, 2) == pytest.approx(2 * math.log(2))
