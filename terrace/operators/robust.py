"""Robust moments of each class: the mean and covariance of the tightest half of its points (minimum covariance determinant).

Starts are tried on a bounded sample of a class: small random subsets, each drawn together by concentration steps, the tightest taken. From
it all points go on: distances, the distance within which half of them lie (an exact quantile by counts), and the moments of that
half by aggregation, until the determinant no longer falls. Then the covariance is made consistent by the median distance, and
the moments are taken once more of all points that aren't too far out. A round is a few aggregations; the driver gets a row for each class.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.operators.quantiles import exact_quantiles
from terrace.operators.segmentation import chi_square_quantile

#: Random starts on a sample, those that go on to the end, and the most rounds over all points.
STARTS, KEPT, ROUNDS = 300, 10, 30

Moments = dict[object, tuple[np.ndarray, np.ndarray]]


def half(n: int, d: int) -> int:
    """Points of the half that is taken."""
    return min(n, math.ceil((n + d + 1) / 2))


def _log_det(cov: np.ndarray) -> float:
    sign, value = np.linalg.slogdet(cov)
    return value if sign > 0 else -math.inf


def _concentrate(x: np.ndarray, mean: np.ndarray, cov: np.ndarray, h: int, rounds: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Steps from these moments: (log of the determinant, mean, covariance) of the h points that are nearest."""
    det = math.inf
    for _ in range(rounds):
        left = x - mean
        near = np.argpartition(np.einsum("nd,de,ne->n", left, np.linalg.pinv(cov), left), h - 1)[:h]
        mean, cov = x[near].mean(axis=0), np.cov(x[near].T, bias=True).reshape(x.shape[1], -1)
        before, det = det, _log_det(cov)
        if det == -math.inf or before - det < 1e-9:
            break
    return det, mean, cov


def start(x: np.ndarray, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """The tightest half of a sample, as its mean and covariance."""
    rng, (n, d) = np.random.default_rng(seed), x.shape
    h = half(n, d)
    found = []
    for _ in range(STARTS if n > d + 1 else 1):
        own = x[rng.choice(n, min(n, d + 1), replace=False)]
        found.append(_concentrate(x, own.mean(axis=0), np.cov(own.T, bias=True).reshape(d, -1), h, 2))
    found.sort(key=lambda f: f[0])
    best = min((_concentrate(x, m, c, h, 100) for _, m, c in found[:KEPT]), key=lambda f: f[0])
    return best[1], best[2]


def distance(x: Column, mean: Column, precision: Column) -> Column:
    """The squared distance of an array from a mean, by the inverse of a covariance (an array of rows)."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    return F.transform(F.array(F.zip_with(x, mean, lambda a, b: a - b)), lambda left: dot(left, F.transform(precision, lambda row: dot(row, left))))[0]


def _table(points: DataFrame, moments: Moments, label: str) -> DataFrame:
    kind = points.schema[label].dataType.simpleString()
    rows = [(k, m.tolist(), np.linalg.pinv(c).tolist()) for k, (m, c) in moments.items()]
    return F.broadcast(points.sparkSession.createDataFrame(rows, f"{label} {kind}, mean array<double>, precision array<array<double>>"))


def _moments(rows: DataFrame, label: str, d: int) -> dict[object, tuple[int, np.ndarray, np.ndarray]]:
    """For each class how many rows there are, their mean and covariance, from sums around a place near their middle (`mean`)."""
    at = [F.col("x")[a] - F.col("mean")[a] for a in range(d)]
    sums = [F.avg(v).alias(f"m{a}") for a, v in enumerate(at)] + [F.avg(at[a] * at[b]).alias(f"c{a}_{b}") for a in range(d) for b in range(a, d)]
    out = {}
    for r in rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.first("mean").alias("mean"), *sums).collect():
        m = np.array([r[f"m{a}"] for a in range(d)])
        cov = np.array([[r[f"c{min(a, b)}_{max(a, b)}"] - m[a] * m[b] for b in range(d)] for a in range(d)])
        out[r[label]] = (r["n"], m + np.array(r["mean"]), cov)
    return out


def robust_moments(points: DataFrame, samples: DataFrame, label: str, d: int, seed: int = 42) -> Moments:
    """mean and covariance of each class. points: label, x (an array of d); samples: label, sample (a bounded array of x of each class). Few classes.

    Null labels count for nothing. A half whose points lie in a plane ends the rounds: distances then are those in the plane.
    """
    kind = points.schema[label].dataType.simpleString()

    def begin(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(k, *start(np.array([list(v) for v in s]), seed)) for k, s in zip(pdf[label], pdf["sample"], strict=True)]
        return pd.DataFrame([(k, m.tolist(), c.tolist()) for k, m, c in rows], columns=[label, "mean", "cov"])

    begun = samples.where(F.col(label).isNotNull()).groupBy(label).applyInPandas(begin, f"{label} {kind}, mean array<double>, cov array<array<double>>").collect()
    moments: Moments = {r[label]: (np.array(r["mean"]), np.array(r["cov"])) for r in begun}
    if not moments:
        return {}
    own = points.where(F.col(label).isNotNull())
    sizes = {r[label]: r["count"] for r in own.groupBy(label).count().collect()}
    far = lambda m: own.join(_table(points, m, label), label).withColumn("away", distance(F.col("x"), F.col("mean"), F.col("precision")))
    going = dict(moments)
    for _ in range(ROUNDS):
        rows = far(going)
        cuts = _cuts(rows, label, {k: half(sizes[k], d) for k in going})
        edge = F.broadcast(points.sparkSession.createDataFrame(list(cuts.items()), f"{label} {kind}, edge double"))
        for k, (_, mean, cov) in _moments(rows.join(edge, label).where("away <= edge"), label, d).items():
            falls = _log_det(moments[k][1]) - _log_det(cov)
            if falls > 0 or _log_det(cov) == -math.inf:
                moments[k] = (mean, cov)
            going[k] = (mean, cov)
            if not falls > 1e-9:
                del going[k]
        if not going:
            break
    medians = exact_quantiles(far(moments), F.col(label), F.col("away"), (0.5,))
    scale = {k: max(v[0], 1e-300) / chi_square_quantile(0.5, d) for k, v in medians.items()}
    whole = {k: (m, c * scale[k]) for k, (m, c) in moments.items()}
    final = _moments(far(whole).where(F.col("away") < chi_square_quantile(0.975, d)), label, d)
    return {k: final[k][1:] if k in final else m for k, m in whole.items()}


def _cuts(rows: DataFrame, label: str, wanted: dict[object, int]) -> dict[object, float]:
    """For each class the distance of its point number `wanted` in order."""
    out: dict[object, float] = {}
    by_share: dict[float, list] = {}
    sizes = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}
    for k, h in wanted.items():
        by_share.setdefault((h - 1) / max(sizes[k] - 1, 1), []).append(k)
    shares = tuple(sorted(by_share))
    found = exact_quantiles(rows, F.col(label), F.col("away"), shares)
    for i, s in enumerate(shares):
        for k in by_share[s]:
            out[k] = found[k][i] * (1 + 1e-12)
    return out
