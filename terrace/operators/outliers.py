"""Outliers within each class: isolation forest, or Mahalanobis distance from plain or robust moments."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.grid import GridSpec
from terrace.operators.quantiles import exact_quantiles
from terrace.operators.sampling import join_flags, load_and_extract, remove_flagged
from terrace.scratch import materialize

#: Points that a tree is grown on at most, by the published method; and trees.
SUBSAMPLE, TREES = 256, 300


def _path_norm(n: np.ndarray | float) -> np.ndarray | float:
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def _tree(x: np.ndarray, rng: np.random.Generator, limit: int) -> tuple:
    if limit == 0 or len(x) <= 1 or (x.max(0) == x.min(0)).all():
        return (len(x),)
    k = rng.choice(np.flatnonzero(x.max(0) > x.min(0)))
    at = rng.uniform(x[:, k].min(), x[:, k].max())
    left = x[:, k] < at
    return k, at, _tree(x[left], rng, limit - 1), _tree(x[~left], rng, limit - 1)


def _depth(node: tuple, x: np.ndarray, own: np.ndarray, depth: int, out: np.ndarray) -> None:
    if len(node) == 1:
        out[own] += depth + _path_norm(node[0])
        return
    left = x[own, node[0]] < node[1]
    _depth(node[2], x, own[left], depth + 1, out)
    _depth(node[3], x, own[~left], depth + 1, out)


def isolation_scores(sample: np.ndarray, x: np.ndarray, seed: int = 42) -> np.ndarray:
    """Scores of x (higher: worse) by trees grown on sample."""
    rng, n = np.random.default_rng(seed), min(SUBSAMPLE, len(sample))
    total = np.zeros(len(x))
    for _ in range(TREES):
        _depth(_tree(sample[rng.choice(len(sample), n, replace=False)], rng, int(np.ceil(np.log2(max(n, 2))))), x, np.arange(len(x)), 0, total)
    return 2.0 ** (-total / TREES / max(float(_path_norm(n)), 1e-9))


def outliers(points: DataFrame, features: list[str], *, key: str = "point_id", label: str = "class_id", method: str = "isolation_forest", contamination: float = 0.05, least: int = 30) -> DataFrame:
    """key, label, outlier, score: within each class the share `contamination` that scores worst. A class of one is no outlier and has no score.

    Features are scaled by each class's mean and deviation, found by aggregation. Trees grow on a bounded sample of the class; all points
    are then scored in slices, so a class of any size is dealt over many tasks. elliptic_envelope: Mahalanobis distance from the moments of
    the class's tightest half, which outliers can't pull (see `robust`); elliptic: from those of all its points. Both for classes of at
    least `least`; smaller ones use trees. A feature that isn't finite stops the query.
    """
    if method not in ("isolation_forest", "elliptic", "elliptic_envelope"):
        raise ValueError(f"unknown method {method}")
    if not features:
        raise ValueError("there are no features")
    if not 0 < contamination <= 0.5:
        raise ValueError("contamination is above 0 and at most 0.5")
    bad = F.lit(False)
    for f in features:
        bad = bad | F.col(f).isNull() | F.isnan(F.col(f).cast("double")) | (F.abs(F.col(f)) == float("inf"))
    own = points.select(key, label, F.when(bad, F.raise_error(F.lit("a feature is not finite"))).otherwise(F.array(*[F.col(f).cast("double") for f in features])).cast("array<double>").alias("x"))
    d = len(features)
    pairs = [F.avg(F.col("x")[a] * F.col("x")[b]).alias(f"c{a}_{b}") for a in range(d) for b in range(a, d)] if method == "elliptic" else [F.avg(F.col("x")[a] * F.col("x")[a]).alias(f"c{a}_{a}") for a in range(d)]
    stats = own.groupBy(label).agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col("x")[a]).alias(f"m{a}") for a in range(d)], *pairs)
    from pyspark.sql import Window

    pick = Window.partitionBy(label).orderBy(F.xxhash64(key), key)
    sample = own.withColumn("_n", F.row_number().over(pick)).where(F.col("_n") <= 16 * SUBSAMPLE).groupBy(label).agg(F.collect_list("x").alias("sample"))
    if method == "elliptic_envelope":
        stats = stats.join(_robust(own, stats, sample, label, d, least), label, "left")
    known = stats.join(sample, label).select(label, F.struct(*[c for c in stats.columns if c != label], "sample").alias("k"))
    slices = F.greatest(F.lit(1), F.ceil(F.col("k.n") / 20000)).cast("int")
    dealt = own.join(known.select(label, slices.alias("_many")), label).withColumn("_slice", F.pmod(F.xxhash64(key), F.col("_many")).cast("int"))
    base = known.withColumn("_slice", F.explode(F.sequence(F.lit(0), slices - 1))).select(F.col(label).alias("_label"), F.col("_slice").alias("_part"), "k")
    fields = {f.name: f.dataType.simpleString() for f in points.schema}

    def score(pdf: pd.DataFrame, about: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({key: [], label: [], "score": []})
        k = about["k"].iloc[0]
        x = np.array(pdf["x"].tolist())
        n, mean = k["n"], np.array([k[f"m{a}"] for a in range(d)])
        if n < 2:
            got = np.full(len(x), np.nan)
        elif method == "elliptic" and n >= least:
            cov = np.array([[k[f"c{min(a, b)}_{max(a, b)}"] - mean[a] * mean[b] for b in range(d)] for a in range(d)])
            got = np.einsum("nd,de,ne->n", x - mean, np.linalg.pinv(cov), x - mean)
        elif method == "elliptic_envelope" and n >= least:
            dev = np.sqrt(np.maximum([k[f"c{a}_{a}"] - mean[a] ** 2 for a in range(d)], 0))
            dev[dev == 0] = 1
            z = (x - mean) / dev - np.array(k["robust_mean"])
            got = np.einsum("nd,de,ne->n", z, np.linalg.pinv(np.array([list(r) for r in k["robust_cov"]])), z)
        else:
            dev = np.sqrt(np.maximum([k[f"c{a}_{a}"] - mean[a] ** 2 for a in range(d)], 0))
            dev[dev == 0] = 1
            got = isolation_scores((np.array([list(s) for s in k["sample"]]) - mean) / dev, (x - mean) / dev)
        return pd.DataFrame({key: pdf[key], label: pdf[label], "score": got})

    done = dealt.groupBy(label, "_slice").cogroup(base.groupBy("_label", "_part")).applyInPandas(score, f"{key} {fields[key]}, {label} {fields[label]}, score double")
    done = done.withColumn("score", F.when(~F.isnan("score"), F.col("score")))
    done = materialize(done, "scores")
    ends = exact_quantiles(done, F.col(label), F.col("score"), (1 - contamination,))  # a number for each class
    edge = F.broadcast(points.sparkSession.createDataFrame([(k, v[0]) for k, v in ends.items()], f"{label} {fields[label]}, _edge double"))
    return done.join(edge, label, "left").select(key, label, F.coalesce(F.col("score") > F.col("_edge"), F.lit(False)).alias("outlier"), "score").orderBy(F.desc("outlier"), F.desc_nulls_last("score"))


def _robust(own: DataFrame, stats: DataFrame, sample: DataFrame, label: str, d: int, least: int) -> DataFrame:
    """label, robust_mean, robust_cov of each class of at least `least` points, whose features are scaled by mean and deviation."""
    from terrace.operators.robust import robust_moments

    dev = lambda a: F.sqrt(F.greatest(F.col(f"c{a}_{a}") - F.col(f"m{a}") * F.col(f"m{a}"), F.lit(0.0)))
    scale = stats.where(F.col("n") >= least).select(label, F.array(*[F.col(f"m{a}") for a in range(d)]).alias("_m"), F.array(*[F.when(dev(a) > 0, dev(a)).otherwise(1.0) for a in range(d)]).alias("_d"))
    scaled = lambda x: F.zip_with(F.zip_with(x, F.col("_m"), lambda a, b: a - b), F.col("_d"), lambda a, b: a / b)
    points = materialize(own.join(scale, label).select(label, scaled(F.col("x")).alias("x")), "scaled")
    samples = sample.join(scale, label).select(label, F.transform("sample", scaled).alias("sample"))
    found = robust_moments(points, samples, label, d)
    kind = own.schema[label].dataType.simpleString()
    return own.sparkSession.createDataFrame([(k, m.tolist(), c.tolist()) for k, (m, c) in found.items()], f"{label} {kind}, robust_mean array<double>, robust_cov array<array<double>>")


def detect_point_outliers(pixels: DataFrame, points: DataFrame, grid: GridSpec, bands: list[str], *, label: str = "class_id", key: str = "point_id", epsg: int | None = None, **how) -> DataFrame:
    """Outliers among points by the bands of the pixels that hold them: load_and_extract, then outliers."""
    return outliers(load_and_extract(pixels, points, grid, bands=bands, label=label, epsg=epsg, key=key), bands, key=key, label=label, **how)


def split_flagged(features: DataFrame, flags: DataFrame, key: str = "point_id") -> tuple[DataFrame, DataFrame]:
    """(features without those flagged, features with their flags), geometry and all columns kept, for write_features."""
    return remove_flagged(features, flags, key), join_flags(features, flags, key)
