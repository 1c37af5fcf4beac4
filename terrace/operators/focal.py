"""Neighbourhoods of pixels: windows in tiles with a margin; where few pixels look around, each looks for its neighbours by a join."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from terrace.functions.scalars import argmax, finite, to_logits, to_probs
from terrace.operators.tiles import TILE, Tile, apply_tiles, selected_mean_variance, with_lists


def check_window(size: int, fraction: float = 0.5) -> None:
    if not isinstance(size, int) or size < 1 or size % 2 == 0:
        raise ValueError(f"a window has an odd size above 0: {size}")
    if not 0 <= fraction <= 1:
        raise ValueError(f"a fraction lies between 0 and 1: {fraction}")


def spread(pixels: DataFrame, radius: int, cols: list[str]) -> DataFrame:
    """row, col (of the centre), dr, dc and cols of each neighbour within the square radius, itself included."""
    steps = F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r in range(-radius, radius + 1) for c in range(-radius, radius + 1)])
    each = pixels.select("row", "col", *cols, F.explode(steps).alias("s"))
    return each.select((F.col("row") - F.col("s.dr")).alias("row"), (F.col("col") - F.col("s.dc")).alias("col"), F.col("s.dr").alias("dr"), F.col("s.dc").alias("dc"), *cols)


def local_mean_variance(pixels: DataFrame, value: str = "v", *, window: int = 7, fraction: float = 0.5, by: tuple[str, ...] = (), tile: int = TILE) -> DataFrame:
    """row, col, by, value, mean, var: of the neighbours whose value is at least their own window's percentile.

    A pixel's threshold is the percentile 1 - fraction (of half a hundredth) of the finite values in its window; it is
    selected if it reaches its own. Mean and population variance are over the selected neighbours; without one they are the
    pixel's value and 1; a variance of 0 is 1; a pixel that isn't finite has no mean and variance 1. Tiles have a margin of two
    radii, so results don't depend on them.
    """
    check_window(window, fraction)
    at = int((1 - fraction) * 100 + 0.5) / 100
    own = pixels.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), *by, F.when(finite(F.col(value)), F.col(value).cast("double")).alias("value"))

    def run(t: Tile, pdf: pd.DataFrame) -> pd.DataFrame:
        mean, var = (t.take(x) for x in selected_mean_variance(t.grid(pdf["value"].to_numpy(float)), window, at))
        out = pdf[t.inner][["row", "col", *by, "value"]]
        v = out["value"].to_numpy(float)
        return out.assign(mean=np.where(np.isnan(v), np.nan, np.where(np.isnan(mean), v, mean)), var=np.where(np.isnan(v) | ~(var > 0), 1.0, var))

    return apply_tiles(own, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema) + ", mean double, var double", halo=2 * (window // 2), tile=tile, by=by)


def smoothness_by_class(smoothness: float | list[float] | Mapping[int, float], classes: list[int]) -> list[float]:
    """One number for all classes, a list in their order, or a mapping that has each class; finite and not negative."""
    if isinstance(smoothness, Mapping):
        lacking = [c for c in classes if c not in smoothness]
        if lacking:
            raise ValueError(f"no smoothness for classes {lacking}")
        out = [float(smoothness[c]) for c in classes]
    elif isinstance(smoothness, (int, float)):
        out = [float(smoothness)] * len(classes)
    else:
        out = [float(x) for x in smoothness]
        if len(out) != len(classes):
            raise ValueError(f"{len(out)} values of smoothness for {len(classes)} classes")
    if any(not 0 <= s < float("inf") for s in out):
        raise ValueError("smoothness is finite and not negative")
    return out


def _logit_tiles(pixels: DataFrame, window: int, fraction: float, eps: float, scale: float, tile: int, make, column: str) -> DataFrame:
    """row, col and column: make(class, logits, mean, variance) for each class of each pixel whose probabilities are all finite. One shuffle."""
    check_window(window, fraction)
    at = int((1 - fraction) * 100 + 0.5) / 100
    whole = F.forall("p", lambda x: finite(x.cast("double")))
    rows = pixels.where(whole).select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), to_logits(F.transform("p", lambda x: x / scale), eps).alias("x"))

    def run(t: Tile, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array(pdf["x"].tolist())
        out = []
        for k in range(x.shape[1]):
            mean, var = (t.take(g) for g in selected_mean_variance(t.grid(x[:, k]), window, at))
            v = x[t.inner, k]
            out.append(make(k, v, np.where(np.isnan(mean), v, mean), np.where(var > 0, var, 1.0)))
        return with_lists(pdf[t.inner][["row", "col"]], column, np.stack(out, 1))

    return apply_tiles(rows, run, f"row long, col long, {column} array<double>", halo=2 * (window // 2), tile=tile)


def local_variance(pixels: DataFrame, *, window: int = 7, fraction: float = 0.5, eps: float = 1e-3, scale: float = 1.0, tile: int = TILE) -> DataFrame:
    """row, col, var (array): the variance of each class's logits as in local_mean_variance, of probabilities p."""
    return _logit_tiles(pixels, window, fraction, eps, scale, tile, lambda k, v, mean, var: var, "var")


def bayesian_smooth(pixels: DataFrame, *, smoothness: float | list[float] | Mapping[int, float], classes: list[int] | None = None, window: int = 7, fraction: float = 0.5, eps: float = 1e-3, scale: float = 1.0, tile: int = TILE) -> DataFrame:
    """row, col, p: probabilities by class (array p, in units of 1 / scale) shrunk towards their neighbours' logits. A pixel with a value that isn't finite has none.

    classes: what smoothness as a mapping or a single number refers to. All classes of a tile are smoothed where it lies.
    """
    if classes is None and not isinstance(smoothness, list):
        raise ValueError("a single smoothness or a mapping needs the classes")
    s2 = smoothness_by_class(smoothness, classes if classes is not None else list(range(len(smoothness))))
    post = lambda k, v, mean, var: v * var / (s2[k] + var) + mean * s2[k] / (s2[k] + var)
    return _logit_tiles(pixels, window, fraction, eps, scale, tile, post, "x").select("row", "col", to_probs(F.col("x")).alias("p"))


def smooth_and_classify(pixels: DataFrame, classes: list[int], **how) -> DataFrame:
    """row, col, cls of a smoothed probability table; pixels whose probabilities are all 0 or not finite are 0."""
    lit = F.exists("p", lambda x: x != 0) & F.forall("p", lambda x: finite(x.cast("double")))
    done = bayesian_smooth(pixels.where(lit), **how).select("row", "col", argmax(F.col("p"), classes).alias("cls"))
    return pixels.select("row", "col").join(done, ["row", "col"], "left").select("row", "col", F.coalesce("cls", F.lit(0)).alias("cls"))


def heal_seams(pixels: DataFrame, *, value: str | list[str] = "cls", nodata: float = 0, width: int = 4) -> DataFrame:
    """row, col, value: pixels without data take the value of the nearest valid one within width (Euclidean; of equals the lowest row, then column).

    value: a column or several; of several (or of an array) a pixel is valid if any is other than nodata and finite, and all are
    taken from one pixel. Only pixels without data look around: wide areas of them cost as many rows as they have pixels, times the window.
    """
    names = [value] if isinstance(value, str) else list(value)
    good = lambda x: (x != F.lit(nodata)) & finite(x.cast("double"))
    kind = {f.name: f.dataType for f in pixels.schema}
    valid = F.lit(False)
    for n in names:
        one = F.exists(n, good) if isinstance(kind[n], ArrayType) else good(F.col(n))
        valid = valid | F.coalesce(one, F.lit(False))
    own = pixels.select("row", "col", *names, valid.alias("_valid"))
    steps = [(r * r + c * c, r, c) for r in range(-width, width + 1) for c in range(-width, width + 1) if 0 < r * r + c * c <= width * width]
    around = F.explode(F.array(*[F.struct(F.lit(d).alias("d2"), F.lit(r).alias("dr"), F.lit(c).alias("dc")) for d, r, c in steps])).alias("_s")
    looks = own.where("NOT _valid").select(F.col("row").alias("_r"), F.col("col").alias("_c"), around).select("_r", "_c", (F.col("_r") + F.col("_s.dr")).alias("row"), (F.col("_c") + F.col("_s.dc")).alias("col"), "_s")
    found = looks.join(own.where("_valid").select("row", "col", F.struct(*names).alias("_v")), ["row", "col"])
    fill = found.groupBy(F.col("_r").alias("row"), F.col("_c").alias("col")).agg(F.min_by("_v", "_s").alias("_fill"))
    joined = own.join(fill, ["row", "col"], "left")
    return joined.select("row", "col", *[F.when(F.col("_fill").isNotNull(), F.col("_fill")[n]).otherwise(F.col(n)).alias(n) for n in names])


def heal_spikes(pixels: DataFrame, *, bands: int, spike: float | None = None, major: float | None = None, agreement: int = 3) -> DataFrame:
    """row, col, p (array): a pixel that stands out from both neighbours of its line takes their mean in all bands; along rows first, then down columns of the result.

    It stands out if a band is above both by more than major, or if at least `agreement` bands are above or below both by more
    than spike. Without thresholds they are 0.01 and 0.06 for fractional probabilities up to 1.05, else 100 and 600. Whole
    numbers are rounded at the end, fractional ones are not.
    """
    kind = pixels.schema["p"].dataType.elementType
    fractional = isinstance(kind, (FloatType, DoubleType))
    if spike is None or major is None:
        most = pixels.agg(F.max(F.array_max(F.filter("p", lambda x: finite(x.cast("double")))))).first()[0] if fractional else None
        unit = fractional and most is not None and most <= 1.05
        spike, major = (0.01 if unit else 100) if spike is None else spike, (0.06 if unit else 600) if major is None else major

    def one(df: DataFrame, line: str, along: str) -> DataFrame:
        w = Window.partitionBy(line).orderBy(along)
        beside = lambda f, step: F.when(f(along).over(w) == F.col(along) + step, f("p").over(w))
        t = df.withColumn("_a", beside(F.lag, -1)).withColumn("_b", beside(F.lead, 1))
        cell = lambda k: (F.col("p")[k], F.col("_a")[k], F.col("_b")[k])
        more = lambda d, by: (d > by) & ~F.isnan(d)
        up = lambda k, by: more(cell(k)[0] - cell(k)[1], by) & more(cell(k)[0] - cell(k)[2], by)
        down = lambda k, by: more(cell(k)[1] - cell(k)[0], by) & more(cell(k)[2] - cell(k)[0], by)
        peaks = sum(((up(k, spike) | down(k, spike)).cast("int") for k in range(bands)), F.lit(0))
        high = F.lit(False)
        for k in range(bands):
            high = high | up(k, major)
        mean = F.zip_with("_a", "_b", lambda a, b: (a + b) / 2)
        hit = F.col("_a").isNotNull() & F.col("_b").isNotNull() & (high | (peaks >= agreement))
        return t.select("row", "col", F.when(hit, mean).otherwise(F.col("p")).alias("p"))

    done = one(one(pixels.select("row", "col", F.transform("p", lambda x: x.cast("double")).alias("p")), "row", "col"), "col", "row")
    back = (lambda x: x.cast(kind)) if fractional else (lambda x: F.bround(x).cast(kind))
    return done.select("row", "col", F.transform("p", back).alias("p"))


def slope_aspect(pixels: DataFrame, z: str = "z", xres: float = 10.0, yres: float = 10.0) -> DataFrame:
    """row, col, slope, aspect in degrees: central differences, one-sided at edges, 0 where there is no neighbour."""
    def gradient(line: str, along: str, res: float) -> Column:
        w = Window.partitionBy(line).orderBy(along)
        a = F.when(F.lag(along).over(w) == F.col(along) - 1, F.lag(z).over(w))
        b = F.when(F.lead(along).over(w) == F.col(along) + 1, F.lead(z).over(w))
        return F.when(a.isNotNull() & b.isNotNull(), (b - a) / (2 * res)).when(b.isNotNull(), (b - F.col(z)) / res).when(a.isNotNull(), (F.col(z) - a) / res).otherwise(0.0)

    t = pixels.select("row", "col", F.col(z).cast("double").alias(z)).withColumn("_dx", gradient("row", "col", xres)).withColumn("_dy", gradient("col", "row", yres))
    return t.select("row", "col", F.degrees(F.atan(F.hypot("_dx", "_dy"))).alias("slope"), F.pmod(F.degrees(F.atan2(-F.col("_dx"), F.col("_dy"))) + 360, F.lit(360.0)).alias("aspect"))


def fill_isolated(pixels: DataFrame, value: str = "v", least: int = 5) -> DataFrame:
    """row, col, value: a null pixel takes the median of its 3 by 3 window if that has at least `least` values. Only null pixels look around."""
    steps = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r in (-1, 0, 1) for c in (-1, 0, 1) if r or c])).alias("_s")
    looks = pixels.where(F.col(value).isNull()).select(F.col("row").alias("_r"), F.col("col").alias("_c"), steps).select("_r", "_c", (F.col("_r") + F.col("_s.r")).alias("row"), (F.col("_c") + F.col("_s.c")).alias("col"))
    near = looks.join(pixels.where(F.col(value).isNotNull()).select("row", "col", value), ["row", "col"])
    near = near.groupBy(F.col("_r").alias("row"), F.col("_c").alias("col")).agg(F.median(value).alias("_m"), F.count(F.lit(1)).alias("_n"))
    return pixels.join(near.where(F.col("_n") >= least), ["row", "col"], "left").select("row", "col", F.coalesce(F.col(value), F.col("_m")).alias(value))


def nearest_by_envelope(at: list[float], height: list[float]) -> tuple[list[float], list[int]]:
    """The lower envelope of the parabolas (x - at)^2 + height^2, at ascending: where each part of it begins, and whose it is."""
    begin: list[float] = []
    whose: list[int] = []
    for k, (x, v) in enumerate(zip(at, height, strict=True)):
        start = -np.inf
        while whose:
            j = whose[-1]
            start = (x * x + v * v - at[j] * at[j] - height[j] * height[j]) / (2 * (x - at[j]))
            if start > begin[-1]:
                break
            begin.pop()
            whose.pop()
            start = -np.inf
        begin.append(start)
        whose.append(k)
    return begin, whose


def distance_to(pixels: DataFrame, feature: Column, xres: float = 10.0, yres: float = 10.0) -> DataFrame:
    """row, col, distance to the nearest pixel of feature, exactly: nearest in the column from above and below, then along each row by the lower envelope of its columns' parabolas.

    Both steps are linear in the pixels. Rows without a pixel whose column has a feature have no distances and are left out.
    """
    t = pixels.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.when(feature, F.col("row")).alias("f"))
    # Both look back, one from below: a frame that ends with the partition would be read anew for every row.
    above, below = (F.last("f", True).over(Window.partitionBy("col").orderBy(o).rowsBetween(Window.unboundedPreceding, 0)) for o in (F.asc("row"), F.desc("row")))
    t = t.select("row", "col", (F.least(F.col("row") - above, below - F.col("row")) * yres).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def close() -> pa.RecordBatch:
            cols, v = np.concatenate([c for c, _ in held]), np.concatenate([x for _, x in held])
            known = ~np.isnan(v)
            if not known.any():
                return pa.RecordBatch.from_arrays([pa.array([], x) for x in (pa.int64(), pa.int64(), pa.float64())], names=["row", "col", "distance"])
            at, height = cols[known] * xres, v[known]
            begin, whose = nearest_by_envelope(at.tolist(), height.tolist())
            j = np.array(whose)[np.searchsorted(begin, cols * xres, "right") - 1]
            d = np.sqrt((cols * xres - at[j]) ** 2 + height[j] ** 2)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(cols), now)), pa.array(cols), pa.array(d)], names=["row", "col", "distance"])

        for b in batches:
            row, col = b.column(0).to_numpy(), b.column(1).to_numpy()
            v = b.column(2).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.nonzero(np.diff(row))[0] + 1), len(row)] if len(row) else [0, 0]
            for a, e in zip(cuts, cuts[1:], strict=False):
                if a == e:
                    continue
                if row[a] != now and held:
                    yield close()
                    held = []
                now = row[a]
                held.append((col[a:e], v[a:e].astype(float)))
        if held:
            yield close()

    return t.repartition("row").sortWithinPartitions("row", "col").mapInArrow(run, "row long, col long, distance double")


def decimate(pixels: DataFrame, bands: list[str], step: int = 10) -> DataFrame:
    """row, col and the mean of bands over squares of step pixels."""
    return pixels.groupBy(F.floor(F.col("row") / step).alias("row"), F.floor(F.col("col") / step).alias("col")).agg(*[F.avg(b).alias(b) for b in bands])
