"""Time series of scenes and of fitted segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def monthly_median(scenes: DataFrame, keys: list[str], ts: str = "ts", value: str = "value") -> DataFrame:
    """keys, month, value, stamp (the middle of the month): the median of each month that has values."""
    own = scenes.where(F.col(value).isNotNull()).groupBy(*keys, F.date_trunc("month", ts).alias("month")).agg(F.median(value).alias(value))
    return own.select(*keys, "month", value, F.expr("month + INTERVAL 15 DAYS").alias("stamp"))


def season(ts: Column) -> Column:
    """wet from December to April, else dry."""
    return F.when(F.month(ts).isin(12, 1, 2, 3, 4), "wet").otherwise("dry")


def seasonal_radar(scenes: DataFrame, keys: list[str], *, mode: str = "IW", polarisation: str = "VV", ts: str = "ts", value: str = "value") -> DataFrame:
    """seasonal_median of the scenes of one instrument mode whose polarisations (an array) have the wanted one."""
    return seasonal_median(scenes.where((F.col("mode") == mode) & F.array_contains("polarisations", polarisation)), keys, ts, value)


def synthetic_stack(pixels: DataFrame, bands: list[str], t: float, *, scale: float = 1.0, tolerance: float = 1.0, indices: tuple[str, ...] = ()) -> DataFrame:
    """row, col, bands and indices (NDVI, NDWI, NDBI by lower-case name) at time t of pixels with tStart, tEnd and c_<band> (8 coefficients).

    A value too far from its segment or not plausible is null, and isolated nulls take the median of their neighbours.
    """
    from terrace.functions.scalars import harmonic, spectral_index, synthetic
    from terrace.operators.focal import fill_isolated

    gap = F.greatest(F.col("tStart") - t, F.lit(t) - F.col("tEnd"), F.lit(0.0))
    out = pixels.select("row", "col", *[synthetic(harmonic(F.col(f"c_{b}"), F.lit(t), F.col("tStart"), F.col("tEnd"), scale), gap, tolerance).alias(b) for b in bands])
    whole = out.select("row", "col")
    for b in bands:
        whole = whole.join(fill_isolated(out.select("row", "col", b), b), ["row", "col"])
    return whole.select("*", *[spectral_index(i, bands).alias(i.lower()) for i in indices])


def seasonal_median(scenes: DataFrame, keys: list[str], ts: str = "ts", value: str = "value") -> DataFrame:
    """keys, wet, dry: the median of each season."""
    return scenes.groupBy(*keys).pivot("_season", ["wet", "dry"]).agg(F.median(value)) if "_season" in scenes.columns else scenes.withColumn("_season", season(F.col(ts))).groupBy(*keys).pivot("_season", ["wet", "dry"]).agg(F.median(value))


def nearest_segment(targets: DataFrame, segments: DataFrame, key: str, t: str = "t", start: str = "tStart", end: str = "tEnd") -> DataFrame:
    """targets with the segment of their key that is nearest to t in time (gap 0 inside; of equals the earlier), and the gap. Targets without segments are left out."""
    gap = lambda s: F.greatest(s["s"] - F.col(t), F.col(t) - s["e"], F.lit(0.0))
    lists = segments.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(start).alias("s"), F.col(end).alias("e")))).alias("_segs"))
    best = F.array_min(F.transform("_segs", lambda s: F.struct(gap(s).alias("gap"), s["s"].alias("s"), s["e"].alias("e"))))
    joined = targets.join(lists, key).withColumn("_b", best)
    return joined.select(*targets.columns, F.col("_b.s").alias(start), F.col("_b.e").alias(end), F.col("_b.gap").alias("gap"))


def break_count(segments: DataFrame, key: str, break_col: str = "tBreak", first: float = 2020.3, last: float = 2025.7) -> DataFrame:
    """key, n_breaks from first to last."""
    return segments.groupBy(key).agg(F.count_if(F.col(break_col).between(first, last)).alias("n_breaks"))


def stable_blend(own: DataFrame, later: DataFrame, breaks: DataFrame, key: str, value: str = "p") -> DataFrame:
    """key, value: the later value where there was no break, else the own; keys without a count have a break."""
    j = own.select(key, F.col(value).alias("_own")).join(later.select(key, F.col(value).alias("_later")), key).join(breaks, key, "left")
    return j.select(key, F.when(F.coalesce("n_breaks", F.lit(1)) == 0, F.col("_later")).otherwise(F.col("_own")).alias(value))


def stable_points(points: DataFrame, segments: DataFrame, key: str, at: float = 2025.5, least: float = 0.5, break_col: str = "tBreak") -> DataFrame:
    """points whose nearest break is at least so many years from `at`; without any break they stay."""
    near = segments.where(F.col(break_col).isNotNull()).groupBy(key).agg(F.min(F.abs(F.col(break_col) - at)).alias("_d")).where(F.col("_d") < least)
    return points.join(near, key, "left_anti")


def landsat_collection(scenes: dict[str, DataFrame], bands: dict[str, dict[str, str]], *, start: str, end: str, max_cloud: float) -> DataFrame:
    """ts, pixel and reflectances by common names of all sensors, in order of time: clouded scenes and pixels are out, the rest is scaled.

    scenes: by sensor, tables of ts, pixel, cloud_cover, qa and that sensor's bands; bands: by sensor, its names of the common bands.
    """
    from functools import reduce

    from terrace.functions.scalars import OPTICAL, bits_clear, scaled

    def one(sensor: str, df: DataFrame) -> DataFrame:
        own = df.where((F.col("cloud_cover") <= max_cloud) & F.col("ts").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")) & bits_clear(F.col("qa")))
        return own.select("ts", "pixel", *[scaled(F.col(theirs), OPTICAL).alias(ours) for ours, theirs in bands[sensor].items()])

    return reduce(DataFrame.unionByName, [one(s, df) for s, df in scenes.items()]).orderBy("ts", "pixel")


def sentinel2_series(scenes: DataFrame, quality: DataFrame, bands: list[str], *, key: str = "scene_id", score: str = "quality", least: float = 0.6) -> DataFrame:
    """scenes with bands over 10000, null where the linked quality is below least; scenes without a quality are left out."""
    linked = scenes.join(quality.select(key, score), key)
    return linked.select(*[c for c in scenes.columns if c not in bands], *[F.when(F.col(score) >= least, F.col(b) / 10000.0).alias(b) for b in bands])


def yearly_synthetic(segments: DataFrame, years: list[int], coefs: str = "coefs", *, key: str = "pixel", fraction: float = 0.5, scale: float = 1.0, tolerance: float = 1.0) -> DataFrame:
    """key, year, value: the harmonic of the segment nearest to each year's fraction, null if too far or not plausible."""
    from terrace.functions.scalars import harmonic, synthetic

    lists = segments.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("tStart", "tEnd", coefs))).alias("_s"))
    each = lists.select(key, "_s", F.explode(F.array(*map(F.lit, years))).alias("year")).withColumn("t", F.col("year") + fraction)
    best = F.array_min(F.transform("_s", lambda s: F.struct(F.greatest(s["tStart"] - F.col("t"), F.col("t") - s["tEnd"], F.lit(0.0)).alias("gap"), s.alias("seg"))))
    each = each.withColumn("_b", best)
    value = harmonic(F.col(f"_b.seg.{coefs}"), F.col("t"), F.col("_b.seg.tStart"), F.col("_b.seg.tEnd"), scale)
    return each.select(key, "year", synthetic(value, F.col("_b.gap"), tolerance).alias("value"))
