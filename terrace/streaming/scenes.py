"""Scene observations as a stream: means of tumbling windows, late rows up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_means(stream: DataFrame, keys: list[str], *, ts: str = "ts", value: str = "value", window: str = "30 days", late: str = "10 days") -> DataFrame:
    """start, keys, n, mean of each window of time, kept until the watermark has passed it."""
    own = stream.where(F.col(value).isNotNull()).withWatermark(ts, late)
    done = own.groupBy(F.window(ts, window).alias("_w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    return done.select(F.col("_w.start").alias("start"), *keys, "n", "mean")
