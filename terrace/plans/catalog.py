"""Registered queries of the land-cover operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terrace.plans import accuracy, change, files, geometries, imagery, models, more, pixels

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
for _part in (change, pixels, accuracy, imagery, more, geometries, files, models):
    QUERIES |= _part.QUERIES
    ORACLES |= _part.ORACLES
