"""Rasters, samples and series derived from the driver's tables, by integer arithmetic that two engines do alike.

Each is a list of expressions over one table. `//` stands for whole division (both engines have it under another name).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_BASE = "(1 + ((o_orderkey // 100 // 5) * 7 + ((o_orderkey % 100) // 5) * 3) % 18)"


def _epoch(k: int) -> str:
    return (
        f"CAST(CASE WHEN o_custkey % 50 = 0 THEN 0 WHEN (31 * o_custkey + 17 * o_orderkey + {101 * k}) % 100 < 12 "
        f"THEN 1 + (o_custkey + {5 * k}) % 18 ELSE {_BASE} END AS INT) AS e{k}"
    )


def _level(k: int, least: int = 0) -> str:
    return f"CAST(floor(abs(CAST(embedding[@{k}] AS DOUBLE)) * 10000) AS BIGINT) + {least}"


_PIXEL = ["o_orderkey // 100 AS row", "o_orderkey % 100 AS col"]
_VEC = ["vec_id // 25 AS row", "vec_id % 25 AS col"]
_FRAC = "(year(o_orderdate) + (dayofyear(o_orderdate) - 1) / CAST(365.25 AS DOUBLE))"

FIXTURES: dict[str, tuple[str, list[str]]] = {
    "px_epochs": ("orders", [*_PIXEL, *[_epoch(k) for k in range(4)]]),
    "px_masks": ("orders", [*_PIXEL, "CAST(CASE WHEN o_orderkey % 100 BETWEEN 10 AND 12 THEN 1 ELSE 0 END AS INT) AS corridor", "CAST(CASE WHEN (o_orderkey // 100) % 20 < 3 THEN 1 ELSE 0 END AS INT) AS settlement"]),
    "px_dem": ("orders", [*_PIXEL, "((o_orderkey // 100) * (o_orderkey // 100) + 3 * (o_orderkey % 100) * (o_orderkey % 100)) % 997 AS z"]),
    "px_levels": ("embeddings", [*_VEC, *[f"{_level(k)} AS p{k}" for k in range(10)]]),
    "px_segments": ("embeddings", [*_VEC, "CASE WHEN ((vec_id // 25) // 4 + (vec_id % 25) // 4) % 11 = 0 THEN 0 ELSE ((vec_id // 25) // 4) * 1000 + (vec_id % 25) // 4 + 1 END AS seg"]),
    "px_bands": ("embeddings", [*_VEC, *[f"{_level(k + 10, 1)} AS {b}" for k, b in enumerate(("blue", "green", "red", "nir", "swir1", "swir2"))]]),
    "ref_samples": ("lineitem", ["1 + l_suppkey % 6 AS ref_class", "CASE WHEN l_partkey % 5 = 0 THEN 1 + (l_suppkey + l_linenumber) % 6 ELSE 1 + l_suppkey % 6 END AS map_class"]),
    "points": ("events", ["event_id AS point_id", "500000 + 10 * (event_id * 37 % 100) + 5 AS x", "9000000 - 10 * (event_id * 53 % 150) - 5 AS y", "1 + user_id % 18 AS class_id"]),
    "flags": ("events", ["event_id AS point_id", "event_id % 7 = 0 AS outlier", "CAST(event_id % 101 AS DOUBLE) AS score"]),
    "polygons": ("supplier", ["s_suppkey AS poly_id", "1 + s_nationkey % 18 AS class_id", "(s_suppkey * 7) % 140 AS r", "(s_suppkey * 13) % 90 AS c"]),
    "px_scenes": ("events", ["user_id AS pixel", "ts", "event_type AS band", "value", "event_id AS ord"]),
    "ts_segments": ("orders", ["o_custkey AS pixel", f"round({_FRAC}, 6) AS tStart", f"round({_FRAC} + 0.5, 6) AS tEnd", f"CASE WHEN o_orderkey % 3 = 0 THEN round({_FRAC} + 0.25, 6) END AS tBreak"]),
    "qa_pixels": ("lineitem", ["l_orderkey", "CAST(l_partkey % 64 AS INT) AS qa", "CAST(l_suppkey AS INT) + 8000 AS dn"]),
    "qa_scenes": ("lineitem", ["l_shipdate AS ts", "l_orderkey AS pixel", "CAST(l_suppkey % 50 AS DOUBLE) AS cloud_cover", "CAST(l_partkey % 64 AS INT) AS qa", "CAST(l_suppkey AS INT) + 8000 AS b1", "CAST(l_partkey % 9000 AS INT) + 8000 AS b2"]),
    "scene_list": ("orders", ["o_orderkey AS item_id", "o_orderdate AS ts", "CAST(o_custkey % 100 AS DOUBLE) AS cloud_cover", "CAST(o_orderkey % 100 AS DOUBLE) AS xmin", "CAST(o_orderkey % 100 + 1 AS DOUBLE) AS xmax", "CAST(o_orderkey % 37 AS DOUBLE) AS ymin", "CAST(o_orderkey % 37 + 1 AS DOUBLE) AS ymax"]),
}


def _index(text: str, first: int) -> str:
    import re

    return re.sub(r"\[@(\d+)\]", lambda m: f"[{int(m[1]) + first}]", text)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, exprs = FIXTURES[name]
    return spark.read.parquet(f"{sf_dir}/{source}.parquet").selectExpr(*[_index(e, 0).replace("//", " div ") for e in exprs])


def sql(name: str) -> str:
    """The same as a DuckDB query."""
    source, exprs = FIXTURES[name]
    return f"SELECT {', '.join(_index(e, 1) for e in exprs)} FROM {source}"
