"""Connected patches of one class, and the filter that dissolves small ones.

Patches are labelled within tiles (numpy, one tile at a time), labels that meet over a tile's edge are linked, and the links'
components give the patches of the whole raster; results don't depend on the size of tiles.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.operators.focal import spread
from terrace.operators.graph import components
from terrace.operators.tiles import Tile, apply_tiles, mode_of_windows, with_lists
from terrace.scratch import materialize

TILE = 512


def _tile_labels(rows: np.ndarray, cols: np.ndarray, cls: np.ndarray, eight: bool) -> np.ndarray:
    """For each pixel the index of the first pixel (row by row) of its patch in the tile."""
    r, c = rows - rows.min(), cols - cols.min()
    height, width = int(r.max()) + 1, int(c.max()) + 1
    grid = np.full((height, width), -1, np.int64)
    grid[r, c] = cls
    at = np.full(grid.shape, -1, np.int64)
    at[r, c] = np.arange(len(r))
    pairs = []
    for dr, dc in ((0, 1), (1, 0), (1, 1), (1, -1)) if eight else ((0, 1), (1, 0)):
        a = (slice(0, height - dr), slice(max(0, -dc), width - max(0, dc)))
        b = (slice(dr, height), slice(max(0, dc), width - max(0, -dc)))
        same = (grid[a] == grid[b]) & (grid[a] >= 0)
        pairs.append(np.stack([at[a][same], at[b][same]], 1))
    edges = np.concatenate(pairs)
    label = np.arange(len(r))
    while len(edges):  # hook the larger root to the smaller, then shorten all paths
        a, b = label[edges[:, 0]], label[edges[:, 1]]
        apart = a != b
        if not apart.any():
            break
        edges, a, b = edges[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            short = label[label]
            if (short == label).all():
                break
            label = short
    return label


def patches(pixels: DataFrame, cls: str = "cls", *, eight: bool = True, tile: int = TILE) -> DataFrame:
    """row, col, cls, patch (an id), size: pixels without a class are left out."""
    own = pixels.where(F.col(cls).isNotNull()).select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col(cls).cast("long").alias("cls"))
    own = own.withColumn("_tr", F.floor(F.col("row") / tile)).withColumn("_tc", F.floor(F.col("col") / tile))

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row", "col"], ignore_index=True)
        row, col = pdf["row"].to_numpy(), pdf["col"].to_numpy()
        first = _tile_labels(row, col, pdf["cls"].to_numpy(), eight)
        return pd.DataFrame({"row": row, "col": col, "cls": pdf["cls"], "label": (row[first] << 31) + col[first]})

    done = materialize(own.groupBy("_tr", "_tc").applyInPandas(label, "row long, col long, cls long, label long"), "labels")
    edge = done.where(f"row % {tile} IN (0, {tile - 1}) OR col % {tile} IN (0, {tile - 1})")
    away = spread(edge, 1, ["cls", "label"]).where("dr <> 0 OR dc <> 0" if eight else "abs(dr) + abs(dc) = 1").select("row", "col", "cls", F.col("label").alias("other"))
    links = edge.join(away, ["row", "col", "cls"]).where("label <> other").select(F.col("label").alias("u"), F.col("other").alias("v"))
    roots = components(links)
    # Sizes go by labels first: a label has no more pixels than a tile, however large its patch is.
    labels = done.groupBy("label").agg(F.count(F.lit(1)).alias("own"))
    labels = labels.join(roots, labels["label"] == roots["node"], "left").select("label", "own", F.coalesce("root", "label").alias("patch"))
    sizes = labels.groupBy("patch").agg(F.sum("own").alias("size"))
    return done.join(labels.join(sizes, "patch").select("label", "patch", "size"), "label").select("row", "col", "cls", "patch", "size")


def small_patches(pixels: DataFrame, table: dict[int, int], cls: str = "cls", tile: int = TILE) -> DataFrame:
    """row, col, cls, is_small: pixels in patches (8 neighbours) below their class's least size; classes that aren't in table are never small."""
    least = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    p = patches(pixels.where(F.col(cls).isNotNull()), cls, tile=tile)
    return p.select("row", "col", F.col("cls").cast("int").alias("cls"), (F.col("size") < F.coalesce(F.try_element_at(least, F.col("cls").cast("int")), F.lit(0))).alias("is_small"))


def dissolve_small(pixels: DataFrame, table: dict[int, int], *, iterations: int = 6, nodata: int = 0, cls: str = "cls", tile: int = TILE) -> DataFrame:
    """row, col, cls: pixels of small patches take the mode of their 3 by 3 window (of equals the lowest class), step by step.

    In each step pixels that stand already move to the mode of their window too, for later steps' sake; only pixels of small
    patches keep what they get. A small pixel that no step reaches keeps its class. nodata isn't a class.
    """
    if iterations < 0 or any(v < 0 for v in table.values()):
        raise ValueError("iterations and sizes aren't negative")
    valid = pixels.where((F.col(cls) != nodata) & F.col(cls).isNotNull())
    marked = small_patches(valid, table, cls, tile)
    marked = marked.select("row", "col", F.col("cls").cast("int").alias("cls"), "is_small")

    def run(t: Tile, pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf["cls"].to_numpy().astype(np.int32)
        is_small, there = t.grid(pdf["is_small"].to_numpy(), False), t.grid(np.ones(len(pdf), bool), False)
        small = pdf["is_small"].to_numpy() & t.inner
        cur = t.grid(np.where(pdf["is_small"], -1, own).astype(np.int32), -1)
        classes, steps = np.unique(own[~pdf["is_small"].to_numpy()]), []
        for _ in range(iterations if small.any() else 0):
            mode = mode_of_windows(cur, classes, -1)
            cur = np.where(there & (is_small | (cur >= 0)) & (mode >= 0), mode, cur)
            steps.append(cur[t.r[small], t.c[small]])
        return with_lists(pdf[small][["row", "col"]], "steps", np.stack(steps, 1) if steps else np.zeros((int(small.sum()), 0), np.int32))

    # What each small pixel is after each step; steps end for all when the last of those that are reached at all is filled.
    done = materialize(apply_tiles(marked, run, "row long, col long, steps array<int>", halo=iterations + 1, tile=tile), "mmu")
    last = done.agg(F.max(F.when(F.size("steps") > 0, F.when(F.array_contains("steps", -1) & (F.element_at("steps", -1) == -1), F.size("steps")).otherwise(F.array_size(F.filter("steps", lambda x: x < 0)) + 1)))).first()[0]
    if not last:
        return pixels.select("row", "col", F.col(cls).cast("int").alias("cls"))
    filled = done.select("row", "col", F.element_at("steps", int(last)).alias("_new")).where("_new >= 0")
    return pixels.join(filled, ["row", "col"], "left").select("row", "col", F.coalesce("_new", F.col(cls)).cast("int").alias("cls"))


def localise_clamped(segments: DataFrame, seg: str = "seg", clamp: int = 2147483647, most: int = 400) -> DataFrame:
    """row, col, seg: patches (4 neighbours) of the clamp value get an id below 0 of their own; those of more than `most` pixels 0."""
    p = patches(segments.where(F.col(seg) == clamp).withColumn("cls", F.lit(1)), "cls", eight=False)
    new = p.select("row", "col", F.when(F.col("size") > most, F.lit(0).cast("long")).otherwise(-F.col("patch") - 2).alias("_new"))
    return segments.join(new, ["row", "col"], "left").select("row", "col", F.coalesce("_new", F.col(seg).cast("long")).alias("seg"))
