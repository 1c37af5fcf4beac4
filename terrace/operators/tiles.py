"""Tiles of a raster with a margin of their neighbours' pixels: one shuffle, then whole windows in numpy."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE = 256


def apply_tiles(pixels: DataFrame, run: Callable[[Tile, pd.DataFrame], pd.DataFrame], schema: str, *, halo: int, tile: int = TILE, by: tuple[str, ...] = ()) -> DataFrame:
    """run on each tile and value of by: its pixels (row, col and others) and those within halo. A pixel near an edge goes to up to four tiles."""
    at = lambda c: F.explode(F.sequence(F.floor((F.col(c) - halo) / tile), F.floor((F.col(c) + halo) / tile)))
    dealt = pixels.withColumn("_tr", at("row")).withColumn("_tc", at("col"))

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return run(Tile(int(key[0]), int(key[1]), tile, halo, pdf), pdf)

    return dealt.groupBy("_tr", "_tc", *by).applyInPandas(one, schema)


class Tile:
    """Where the pixels of a tile and its margin are in an array of them."""

    def __init__(self, tr: int, tc: int, tile: int, halo: int, pdf: pd.DataFrame) -> None:
        row, col = pdf["row"].to_numpy() - tr * tile + halo, pdf["col"].to_numpy() - tc * tile + halo
        # No larger than what the pixels span.
        self.r, self.c = row - row.min(), col - col.min()
        self.shape = int(self.r.max()) + 1, int(self.c.max()) + 1
        self.inner = (row >= halo) & (row < halo + tile) & (col >= halo) & (col < halo + tile)

    def grid(self, values: np.ndarray, fill: float = np.nan) -> np.ndarray:
        out = np.full(self.shape, fill, np.asarray(values).dtype if not isinstance(fill, float) else float)
        out[self.r, self.c] = values
        return out

    def take(self, grid: np.ndarray) -> np.ndarray:
        """The grid's values at the tile's own pixels."""
        return grid[self.r[self.inner], self.c[self.inner]]


def with_lists(pdf: pd.DataFrame, name: str, rows: np.ndarray) -> pd.DataFrame:
    """pdf with a column of arrays, one for each row; no rows are fine."""
    return pdf.assign(**{name: pd.Series(list(rows), index=pdf.index, dtype=object)})


def windows(grid: np.ndarray, radius: int, fill: float = np.nan) -> np.ndarray:
    """rows x columns x window: what each pixel's square window holds, fill beyond the edges."""
    side = 2 * radius + 1
    padded = np.pad(grid, radius, constant_values=fill)
    return np.lib.stride_tricks.sliding_window_view(padded, (side, side)).reshape(*grid.shape, side * side)


def selected_mean_variance(v: np.ndarray, window: int, at: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population variance of those neighbours that reach the percentile `at` of their own windows; NaN where there is none."""
    ranked = np.sort(windows(v, window // 2), -1)  # NaN last
    n = np.isfinite(ranked).sum(-1)
    place = at * np.maximum(n - 1, 0)
    low = np.floor(place).astype(int)
    high = np.minimum(low + 1, np.maximum(n - 1, 0))
    a, b = np.take_along_axis(ranked, low[..., None], -1)[..., 0], np.take_along_axis(ranked, high[..., None], -1)[..., 0]
    limit = np.where(place == low, a, (low + 1 - place) * a + (place - low) * b)
    del ranked
    with np.errstate(invalid="ignore", divide="ignore"):
        near = windows(np.where(v >= limit, v, np.nan), window // 2)
        many = np.isfinite(near).sum(-1)
        mean = np.nansum(near, -1) / many
        var = np.nansum((near - mean[..., None]) ** 2, -1) / many
    return mean, var


def mode_of_windows(cur: np.ndarray, classes: np.ndarray, empty: int) -> np.ndarray:
    """The most frequent class of each 3 by 3 window (of equals the first in classes); empty where it has none."""
    best, most = np.full(cur.shape, empty, cur.dtype), np.zeros(cur.shape, np.int64)
    for c in classes:
        own = np.pad((cur == c).astype(np.int64), 1)
        rows = own[:-2] + own[1:-1] + own[2:]
        votes = rows[:, :-2] + rows[:, 1:-1] + rows[:, 2:]
        more = votes > most
        best[more], most[more] = c, votes[more]
    return best
