"""Grid metadata of pixel tables, areas of pixels, and the step from coordinates to pixels."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS-84, as the area formulas of pixels and of whole rasters take them.
SEMI_MAJOR, ECCENTRICITY, FLATTENING = 6378137.0, 0.081819190842622, 1 / 298.257223563


@dataclass(frozen=True)
class GridSpec:
    """Rows and columns of a raster and its affine transform (x = a col + b row + c, y = d col + e row + f)."""

    height: int
    width: int
    a: float
    b: float
    c: float
    d: float
    e: float
    f: float
    epsg: int

    @property
    def geographic(self) -> bool:
        return self.epsg == 4326

    def assert_aligned(self, *others: GridSpec, tolerance: float = 1e-4) -> None:
        for o in others:
            if (o.height, o.width, o.epsg) != (self.height, self.width, self.epsg):
                raise ValueError(f"grids differ: {self} and {o}")
            if any(abs(getattr(self, k) - getattr(o, k)) > tolerance for k in "abcdef"):
                raise ValueError(f"transforms differ: {self} and {o}")

    def pixel_area_ha(self, row: Column | None = None) -> Column:
        """Hectares of a pixel: constant on a projected grid, by the latitude of the row's centre on a geographic one."""
        if not self.geographic:
            return F.lit(abs(self.a * self.e) / 1e4)
        lat = F.radians(F.lit(self.f) + ((F.col("row") if row is None else row) + 0.5) * self.e)
        e2 = ECCENTRICITY**2
        d = 1 - F.lit(e2) * F.sin(lat) * F.sin(lat)
        meridian = F.lit(SEMI_MAJOR * (1 - e2)) / (d * F.sqrt(d)) * math.radians(abs(self.e))
        parallel = F.lit(SEMI_MAJOR) / F.sqrt(d) * F.cos(lat) * math.radians(abs(self.a))
        return meridian * parallel / 1e4

    def mean_pixel_area_m2(self) -> float:
        """Square metres of a pixel at the raster's centre."""
        if not self.geographic:
            return abs(self.a * self.e)
        lat = math.radians(self.f + self.height / 2 * self.e)
        e2 = FLATTENING * (2 - FLATTENING)
        d = 1 - e2 * math.sin(lat) ** 2
        return SEMI_MAJOR * (1 - e2) / d**1.5 * math.radians(abs(self.e)) * SEMI_MAJOR / math.sqrt(d) * math.cos(lat) * math.radians(abs(self.a))

    def pixel_of(self, x: Column, y: Column) -> tuple[Column, Column]:
        """(row, col) of the pixel that holds a point; unrotated grids only."""
        if self.b or self.d:
            raise ValueError("rotated grids have no simple pixel lookup")
        return F.floor((y - self.f) / self.e).cast("long"), F.floor((x - self.c) / self.a).cast("long")

    def centre_of(self, row: Column, col: Column) -> tuple[Column, Column]:
        return (col + 0.5) * self.a + self.c, (row + 0.5) * self.e + self.f

    def inside(self, row: Column, col: Column) -> Column:
        return row.between(0, self.height - 1) & col.between(0, self.width - 1)


UTM = GridSpec(1500, 100, 10.0, 0.0, 500000.0, 0.0, -10.0, 9000000.0, 32751)
LONLAT = GridSpec(1500, 100, 0.0001, 0.0, 125.0, 0.0, -0.0001, -8.5, 4326)
