"""Areas and counts of classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.grid import GridSpec


def class_name(cls: Column, names: dict[int, str]) -> Column:
    """The name of a class, or "Class N"."""
    if not names:
        return F.concat(F.lit("Class "), cls.cast("string"))
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(table, cls.cast("int")), F.concat(F.lit("Class "), cls.cast("string")))


def checked_class(cls: Column) -> Column:
    """cls, if it is a whole number from 0 to 255; else the query stops."""
    ok = (cls == F.floor(cls)) & cls.between(0, 255)
    return F.when(cls.isNull() | ok, cls).otherwise(F.raise_error(F.concat(F.lit("not a class: "), cls.cast("string"))))


def class_area(pixels: DataFrame, grid: GridSpec, names: dict[int, str] | None = None, cls: str = "cls", nodata: int = 0) -> DataFrame:
    """cls, class_name, n_pixels, area_ha (4 places) in order of class; null, 0 and nodata count for nothing."""
    c = checked_class(F.col(cls))
    own = pixels.where(c.isNotNull() & (c != 0) & (c != nodata)).withColumn("_cls", c.cast("int"))
    done = own.groupBy("_cls").agg(F.count(F.lit(1)).alias("n_pixels"), F.sum(grid.pixel_area_ha()).alias("_ha"))
    return done.select(F.col("_cls").alias("cls"), class_name(F.col("_cls"), names or {}).alias("class_name"), "n_pixels", F.bround("_ha", 4).alias("area_ha")).orderBy("cls")


def remap(cls: Column, mapping: dict[int, int]) -> Column:
    """One step of a mapping of classes."""
    if not mapping:
        return cls
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.try_element_at(table, cls.cast("int")), cls)


def remap_chain(cls: Column, mapping: dict[int, int]) -> Column:
    """A mapping applied entry by entry, in its order: what one entry makes the next may map again."""
    out = cls.cast("int")
    for a, b in mapping.items():
        out = F.when(out == a, F.lit(b)).otherwise(out)
    return out


def pixel_counts(pixels: DataFrame, mapping: dict[int, int] | None = None, cls: str = "cls", nodata: tuple[int, ...] = (0, -1, 255)) -> DataFrame:
    """cls, n_pixels after the values of nodata are left out and the rest is mapped."""
    own = pixels.where(F.col(cls).isNotNull() & ~F.col(cls).isin(*nodata))
    return own.groupBy(remap(F.col(cls), mapping or {}).cast("int").alias("cls")).agg(F.count(F.lit(1)).alias("n_pixels"))


def class_distribution(samples: DataFrame, label: str) -> DataFrame:
    """label, n: the most frequent first."""
    return samples.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), label)
