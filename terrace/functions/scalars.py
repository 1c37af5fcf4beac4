"""Pointwise functions: indices, logits, choices among class probabilities, quality masks, harmonics."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names under which bands are known.
ALIASES = {
    "blue": ("blue", "B02"), "green": ("green", "B03"), "red": ("red", "B04"), "nir": ("nir", "nir08", "B08"),
    "swir1": ("swir1", "swir16", "B11"), "swir2": ("swir2", "swir22", "B12"),
}


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.when(b != 0, a / b)


def band(name: str, columns: list[str]) -> Column:
    for alias in ALIASES[name]:
        if alias in columns:
            return F.col(alias).cast("double")
    raise ValueError(f"no band {name} among {columns}")


def spectral_index(name: str, columns: list[str]) -> Column:
    """NDVI, NDWI, MNDWI, NDBI, EVI or SAVI of the bands among columns; null where its denominator is 0."""
    b = lambda x: band(x, columns)
    normalised = lambda x, y: ratio(b(x) - b(y), b(x) + b(y))
    makers = {
        "NDVI": lambda: normalised("nir", "red"), "NDWI": lambda: normalised("green", "nir"), "MNDWI": lambda: normalised("green", "swir1"), "NDBI": lambda: normalised("swir1", "nir"),
        "EVI": lambda: ratio(2.5 * (b("nir") - b("red")), b("nir") + 6 * b("red") - 7.5 * b("blue") + 1), "SAVI": lambda: ratio(1.5 * (b("nir") - b("red")), b("nir") + b("red") + 0.5),
    }
    if name.upper() not in makers:
        raise ValueError(f"unknown index {name}")
    return makers[name.upper()]()


def to_logits(p: Column, eps: float = 1e-3) -> Column:
    """Logits of an array of probabilities, held within eps of 0 and 1; infinite values stop the query."""
    def one(x: Column) -> Column:
        c = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), x))
        return F.when(x.isNull() | F.isnan(x), F.lit(None).cast("double")).when(F.abs(x) == float("inf"), F.raise_error(F.lit("infinite probability")).cast("double")).otherwise(F.log(c) - F.log1p(-c))

    return F.transform(p, one)


def to_probs(logits: Column, normalize: bool = True) -> Column:
    """The logistic function of each, divided by their sum."""
    each = F.transform(logits, lambda x: 1 / (1 + F.exp(-x)))
    if not normalize:
        return each
    total = F.aggregate(each, F.lit(0.0), lambda a, x: a + x)
    return F.transform(each, lambda x: F.when(total > 0, x / total))


def argmax(p: Column, values: list[int] | None = None) -> Column:
    """The first index (from 0), or its value, of the largest finite entry; -1 if none is finite."""
    clean = F.transform(p, lambda x: F.when(finite(x), x))
    at = F.when(F.exists(clean, lambda x: x.isNotNull()), F.array_position(clean, F.array_max(clean)).cast("int") - 1).otherwise(-1)
    return F.when(at >= 0, F.try_element_at(F.array(*map(F.lit, values)), at + 1)).otherwise(-1) if values else at


def top_two(p: Column) -> Column:
    """struct(w, wi, s, si): the largest and second largest of an array of non-negative values with their indices from 1; the earlier wins ties."""
    start = F.struct(F.lit(0.0).alias("w"), F.lit(0).alias("wi"), F.lit(0.0).alias("s"), F.lit(0).alias("si"))
    items = F.transform(p, lambda x, i: F.struct(x.cast("double").alias("v"), (i + 1).cast("int").alias("i")))

    def step(a: Column, x: Column) -> Column:
        best, second = x["v"] > a["w"], x["v"] > a["s"]
        return F.struct(
            F.when(best, x["v"]).otherwise(a["w"]).alias("w"), F.when(best, x["i"]).otherwise(a["wi"]).alias("wi"),
            F.when(best, a["w"]).when(second, x["v"]).otherwise(a["s"]).alias("s"), F.when(best, a["wi"]).when(second, x["i"]).otherwise(a["si"]).alias("si"),
        )

    return F.aggregate(items, start, step)


def confusion_index(w: Column, s: Column) -> Column:
    """Second over first, from 0 to 1; 0 where the first is (nearly) 0."""
    return F.when(w > 1e-4, F.greatest(F.lit(0.0), F.least(F.lit(1.0), s / w))).otherwise(0.0)


def bits_clear(qa: Column, bits: tuple[int, ...] = (1, 2, 3, 4)) -> Column:
    """Whether none of these bits of a quality band is set."""
    return qa.bitwiseAND(F.lit(sum(1 << b for b in bits))) == 0


# Scale and offset of surface reflectance and temperature bands.
OPTICAL, THERMAL = (0.0000275, -0.2), (0.00341802, 149.0)


def scaled(c: Column, kind: tuple[float, float]) -> Column:
    return c * kind[0] + kind[1]


def harmonic(coefs: Column, t: Column, start: Column, end: Column, scale: float = 1.0) -> Column:
    """The value at t (held within the segment) of an 8-term harmonic: constant, slope, cosine and sine of 1, 2 and 3 turns a year."""
    at = F.least(F.greatest(t, start), end)
    terms = [F.lit(1.0), at] + [f(at * (2 * math.pi * k)) for k in (1, 2, 3) for f in (F.cos, F.sin)]
    return F.aggregate(F.zip_with(coefs, F.array(*terms), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x) / scale


def synthetic(value: Column, gap: Column, tolerance: float) -> Column:
    """A synthetic reflectance that is near enough to its segment and plausible, else null."""
    return F.when((gap <= tolerance) & (value > -0.05) & (value < 1.5), value)


def amplitude_phase(a1: Column, b1: Column) -> tuple[Column, Column]:
    return F.hypot(a1, b1), F.atan2(b1, a1)


def stretch(x: Column, low: Column, high: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - low) / (high - low + 1e-9)))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
