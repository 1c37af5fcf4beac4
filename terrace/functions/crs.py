"""Between geographic coordinates and projections of WGS-84, as columns: UTM (Krüger's series to the third order in the third flattening), Albers' conic and Lambert's cylindrical equal-area projections."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrace.grid import FLATTENING, SEMI_MAJOR

_N = FLATTENING / (2 - FLATTENING)
_A = SEMI_MAJOR / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)
SCALE, EASTING, NORTHING = 0.9996, 500000.0, 10000000.0


# Codes of equal-area projections of WGS-84. Conic ones: latitude and longitude of the origin, standard parallels
# (North America is left out: its datum is another); cylindrical ones: the standard parallel.
ALBERS = {102022: (0.0, 25.0, 20.0, -23.0), 102025: (30.0, 95.0, 15.0, 65.0), 102028: (-15.0, 125.0, 7.0, -32.0)}
CYLINDRICAL = {6933: 30.0}
_E2 = FLATTENING * (2 - FLATTENING)
_E = math.sqrt(_E2)
# Coefficients of the series from the authalic latitude.
_AUTHALIC = (_E2 / 3 + 31 * _E2**2 / 180 + 517 * _E2**3 / 5040, 23 * _E2**2 / 360 + 251 * _E2**3 / 3780, 761 * _E2**3 / 45360)


def zone_of(epsg: int) -> tuple[int, bool]:
    """(zone, south) of an EPSG code of UTM on WGS-84."""
    if 32601 <= epsg <= 32660:
        return epsg - 32600, False
    if 32701 <= epsg <= 32760:
        return epsg - 32700, True
    raise ValueError(f"{epsg} is neither 4326, UTM on WGS-84 nor one of {sorted([*ALBERS, *CYLINDRICAL])}")


def to_utm(lon: Column, lat: Column, epsg: int) -> tuple[Column, Column]:
    zone, south = zone_of(epsg)
    phi, lam = F.radians(lat), F.radians(lon - (6 * zone - 183))
    c = 2 * math.sqrt(_N) / (1 + _N)
    sin = F.sin(phi)
    atanh = lambda x: 0.5 * F.log((1 + x) / (1 - x))
    t = F.sinh(atanh(sin) - c * atanh(c * sin))
    xi, eta = F.atan2(t, F.cos(lam)), atanh(F.sin(lam) / F.sqrt(1 + t * t))
    e = eta + sum(a * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, a in enumerate(_ALPHA, 1))
    n = xi + sum(a * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, a in enumerate(_ALPHA, 1))
    return EASTING + SCALE * _A * e, (NORTHING if south else 0.0) + SCALE * _A * n


def to_lonlat(x: Column, y: Column, epsg: int) -> tuple[Column, Column]:
    zone, south = zone_of(epsg)
    xi, eta = (y - (NORTHING if south else 0.0)) / (SCALE * _A), (x - EASTING) / (SCALE * _A)
    a = xi - sum(b * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, b in enumerate(_BETA, 1))
    b = eta - sum(b * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, b in enumerate(_BETA, 1))
    chi = F.asin(F.sin(a) / F.cosh(b))
    phi = chi + sum(d * F.sin(2 * j * chi) for j, d in enumerate(_DELTA, 1))
    return F.lit(6.0 * zone - 183) + F.degrees(F.atan2(F.sinh(b), F.cos(a))), F.degrees(phi)


def _q(sin, log):
    """The area from the equator to a latitude, by its sine, on the unit ellipsoid."""
    return (1 - _E2) * (sin / (1 - _E2 * sin * sin) - log((1 - _E * sin) / (1 + _E * sin)) / (2 * _E))


def _latitude(q: Column) -> Column:
    """The latitude (in radians) of an area."""
    beta = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), q / _q(1.0, math.log))))
    return beta + sum(c * F.sin(2 * k * beta) for k, c in enumerate(_AUTHALIC, 1))


def _cone(code: int) -> tuple[float, float, float, float]:
    """(n, C, radius of the origin's parallel, longitude of the origin) of an Albers projection."""
    origin, middle, first, second = ALBERS[code]
    sine = lambda deg: math.sin(math.radians(deg))
    m = lambda deg: math.cos(math.radians(deg)) / math.sqrt(1 - _E2 * sine(deg) ** 2)
    n = (m(first) ** 2 - m(second) ** 2) / (_q(sine(second), math.log) - _q(sine(first), math.log))
    c = m(first) ** 2 + n * _q(sine(first), math.log)
    return n, c, SEMI_MAJOR * math.sqrt(c - n * _q(sine(origin), math.log)) / n, middle


def _scale(code: int) -> float:
    at = math.radians(CYLINDRICAL[code])
    return math.cos(at) / math.sqrt(1 - _E2 * math.sin(at) ** 2)


def to_equal_area(lon: Column, lat: Column, code: int) -> tuple[Column, Column]:
    q = _q(F.sin(F.radians(lat)), F.log)
    if code in CYLINDRICAL:
        return SEMI_MAJOR * _scale(code) * F.radians(lon), SEMI_MAJOR * q / (2 * _scale(code))
    n, c, origin, middle = _cone(code)
    rho, theta = SEMI_MAJOR * F.sqrt(F.greatest(c - n * q, F.lit(0.0))) / n, n * F.radians(lon - middle)
    return rho * F.sin(theta), origin - rho * F.cos(theta)


def from_equal_area(x: Column, y: Column, code: int) -> tuple[Column, Column]:
    if code in CYLINDRICAL:
        return F.degrees(x / (SEMI_MAJOR * _scale(code))), F.degrees(_latitude(2 * y * _scale(code) / SEMI_MAJOR))
    n, c, origin, middle = _cone(code)
    sign = 1.0 if n > 0 else -1.0
    rho = F.hypot(x, origin - y)
    return middle + F.degrees(F.atan2(sign * x, sign * (origin - y)) / n), F.degrees(_latitude((c - (rho * n / SEMI_MAJOR) ** 2) / n))


def reproject(x: Column, y: Column, source: int, target: int) -> tuple[Column, Column]:
    """Coordinates of one code in another; 4326 is longitude and latitude."""
    if source == target:
        return x, y
    equal_area = ALBERS.keys() | CYLINDRICAL.keys()
    lon, lat = (x, y) if source == 4326 else from_equal_area(x, y, source) if source in equal_area else to_lonlat(x, y, source)
    return (lon, lat) if target == 4326 else to_equal_area(lon, lat, target) if target in equal_area else to_utm(lon, lat, target)


def reproject_box(box: tuple[float, float, float, float], source: int, target: int, steps: int = 21) -> tuple[float, float, float, float]:
    """The box (west, south, east, north) around a box's edges in another system, by points along them."""
    if source == target:
        return box
    from pyspark.sql import SparkSession

    west, south, east, north = box
    at = [k / (steps - 1) for k in range(steps)]
    edge = [(west + t * (east - west), y) for t in at for y in (south, north)] + [(x, south + t * (north - south)) for t in at for x in (west, east)]
    rows = SparkSession.getActiveSession().createDataFrame(edge, "x double, y double")
    x, y = reproject(F.col("x"), F.col("y"), source, target)
    return tuple(rows.select(x.alias("x"), y.alias("y")).agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first())
