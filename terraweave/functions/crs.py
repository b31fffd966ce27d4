"""Coordinate reference systems in closed form, as Columns: EPSG 4326, 3857, 326xx / 327xx (UTM) and 2100.

An unknown code raises. Coordinates are in the order longitude, latitude.
"""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

from terraweave.functions import geometry

RADIUS = 6378137.0
FLATTENING = 1 / 298.257223563
#: Shift from GGRS87 to WGS84 in metres.
GGRS_SHIFT = (-199.87, 74.79, 246.62)


def _tm(srid: int) -> tuple[float, float, float, float] | None:
    """Central meridian, scale, false easting and northing."""
    if 32601 <= srid <= 32660 or 32701 <= srid <= 32760:
        return (srid % 100) * 6 - 183.0, 0.9996, 500000.0, 0.0 if srid < 32700 else 10000000.0
    return (24.0, 0.9996, 500000.0, 0.0) if srid == 2100 else None


def _series() -> tuple[float, list[float], list[float], list[float]]:
    n = FLATTENING / (2 - FLATTENING)
    a = RADIUS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480]
    delta = [2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15]
    return a, alpha, beta, delta


def _xy(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def _geocentric(p: Column, shift: tuple[float, float, float]) -> Column:
    e2 = FLATTENING * (2 - FLATTENING)
    lon, lat = F.radians(p["x"]), F.radians(p["y"])
    n = RADIUS / F.sqrt(1 - e2 * F.sin(lat) * F.sin(lat))
    x, y, z = n * F.cos(lat) * F.cos(lon) + shift[0], n * F.cos(lat) * F.sin(lon) + shift[1], n * (1 - e2) * F.sin(lat) + shift[2]
    b = RADIUS * (1 - FLATTENING)
    r = F.sqrt(x * x + y * y)
    t = F.atan2(z * RADIUS, r * b)
    ep2 = e2 / (1 - e2)
    out = F.atan2(z + ep2 * b * F.pow(F.sin(t), F.lit(3.0)), r - e2 * RADIUS * F.pow(F.cos(t), F.lit(3.0)))
    return _xy(F.degrees(F.atan2(y, x)), F.degrees(out))


def _asinh(v: Column) -> Column:
    return F.log(v + F.sqrt(v * v + 1))


def _from_degrees(p: Column, srid: int) -> Column:
    if srid == 4326:
        return p
    if srid == 3857:
        return _xy(F.radians(p["x"]) * RADIUS, F.log(F.tan(F.radians(p["y"]) / 2 + F.lit(0.7853981633974483))) * RADIUS)
    tm = _tm(srid)
    if tm is None:
        raise ValueError(f"no formulas for EPSG:{srid}")
    if srid == 2100:
        return geometry.let(_geocentric(p, tuple(-s for s in GGRS_SHIFT)), lambda q: _mercator(q, tm))
    return _mercator(p, tm)


def _mercator(p: Column, tm: tuple[float, float, float, float]) -> Column:
    """Transverse Mercator of a point in degrees."""
    meridian, scale, east, north = tm
    a, alpha, _, _ = _series()
    n = FLATTENING / (2 - FLATTENING)
    k = 2 * sqrt(n) / (1 + n)
    lat, lon = F.radians(p["y"]), F.radians(p["x"] - meridian)
    s = F.sin(lat)
    atanh = lambda v: F.log((1 + v) / (1 - v)) / 2
    angles = geometry.let(F.sinh(atanh(s) - k * atanh(k * s)), lambda t: _xy(_asinh(F.sin(lon) / F.sqrt(t * t + F.cos(lon) * F.cos(lon))), F.atan2(t, F.cos(lon))))

    def series(v: Column) -> Column:
        x, y = v["x"], v["y"]
        for j, c in enumerate(alpha, 1):
            x = x + c * F.cos(2 * j * v["y"]) * F.sinh(2 * j * v["x"])
            y = y + c * F.sin(2 * j * v["y"]) * F.cosh(2 * j * v["x"])
        return _xy(east + scale * a * x, north + scale * a * y)

    return geometry.let(angles, series)


def _to_degrees(p: Column, srid: int) -> Column:
    if srid == 4326:
        return p
    if srid == 3857:
        return _xy(F.degrees(p["x"] / RADIUS), F.degrees(2 * F.atan(F.exp(p["y"] / RADIUS)) - F.lit(1.5707963267948966)))
    tm = _tm(srid)
    if tm is None:
        raise ValueError(f"no formulas for EPSG:{srid}")
    meridian, scale, east, north = tm
    a, _, beta, delta = _series()
    xi, eta = (p["y"] - north) / (scale * a), (p["x"] - east) / (scale * a)
    x1, e1 = xi, eta
    for j, c in enumerate(beta, 1):
        x1 = x1 - c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        e1 = e1 - c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)

    def latitude(chi: Column) -> Column:
        lat = chi
        for j, c in enumerate(delta, 1):
            lat = lat + c * F.sin(2 * j * chi)
        return F.degrees(lat)

    def degrees(v: Column) -> Column:
        lat = geometry.let(F.asin(F.sin(v["y"]) / F.cosh(v["x"])), latitude)
        return _xy(F.degrees(F.atan2(F.sinh(v["x"]), F.cos(v["y"]))) + meridian, lat)

    out = geometry.let(_xy(e1, x1), degrees)
    return geometry.let(out, lambda d: _geocentric(d, GGRS_SHIFT)) if srid == 2100 else out


def transform_point(p: Column, source: int, target: int) -> Column:
    return p if source == target else geometry.let(_to_degrees(p, source), lambda d: _from_degrees(d, target))


def transform(g: Column, source: int, target: int) -> Column:
    """A parsed geometry in another system."""
    return g if source == target else geometry.moved(g, lambda p: transform_point(p, source, target))


def flat(g: Column) -> Column:
    """A geometry in degrees laid out in metres around its own centroid (transverse Mercator)."""
    middle = F.floor((geometry.centroid(g)["x"] + 180) / 6) * 6 - 177.0
    return geometry.let(middle, lambda m: geometry.moved(g, lambda p: _from_degrees(_xy(p["x"] - m + 3.0, p["y"]), 32631)))
