"""Measures of polygons as expressions.

A geometry is an array of polygons; a polygon an array of rings, the shell first;
a ring a closed array of points (x, y). Sums run relative to a ring's first point,
which keeps them exact far from the origin. Null geometries give null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

GEOMETRY = "array<array<array<struct<x:double,y:double>>>>"

_CROSS = "((p.x - r[0].x) * (q.y - r[0].y) - (q.x - r[0].x) * (p.y - r[0].y))"
_STEPS = "slice(r, 1, greatest(size(r) - 1, 0)), slice(r, 2, greatest(size(r) - 1, 0))"
_RING_AREA = f"abs(aggregate(zip_with({_STEPS}, (p, q) -> {_CROSS}), 0D, (s, v) -> s + v)) / 2"
_RING_LENGTH = f"aggregate(zip_with({_STEPS}, (p, q) -> sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y))), 0D, (s, v) -> s + v)"


def _sum(g: str, ring: str, holes: str) -> str:
    """Over all polygons: the shell's value and, signed by ``holes``, that of each hole."""
    return f"aggregate(flatten(transform({g}, y -> transform(y, (r, i) -> CASE WHEN i = 0 THEN {ring} ELSE {holes}({ring}) END))), 0D, (s, v) -> s + v)"


def area(g: str) -> Column:
    """Shells less holes."""
    return F.expr(_sum(g, _RING_AREA, "-"))


def perimeter(g: str) -> Column:
    """Length of all rings, holes included."""
    return F.expr(_sum(g, _RING_LENGTH, "+"))


def centroid(g: str) -> Column:
    """Area-weighted centroid as struct (x, y); null without area."""
    part = (
        "transform(array({ring}), a -> a * CASE WHEN i = 0 THEN 1 ELSE -1 END)[0]"
    ).format(ring=_RING_AREA)
    moment = (
        "aggregate(zip_with({steps}, (p, q) -> (p.{d} + q.{d} - 2 * r[0].{d}) * {cross}), 0D, (s, v) -> s + v) / 6 "
        "* CASE WHEN aggregate(zip_with({steps}, (p, q) -> {cross}), 0D, (s, v) -> s + v) < 0 THEN -1 ELSE 1 END * CASE WHEN i = 0 THEN 1 ELSE -1 END + r[0].{d} * {part}"
    )
    parts = ", ".join(f"{moment.format(steps=_STEPS, d=d, cross=_CROSS, part=part)} AS {d}" for d in "xy")
    rings = f"flatten(transform({g}, y -> transform(y, (r, i) -> struct({part} AS a, {parts}))))"
    total = f"aggregate({rings}, struct(0D AS a, 0D AS x, 0D AS y), (s, v) -> struct(s.a + v.a AS a, s.x + v.x AS x, s.y + v.y AS y), s -> CASE WHEN s.a > 0 THEN struct(s.x / s.a AS x, s.y / s.a AS y) END)"
    return F.expr(total)


def bounds(g: str) -> Column:
    """Struct (minx, miny, maxx, maxy); nulls for an empty geometry."""
    points = f"flatten(flatten({g}))"
    return F.expr("struct(" + ", ".join(f"array_{f}(transform({points}, p -> p.{d})) AS {f}{d}" for f in ("min", "max") for d in "xy") + ")")


def is_empty(g: str) -> Column:
    return F.size(g) == 0


def geom_type(g: str) -> Column:
    return F.when(F.col(g).isNotNull(), F.when(F.size(g) > 1, "MultiPolygon").otherwise("Polygon"))


def z_order(x: str, y: str, size: float) -> Column:
    """Place of a point's grid cell along the Z-order curve: the bits of its column and row in turn."""
    cell = {n: f"((CAST(floor({c} / {size}D) AS BIGINT) + 1073741824L) & 2147483647L)" for n, c in (("i", x), ("j", y))}
    bits = " | ".join(f"shiftleft(shiftright({cell[n]}, k) & 1L, 2 * k + {at})" for at, n in enumerate("ij"))
    return F.expr(f"aggregate(sequence(0, 30), 0L, (s, k) -> s | {bits})")


def compactness(area_: str, perimeter_: str) -> Column:
    """4 pi A / P^2; null without a perimeter."""
    return F.when(F.col(perimeter_) > 0, 4 * F.pi() * F.col(area_) / F.pow(F.col(perimeter_), F.lit(2.0)))


def rectangularity(area_: str, box_area: str) -> Column:
    return F.when(F.col(box_area) > 0, F.col(area_) / F.col(box_area))


def elongation(width: str, height: str) -> Column:
    """Longer over shorter side of the box; null if a side is 0."""
    return F.when(F.least(width, height) > 0, F.greatest(width, height) / F.least(width, height))


def _each_point(g: str, point: str) -> Column:
    return F.expr(f"transform({g}, y -> transform(y, r -> transform(r, p -> {point})))")


RADIUS = 6378137.0


def to_mercator(g: str) -> Column:
    """Longitude and latitude in degrees to Web Mercator metres (EPSG 4326 to 3857)."""
    return _each_point(g, f"struct(radians(p.x) * {RADIUS}D AS x, ln(tan(pi() / 4 + radians(p.y) / 2)) * {RADIUS}D AS y)")


def mercator_to_degrees(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / RADIUS), F.degrees(2 * F.atan(F.exp(y / RADIUS)) - F.pi() / 2)


# WGS 84 ellipsoid, and the series in its third flattening that transverse Mercator needs (Krueger, to the fourth order).
_F = 1 / 298.257223563
_N = _F / (2 - _F)
_A = RADIUS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_FORWARD = [_N / 2 - 2 / 3 * _N**2 + 5 / 16 * _N**3 + 41 / 180 * _N**4, 13 / 48 * _N**2 - 3 / 5 * _N**3 + 557 / 1440 * _N**4, 61 / 240 * _N**3 - 103 / 140 * _N**4, 49561 / 161280 * _N**4]
_BACK = [_N / 2 - 2 / 3 * _N**2 + 37 / 96 * _N**3 - 1 / 360 * _N**4, 1 / 48 * _N**2 + 1 / 15 * _N**3 - 437 / 1440 * _N**4, 17 / 480 * _N**3 - 37 / 840 * _N**4, 4397 / 161280 * _N**4]
_LATITUDE = [2 * _N - 2 / 3 * _N**2 - 2 * _N**3 + 116 / 45 * _N**4, 7 / 3 * _N**2 - 8 / 5 * _N**3 - 227 / 45 * _N**4, 56 / 15 * _N**3 - 136 / 35 * _N**4, 4279 / 630 * _N**4]
SCALE, EASTING = 0.9996, 500_000.0
_ECC = math.sqrt(_F * (2 - _F))


def degrees_to_utm(lon: Column, lat: Column, zone: int = 35) -> tuple[Column, Column]:
    """Easting and northing in a northern UTM zone (zone 35: EPSG 32635)."""
    phi, lam = F.radians(lat), F.radians(lon - F.lit(6.0 * zone - 183.0))
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - _ECC * F.atanh(_ECC * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for k, a in enumerate(_FORWARD, start=1):
        x = x + a * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
        y = y + a * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
    return EASTING + SCALE * _A * x, SCALE * _A * y


def utm_to_degrees(x: Column, y: Column, zone: int = 35) -> tuple[Column, Column]:
    """Longitude and latitude of a northern UTM zone's easting and northing."""
    xi, eta = y / (SCALE * _A), (x - EASTING) / (SCALE * _A)
    u, v = xi, eta
    for k, b in enumerate(_BACK, start=1):
        u = u - b * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
        v = v - b * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
    chi = F.asin(F.sin(u) / F.cosh(v))
    lat = chi
    for k, d in enumerate(_LATITUDE, start=1):
        lat = lat + d * F.sin(2 * k * chi)
    return F.degrees(F.atan2(F.sinh(v), F.cos(u))) + F.lit(6.0 * zone - 183.0), F.degrees(lat)


def mercator_to_utm(g: str, zone: int = 35) -> Column:
    """Web Mercator to UTM, point by point."""

    def point(p: Column) -> Column:
        x, y = degrees_to_utm(*mercator_to_degrees(p["x"], p["y"]), zone)
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(F.col(g), lambda poly: F.transform(poly, lambda ring: F.transform(ring, point)))


def signature(kind: str, area_: str, *box: str, digits: int = 2) -> Column:
    """Type, area and bounds in one text, rounded half to even; equal for equal shapes."""
    rounded = [(F.rint(F.col(c) * 10**digits) / 10**digits).cast("string") for c in (area_, *box)]
    return F.concat_ws("|", kind, *rounded)


def wkt_token(wkt: str) -> Column:
    """First word of a WKT text."""
    return F.element_at(F.split(F.trim(F.col(wkt)), r"\s+"), 1)
