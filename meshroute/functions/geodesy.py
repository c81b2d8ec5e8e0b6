"""Distances, units and rounding as column expressions; each stays inside whole-stage code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Earth radii by unit, units in one kilometre, and the flattening of the ellipsoid.
RADIUS = {"km": 6371, "m": 6371000, "mi": 3959, "ft": 3959 * 5280}
PER_KM = {"mi": 0.621371, "m": 1000, "ft": 3280.84, "km": 1}
FLATTENING = 1 / 298.257223563
KM_PER_DEGREE = 111
RULER_HEURISTIC = 0.9

_E2 = FLATTENING * (2 - FLATTENING)
_RAD = math.pi / 180


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x) if isinstance(x, (int, float)) else F.col(x)


def haversine(lat1, lon1, lat2, lon2, units: str = "km", circuity: float = 1) -> Column:
    """Great-circle distance; an unknown unit counts as km."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    half = lambda a, b: F.pow(F.sin((b - a) * (_RAD / 2)), F.lit(2.0))
    root = half(lat1, lat2) + F.cos(lat1 * _RAD) * F.cos(lat2 * _RAD) * half(lon1, lon2)
    return 2 * F.asin(F.sqrt(F.least(root, F.lit(1.0)))) * float(RADIUS.get(units, RADIUS["km"])) * float(circuity)


def cheap_ruler(lat1, lon1, lat2, lon2, units: str = "km", circuity: float = 1) -> Column:
    """Planar distance on the ellipsoid, scaled at the mid latitude; longitudes wrap."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    gap = F.abs(lon2 - lon1)
    gap = F.least(360 - gap, gap)
    cos = F.cos((lat1 + lat2) / 2 * _RAD)
    w2 = 1 / (1 - _E2 * (1 - cos * cos))
    w = F.sqrt(w2)
    m = _RAD * float(RADIUS.get(units, RADIUS["km"]))
    dx, dy = gap * (m * w * cos), (lat2 - lat1) * (m * w * w2 * (1 - _E2))
    return F.sqrt(dx * dx + dy * dy) * float(circuity)


def euclidean(x1, y1, x2, y2) -> Column:
    x1, y1, x2, y2 = map(_c, (x1, y1, x2, y2))
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def hard_round(places: int, a) -> Column:
    """Half away from zero, on the binary value."""
    a, scale = _c(a), float(10**places)
    return (a * scale + F.when(a > 0, 0.5).otherwise(-0.5)).cast("bigint") / F.lit(scale)


def convert(distance, have: str, want: str) -> Column:
    for u in (have, want):
        if u not in PER_KM:
            raise ValueError(f"unknown unit {u!r}; known: {sorted(PER_KM)}")
    return _c(distance) / float(PER_KM[have]) * float(PER_KM[want])


def bound_between(lat1, lon1, lat2, lon2) -> Column:
    """Degrees of latitude and longitude that cover the way between two points."""
    return haversine(lat1, lon1, lat2, lon2) / KM_PER_DEGREE


def wrap(threshold: float, a) -> Column:
    """Sign-preserving modulo: a multiple of the threshold becomes zero."""
    a = _c(a)
    return F.signum(a) * (F.abs(a) % float(threshold))


def wrapped_point(lat, lon, precision: int) -> Column:
    """struct(lat, lon), rounded and wrapped into (-90, 90) and (-180, 180)."""
    return F.struct(wrap(90, F.round(_c(lat), precision)).alias("lat"), wrap(180, F.round(_c(lon), precision)).alias("lon"))


def coordinates(points, form: str = "list_of_lists") -> Column:
    """An array of struct(lat, lon) as lists, lists with the longitude first, or dicts."""
    points = _c(points)
    if form == "list_of_lists":
        return F.transform(points, lambda p: F.array(p["lat"], p["lon"]))
    if form == "list_of_lists_long_first":
        return F.transform(points, lambda p: F.array(p["lon"], p["lat"]))
    if form == "list_of_dicts":
        return F.transform(points, lambda p: F.struct(p["lat"].alias("latitude"), p["lon"].alias("longitude")))
    raise ValueError(f"unknown form {form!r}")


def triangle_area(x1, y1, x2, y2, x3, y3) -> Column:
    """Twice the area of a triangle."""
    x1, y1, x2, y2, x3, y3 = map(_c, (x1, y1, x2, y2, x3, y3))
    return F.abs((x2 - x1) * (y3 - y1) - (x3 - x1) * (y2 - y1))


def shorter_edge_squared(x1, y1, x2, y2, x3, y3) -> Column:
    """The square of the shorter of the two edges at the middle point."""
    x1, y1, x2, y2, x3, y3 = map(_c, (x1, y1, x2, y2, x3, y3))
    return F.least((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2), (x3 - x2) * (x3 - x2) + (y3 - y2) * (y3 - y2))


def area_plus_edge(*p) -> Column:
    return triangle_area(*p) + shorter_edge_squared(*p)


def valid_point(lat, lon) -> Column:
    lat, lon = _c(lat), _c(lon)
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))
