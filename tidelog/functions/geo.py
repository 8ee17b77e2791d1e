"""Points, distances and shapes on the globe."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
DEGREE_M = 111_319.9
UNITS = {"m": 1.0, "km": 1000.0, "mi": 1609.344, "miles": 1609.344, "yd": 0.9144, "ft": 0.3048, "nmi": 1852.0, "nm": 1852.0, "cm": 0.01, "mm": 0.001, "": 1.0}


def parse_distance(text: str) -> float:
    """Metres of ``12km``, ``3.5mi``, ``800``."""
    m = re.fullmatch(r"\s*([0-9.]+)\s*([a-z]*)\s*", text.lower())
    if not m or m[2] not in UNITS:
        raise ValueError(f"not a distance: {text!r}")
    return float(m[1]) * UNITS[m[2]]


def parse_point(value) -> tuple[float, float]:
    """(lat, lon) of {"lat", "lon"}, "lat,lon" or [lon, lat]; out of range: ValueError."""
    if isinstance(value, dict):
        lat, lon = value["lat"], value["lon"]
    elif isinstance(value, str):
        lat, lon = value.split(",")
    else:
        lon, lat = value
    lat, lon = float(lat), float(lon)
    if not (-90 <= lat <= 90 and -180 <= lon <= 180):
        raise ValueError(f"not on the globe: {lat}, {lon}")
    return lat, lon


def haversine(lat: Column, lon: Column, to_lat: float, to_lon: float) -> Column:
    dlat, dlon = F.radians(F.lit(to_lat) - lat), F.radians(F.lit(to_lon) - lon)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat)) * math.cos(math.radians(to_lat)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def plane(lat: Column, lon: Column, to_lat: float, to_lon: float) -> Column:
    x = (F.lit(to_lon) - lon) * F.cos(F.radians((lat + to_lat) / 2))
    return DEGREE_M * F.sqrt(F.pow(F.lit(to_lat) - lat, 2) + F.pow(x, 2))


def in_box(lat: Column, lon: Column, top: float, left: float, bottom: float, right: float) -> Column:
    """Inclusive; a box whose left is east of its right crosses the antimeridian."""
    across = (lon >= left) | (lon <= right) if left > right else lon.between(left, right)
    return lat.between(bottom, top) & across


def within(lat: Column, lon: Column, to_lat: float, to_lon: float, metres: float, *, arc: bool = True, bbox_only: bool = False) -> Column:
    """A box that the scan can use, then the exact distance."""
    d = metres / DEGREE_M * 1.01
    wide = d / max(0.01, math.cos(math.radians(min(89.9, abs(to_lat) + d))))
    left, right = to_lon - wide, to_lon + wide
    if wide >= 180 or abs(to_lat) + d >= 90:
        box = lat.between(to_lat - d, to_lat + d)
    else:
        box = in_box(lat, lon, to_lat + d, left + 360 if left < -180 else left, to_lat - d, right - 360 if right > 180 else right)
    if bbox_only:
        return box
    return box & ((haversine if arc else plane)(lat, lon, to_lat, to_lon) <= metres)


def in_polygon(lat: Column, lon: Column, points: list[tuple[float, float]], *, bbox_only: bool = False) -> Column:
    """Whether a point lies in the polygon of (lat, lon): an odd number of edges lies east of it. Fewer than 3 points: ValueError."""
    if len(points) < 3:
        raise ValueError("a polygon needs three points")
    lats, lons = zip(*points, strict=True)
    box = lat.between(min(lats), max(lats)) & lon.between(min(lons), max(lons))
    if bbox_only:
        return box
    crossings = F.lit(0)
    for (a_lat, a_lon), (b_lat, b_lon) in zip(points, [*points[1:], points[0]], strict=True):
        if a_lat != b_lat:
            spans = (F.lit(a_lat) > lat) != (F.lit(b_lat) > lat)
            at = (lat - a_lat) * ((b_lon - a_lon) / (b_lat - a_lat)) + a_lon
            crossings = crossings + F.when(spans & (lon < at), 1).otherwise(0)
    return box & (crossings % 2 == 1)
