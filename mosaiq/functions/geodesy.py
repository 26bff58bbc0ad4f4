"""Angles, rings, areas and map projections as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Radius of the Moon's sphere in metres, a fixed value of the data model.
MOON_RADIUS_M = 1_737_400.0


def lon_to_360(lon: Column) -> Column:
    return lon - F.floor(lon / 360) * 360


def lon_to_180(lon: Column) -> Column:
    return lon_to_360(lon + 180) - 180


def circular_distance(a: Column, b: Column) -> Column:
    """Least angle between two azimuths, 0..180 degrees."""
    d = F.abs(a - b) % 360
    return F.least(d, 360 - d)


def spherical_area_km2(ring: Column, radius_m: float = MOON_RADIUS_M) -> Column:
    """Area of a closed ring of struct(lat, lon) in degrees by the trapezoid of its edges."""
    n = F.size(ring)

    def term(p, i):
        q = ring[(i + 1) % n]
        return F.radians(q["lon"] - p["lon"]) * (2 + F.sin(F.radians(p["lat"])) + F.sin(F.radians(q["lat"])))

    return F.abs(F.aggregate(F.transform(ring, term), F.lit(0.0), lambda a, x: a + x)) * (radius_m * radius_m / 2 / 1e6)


def point_in_ring(lat: Column, lon: Column, ring: Column) -> Column:
    """Crossing number of a ring of struct(lat, lon); edges run from the vertex before."""
    n = F.size(ring)

    def crosses(p, i):
        q = ring[(i + n - 1) % n]
        at = (q["lon"] - p["lon"]) * (lat - p["lat"]) / (q["lat"] - p["lat"]) + p["lon"]
        return ((p["lat"] > lat) != (q["lat"] > lat)) & (lon < at)

    return F.size(F.filter(ring, crosses)) % 2 == 1


def wkt_polygon(ring: Column) -> Column:
    """POLYGON text, longitude first, nine decimals, the first vertex repeated at the end."""
    closed = F.concat(ring, F.slice(ring, 1, 1))
    return F.concat(F.lit("POLYGON (("), F.array_join(F.transform(closed, lambda p: F.format_string("%.9f %.9f", p["lon"], p["lat"])), ", "), F.lit("))"))


def ring_from_wkt(text: Column) -> Column:
    """struct(lat, lon) vertices of a POLYGON's first ring without the closing one; null if it isn't one of three."""
    body = F.regexp_extract(text, r"^\s*(?i:POLYGON)\s*\(\(([^()]*)\)", 1)
    pairs = F.transform(F.split(body, r"\s*,\s*"), lambda p: F.split(F.trim(p), r"\s+"))
    points = F.transform(pairs, lambda p: F.struct(F.try_to_number(p[1], F.lit("S9999.999999999")).cast("double").alias("lat"), F.try_to_number(p[0], F.lit("S9999.999999999")).cast("double").alias("lon")))
    return F.when((body != "") & (F.size(points) >= 4), F.slice(points, 1, F.size(points) - 1))


def inverse_polar_stereographic(x: Column, y: Column, north: bool, radius_m: float = MOON_RADIUS_M) -> tuple[Column, Column]:
    """(lat, lon) in degrees of polar map coordinates in metres; the pole itself has longitude 0."""
    rho = F.hypot(x, y)
    c = 2 * F.atan2(rho, F.lit(2 * radius_m))
    sign = 1 if north else -1
    lat = F.when(rho == 0, F.lit(90.0 * sign)).otherwise(F.degrees(F.asin(sign * F.cos(c))))
    lon = F.when(rho == 0, F.lit(0.0)).otherwise(F.degrees(F.atan2(x, -y if north else y)))
    return lat, lon


def homography(m: list[float], x: Column, y: Column) -> tuple[Column, Column]:
    """A row-major 3 x 3 transform applied to points."""
    w = m[6] * x + m[7] * y + m[8]
    return (m[0] * x + m[1] * y + m[2]) / w, (m[3] * x + m[4] * y + m[5]) / w


def degrees_per_metre(radius_m: float = MOON_RADIUS_M) -> float:
    return 180 / (math.pi * radius_m)
