"""Footprints on the sphere as column expressions: validity, caps, polar planes, seams, extents, areas.

A ring is an array of struct(lat, lon) in degrees without the closing vertex.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from mosaiq.functions.geodesy import MOON_RADIUS_M, lon_to_180

# Fixed limits of the data model.
POLAR_LATITUDE = 80.0
ANTIMERIDIAN_SPAN = 180.0
POLAR_MOST_COLATITUDE = 60.0
LEAST_AREA_M2 = 1e6
MOST_ASPECT = 200.0
METRES_PER_DEGREE = MOON_RADIUS_M * math.pi / 180


def lats(ring: Column) -> Column:
    return F.transform(ring, lambda p: p["lat"])


def lons(ring: Column) -> Column:
    return F.transform(ring, lambda p: p["lon"])


def _let(value: Column, made) -> Column:
    """``made`` of a value that is worked out once, however often ``made`` uses it."""
    return F.get(F.transform(F.array(value), made), F.lit(0))


def bounds(ring: Column) -> Column:
    """struct(min_lat, max_lat, min_lon, max_lon); null for an empty ring."""

    def box(r):
        lat, lon = lats(r), lons(r)
        made = F.struct(F.array_min(lat).alias("min_lat"), F.array_max(lat).alias("max_lat"), F.array_min(lon).alias("min_lon"), F.array_max(lon).alias("max_lon"))
        return F.when(F.size(r) > 0, made)

    return _let(ring, box)


def is_polar(ring: Column) -> Column:
    return F.array_max(F.transform(ring, lambda p: F.abs(p["lat"]))) >= POLAR_LATITUDE


def crosses_antimeridian(ring: Column) -> Column:
    return F.array_max(lons(ring)) - F.array_min(lons(ring)) > ANTIMERIDIAN_SPAN


def validity(ring: Column, from_box: Column) -> Column:
    """OK, INVALID_GEOMETRY, ANTIMERIDIAN or POLAR_BBOX_UNUSABLE; a null ring is invalid."""

    def bad(p):
        odd = p["lat"].isNull() | p["lon"].isNull() | F.isnan(p["lat"]) | F.isnan(p["lon"])
        return odd | (F.abs(p["lat"]) > 90) | (F.abs(p["lon"]) > 360)

    broken = F.coalesce((F.size(ring) < 3) | F.exists(ring, bad), F.lit(True))
    wide = crosses_antimeridian(ring)
    return F.when(broken, "INVALID_GEOMETRY").when(wide & ~is_polar(ring), "ANTIMERIDIAN").when(wide & from_box, "POLAR_BBOX_UNUSABLE").otherwise("OK")


def ring_of(corners: list[tuple[Column, Column]], wkt_ring: Column, box: tuple[Column, Column, Column, Column]) -> Column:
    """struct(ring, from_box) by preference: four finite corners UL, UR, LL, LR; a WKT ring; a box of some extent; else null."""

    def point(lat, lon):
        return F.struct(lat.cast("double").alias("lat"), lon.cast("double").alias("lon"))

    def finite(c):
        return c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))

    whole = F.lit(True)
    for lat, lon in corners:
        whole = whole & finite(lat) & finite(lon)
    a, b, c, d = (point(*corners[i]) for i in (0, 1, 3, 2))
    low, high, west, east = box
    boxed = finite(low) & finite(high) & finite(west) & finite(east) & (high > low) & (east > west)
    around = F.array(point(low, west), point(low, east), point(high, east), point(high, west))
    found = F.when(whole, F.array(a, b, c, d)).when(wkt_ring.isNotNull(), wkt_ring).when(boxed, around)
    return F.when(found.isNotNull(), F.struct(found.alias("ring"), (~whole & wkt_ring.isNull()).alias("from_box")))


def touching(a: Column, b: Column, eps: float = 1e-9) -> Column:
    """Whether two boxes (structs of ``bounds``) abut on one axis and meet on the other."""
    up = F.greatest(a["min_lat"], b["min_lat"]) - F.least(a["max_lat"], b["max_lat"])
    across = F.greatest(a["min_lon"], b["min_lon"]) - F.least(a["max_lon"], b["max_lon"])
    return ((F.abs(up) <= eps) & (across <= eps)) | ((F.abs(across) <= eps) & (up <= eps))


def rewrapped(ring: Column, reference: Column) -> Column:
    """The ring without jumps of over 180 degrees, moved as a whole so that its mean longitude is nearest to ``reference``."""
    first = ring[0]["lon"]

    def step(acc, lon):
        last = F.coalesce(F.try_element_at(acc, F.lit(-1)), first)
        return F.concat(acc, F.array(last + lon_to_180(lon - last)))

    def moved(free):
        mean = F.aggregate(free, F.lit(0.0), lambda s, x: s + x) / F.size(free)
        shift = _let(mean, lambda m: 360.0 * F.bround((reference - lon_to_180(reference - m) - m) / 360.0))
        return _let(shift, lambda by: F.transform(ring, lambda p, i: F.struct(p["lat"].alias("lat"), (F.get(free, i) + by).alias("lon"))))

    return _let(F.aggregate(lons(ring), F.array().cast("array<double>"), step), moved)


def relon(lon: Column, reference: Column) -> Column:
    """The longitude that is equal to ``lon`` and nearest to ``reference``."""
    return reference + lon_to_180(lon - reference)


def unit(lat: Column, lon: Column) -> Column:
    """struct(x, y, z) on the unit sphere."""
    a, o = F.radians(lat), F.radians(lon)
    return F.struct((F.cos(a) * F.cos(o)).alias("x"), (F.cos(a) * F.sin(o)).alias("y"), F.sin(a).alias("z"))


def angle_deg(u: Column, v: Column) -> Column:
    dot = u["x"] * v["x"] + u["y"] * v["y"] + u["z"] * v["z"]
    return F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot))))


def cap(ring: Column) -> Column:
    """struct(x, y, z, radius): the cap around the mean of the vertices that holds all; the sphere if they cancel out."""
    def around(units):
        def along(axis):
            return F.aggregate(units, F.lit(0.0), lambda s, u: s + u[axis])

        total = F.struct(*[along(k).alias(k) for k in "xyz"])

        def held(t):
            norm = F.sqrt(t["x"] * t["x"] + t["y"] * t["y"] + t["z"] * t["z"])
            centre = F.struct(*[(t[k] / norm).alias(k) for k in "xyz"])
            made = _let(centre, lambda c: F.struct(*[c[k].alias(k) for k in "xyz"], F.array_max(F.transform(units, lambda u: angle_deg(c, u))).alias("radius")))
            return F.when(norm > 0, made).otherwise(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("z"), F.lit(180.0).alias("radius")))

        return _let(total, held)

    return _let(F.transform(ring, lambda p: unit(p["lat"], p["lon"])), around)


def cap_gap_deg(a: Column, b: Column) -> Column:
    """Degrees between two caps; above zero they can't meet."""
    return angle_deg(a, b) - (a["radius"] + b["radius"])


def pole_of(a: Column, b: Column) -> Column:
    """90 or -90: the pole nearest to any vertex of two rings (of ties, the first vertex's)."""
    every = F.concat(lats(a), lats(b))
    most = F.array_max(F.transform(every, lambda v: F.abs(v)))
    first = F.get(F.filter(every, lambda v: F.abs(v) == most), F.lit(0))
    return F.when(first >= 0, 90.0).otherwise(-90.0)


def most_colatitude(ring: Column, pole: Column) -> Column:
    return F.array_max(F.transform(ring, lambda p: F.abs(pole - p["lat"])))


def to_plane(lat: Column, lon: Column, pole: Column) -> Column:
    """struct(lat, lon) holding (northing, easting), degrees of arc of the azimuthal-equidistant plane about a pole."""
    sign = F.when(pole > 0, 1.0).otherwise(-1.0)
    rho, o = F.abs(pole - lat), F.radians(lon)
    return F.struct((-sign * rho * F.cos(o)).alias("lat"), (rho * F.sin(o)).alias("lon"))


def to_sphere(northing: Column, easting: Column, pole: Column) -> Column:
    sign = F.when(pole > 0, 1.0).otherwise(-1.0)
    lat = sign * (90.0 - F.hypot(northing, easting))
    return F.struct(lat.alias("lat"), F.degrees(F.atan2(easting, -sign * northing)).alias("lon"))


def extent_m(ring: Column) -> Column:
    """struct(ns, ew): metres of a ring's box, the width at its mean latitude."""
    box = bounds(ring)
    mean = F.aggregate(lats(ring), F.lit(0.0), lambda s, x: s + x) / F.size(ring)
    return F.struct(((box["max_lat"] - box["min_lat"]) * METRES_PER_DEGREE).alias("ns"), ((box["max_lon"] - box["min_lon"]) * METRES_PER_DEGREE * F.cos(F.radians(mean))).alias("ew"))


def plane_extent_m(ring: Column) -> Column:
    box = bounds(ring)
    return F.struct(((box["max_lat"] - box["min_lat"]) * METRES_PER_DEGREE).alias("ns"), ((box["max_lon"] - box["min_lon"]) * METRES_PER_DEGREE).alias("ew"))


def great_circle_area_m2(ring: Column, radius_m: float = MOON_RADIUS_M) -> Column:
    """Area of a ring whose edges are great circles, a pole inside or not; zero for fewer than three vertices."""
    n = F.size(ring)

    def excess(p, i):
        q = ring[(i + 1) % n]
        turn = F.tan(F.radians(lon_to_180(q["lon"] - p["lon"])) / 2)
        a, b = F.tan(F.radians(p["lat"]) / 2), F.tan(F.radians(q["lat"]) / 2)
        return 2 * F.atan2(turn * (a + b), 1 + a * b)

    def sweep(p, i):
        return lon_to_180(ring[(i + 1) % n]["lon"] - p["lon"])

    def total(values):
        return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)

    around = F.abs(total(F.transform(ring, sweep))) > 180
    e = F.abs(total(F.transform(ring, excess)))
    area = F.when(around, F.abs(e - 2 * math.pi)).otherwise(e) * (radius_m * radius_m)
    return F.when(n < 3, 0.0).otherwise(area)


def metres_per_degree(lat: Column) -> Column:
    """struct(lat, lon): metres of a degree of latitude, and of longitude there."""
    return F.struct(F.lit(METRES_PER_DEGREE).alias("lat"), (METRES_PER_DEGREE * F.cos(F.radians(lat))).alias("lon"))


def ground_grid(ring: Column, spacing_m: float) -> Column:
    """The centres, struct(lat, lon), of a grid's cells over a ring's box; filter them by ``point_in_ring``."""
    box = bounds(ring)
    wide = metres_per_degree((box["min_lat"] + box["max_lat"]) / 2)["lon"]
    d_lat, d_lon = F.lit(spacing_m / METRES_PER_DEGREE), spacing_m / wide
    rows = F.sequence(F.lit(0), ((box["max_lat"] - box["min_lat"]) / d_lat).cast("int"))
    cols = F.sequence(F.lit(0), ((box["max_lon"] - box["min_lon"]) / d_lon).cast("int"))
    cells = F.flatten(F.transform(rows, lambda i: F.transform(cols, lambda j: F.struct((box["min_lat"] + (i + 0.5) * d_lat).alias("lat"), (box["min_lon"] + (j + 0.5) * d_lon).alias("lon")))))
    return F.when((F.size(ring) >= 3) & (wide > 0) & F.lit(spacing_m > 0), cells).otherwise(F.array().cast("array<struct<lat:double,lon:double>>"))


def sun_direction(x: Column, y: Column, z: Column, lat: Column, lon: Column) -> Column:
    """struct(azimuth, elevation) in degrees, azimuth clockwise from north, of a body-fixed vector seen from a point."""
    norm = F.sqrt(x * x + y * y + z * z)
    p, o = F.radians(lat), F.radians(lon)
    up = (x * F.cos(p) * F.cos(o) + y * F.cos(p) * F.sin(o) + z * F.sin(p)) / norm
    east = (-x * F.sin(o) + y * F.cos(o)) / norm
    north = (-x * F.sin(p) * F.cos(o) - y * F.sin(p) * F.sin(o) + z * F.cos(p)) / norm
    elevation = F.degrees(F.asin(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), up))))
    return F.when(norm > 0, F.struct(F.pmod(F.degrees(F.atan2(east, north)), F.lit(360.0)).alias("azimuth"), elevation.alias("elevation")))


def grid_azimuth(azimuth: Column, dx: Column, dy: Column) -> Column:
    """An azimuth from north as one from grid-up, (dx, dy) being the map's step to the north."""
    return F.pmod(azimuth - F.degrees(F.atan2(dx, dy)), F.lit(360.0))


def signed_difference(a: Column, b: Column) -> Column:
    return lon_to_180(a - b)
