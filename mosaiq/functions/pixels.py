"""Pixel geometry as column expressions. A matrix is an array of nine doubles, row by row; pixels count from their centres."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _matrix(*rows: Column) -> Column:
    return F.array(*[(x if isinstance(x, Column) else F.lit(float(x))).cast("double") for x in rows])


def applied(m: Column, x: Column, y: Column) -> Column:
    """struct(x, y) of a point sent by a matrix; null where it goes to infinity."""
    w = m[6] * x + m[7] * y + m[8]
    return F.when(w != 0, F.struct(((m[0] * x + m[1] * y + m[2]) / w).alias("x"), ((m[3] * x + m[4] * y + m[5]) / w).alias("y")))


def product(a: Column, b: Column) -> Column:
    return F.array(*[a[3 * i] * b[j] + a[3 * i + 1] * b[3 + j] + a[3 * i + 2] * b[6 + j] for i in range(3) for j in range(3)])


def determinant(m: Column) -> Column:
    return m[0] * (m[4] * m[8] - m[5] * m[7]) - m[1] * (m[3] * m[8] - m[5] * m[6]) + m[2] * (m[3] * m[7] - m[4] * m[6])


def inverse(m: Column) -> Column:
    """The inverse; null if the determinant is zero."""
    co = [(4, 8, 5, 7), (2, 7, 1, 8), (1, 5, 2, 4), (5, 6, 3, 8), (0, 8, 2, 6), (2, 3, 0, 5), (3, 7, 4, 6), (1, 6, 0, 7), (0, 4, 1, 3)]
    d = determinant(m)
    return F.when(d != 0, F.array(*[(m[a] * m[b] - m[c] * m[e]) / d for a, b, c, e in co]))


def to_native(x0: Column, y0: Column, native_w: Column, native_h: Column, working_w: Column, working_h: Column) -> Column:
    """Working pixels to native ones, the window beginning at (x0, y0)."""
    fx, fy = native_w / working_w, native_h / working_h
    return _matrix(fx, 0, x0 + (fx - 1) / 2, 0, fy, y0 + (fy - 1) / 2, 0, 0, 1)


def native_to_resampled(native_w: Column, native_h: Column, working_w: Column, working_h: Column) -> Column:
    return inverse(to_native(F.lit(0.0), F.lit(0.0), native_w, native_h, working_w, working_h))


def resized(src_w: Column, src_h: Column, dst_w: Column, dst_h: Column) -> Column:
    """Input pixels to the output pixels of a resize."""
    sx, sy = dst_w / src_w, dst_h / src_h
    return _matrix(sx, 0, 0.5 * sx - 0.5, 0, sy, 0.5 * sy - 0.5, 0, 0, 1)


def lifted(coarse: Column, source_to_native: Column, reference_to_native: Column) -> Column:
    """A transform between working images as one between native images."""
    return product(product(reference_to_native, coarse), inverse(source_to_native))


def thumbnail(transform: Column, src_scale: Column, ref_scale: Column) -> Column:
    """A transform between images as one between their scaled copies."""
    s = _matrix(1 / src_scale, 0, 0, 0, 1 / src_scale, 0, 0, 0, 1)
    r = _matrix(ref_scale, 0, 0, 0, ref_scale, 0, 0, 0, 1)
    return product(product(r, transform), s)


def working_size(n: Column, factor: Column) -> Column:
    """At least one pixel; halves round to even."""
    return F.greatest(F.lit(1), F.bround(n / factor).cast("int"))


def working_gsd(source_gsd: Column, reference_gsd: Column) -> Column:
    """The coarser of two, rounded up to the next half metre."""
    return F.ceil(F.greatest(source_gsd, reference_gsd) * 2) / 2


def snapped(v: Column, tolerance: float = 1e-3) -> Column:
    near = F.bround(v)
    return F.when(F.abs(v - near) < tolerance, near).otherwise(v)


def scale_ratio(a: Column, b: Column) -> Column:
    return F.greatest(a, b) / F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def corner_latlon(ul, ur, ll, lr, u: Column, v: Column) -> Column:
    """struct(lat, lon) at (u, v) in 0..1 between four corners, structs (lat, lon); null if a corner is."""

    def at(key):
        return (1 - v) * ((1 - u) * ul[key] + u * ur[key]) + v * ((1 - u) * ll[key] + u * lr[key])

    return F.struct(at("lat").alias("lat"), at("lon").alias("lon"))


def pixel_to_xy(geo: Column, col: Column, row: Column) -> Column:
    """struct(x, y) by a georeference (x0, y0, step_x, step_y)."""
    return F.struct((geo["x0"] + col * geo["step_x"]).alias("x"), (geo["y0"] + row * geo["step_y"]).alias("y"))


def xy_to_pixel(geo: Column, x: Column, y: Column) -> Column:
    return F.struct(((x - geo["x0"]) / geo["step_x"]).alias("col"), ((y - geo["y0"]) / geo["step_y"]).alias("row"))


def eqc_to_xy(lat: Column, lon: Column, radius_m: float, lat_ts: float = 0.0, lon_0: float = 0.0) -> Column:
    """Equidistant cylindrical map coordinates in metres."""
    k = radius_m * math.cos(math.radians(lat_ts))
    return F.struct((F.radians(lon - lon_0) * k).alias("x"), (F.radians(lat) * radius_m).alias("y"))


def xy_to_eqc(x: Column, y: Column, radius_m: float, lat_ts: float = 0.0, lon_0: float = 0.0) -> Column:
    k = radius_m * math.cos(math.radians(lat_ts))
    return F.struct(F.degrees(y / radius_m).alias("lat"), (F.degrees(x / k) + lon_0).alias("lon"))


def polar_to_xy(lat: Column, lon: Column, radius_m: float, north: bool) -> Column:
    """Polar stereographic map coordinates in metres, scale one at the pole."""
    sign = 1 if north else -1
    rho = 2 * radius_m * F.tan(F.radians(90 - sign * lat) / 2)
    return F.struct((rho * F.sin(F.radians(lon))).alias("x"), (-sign * rho * F.cos(F.radians(lon))).alias("y"))


def pixel_window(xs: Column, ys: Column, width: Column, height: Column) -> Column:
    """struct(row, col, height, width) of the pixels that points (arrays xs, ys) span, clipped to the image; null if outside."""
    c0, c1 = F.floor(snapped(F.array_min(xs))), F.floor(snapped(F.array_max(xs))) + 1
    r0, r1 = F.floor(snapped(F.array_min(ys))), F.floor(snapped(F.array_max(ys))) + 1
    clip = lambda v, most: F.greatest(F.lit(0), F.least(v, most)).cast("int")
    c0, c1, r0, r1 = clip(c0, width), clip(c1, width), clip(r0, height), clip(r1, height)
    return F.when((c1 > c0) & (r1 > r0), F.struct(r0.alias("row"), c0.alias("col"), (r1 - r0).alias("height"), (c1 - c0).alias("width")))


def centre_offset_m(found: Column, prior: Column, width: Column, height: Column, gsd_m: Column) -> Column:
    """Metres between where two transforms send an image's centre."""
    a, b = applied(found, width / 2, height / 2), applied(prior, width / 2, height / 2)
    return F.hypot(a["x"] - b["x"], a["y"] - b["y"]) * gsd_m


def decimation_factor(width: Column, height: Column, most: int) -> Column:
    """The least whole stride that leaves at most ``most`` pixels on the longer edge."""
    return F.greatest(F.lit(1), F.ceil(F.greatest(width, height) / most).cast("int"))


def full_load_bytes(height: Column, width: Column, bands: Column, bytes_each: Column) -> Column:
    return height.cast("long") * width * bands * bytes_each


def dense_peak_bytes(tile: Column, per_pixel: float, bytes_each: int) -> Column:
    """Activations of a dense matcher on a square tile: a part by pixel and the square of its tokens of 8 x 8."""
    tokens = F.pow(F.floor(tile / 8), F.lit(2))
    return F.floor(per_pixel * tile * tile + tokens * tokens * bytes_each).cast("long")


def analytic_tile(free: Column, per_pixel: float, bytes_each: int, safety: float = 0.75, least: int = 256, most: int = 1408) -> Column:
    """The largest multiple of 64 whose ``dense_peak_bytes`` keep within a share of what is free, between two limits."""
    quartic = bytes_each / 4096
    x = (F.sqrt(per_pixel * per_pixel + 4 * quartic * F.greatest(free * safety, F.lit(0.0))) - per_pixel) / (2 * quartic)
    return F.greatest(F.lit(least), (F.floor(F.least(F.sqrt(F.greatest(x, F.lit(0.0))), F.lit(float(most))) / 64) * 64).cast("int"))


def keypoint_budget(free_bytes: Column, most: int = 4096, usual: int = 2048, least: int = 1024) -> Column:
    """Keypoints a tile by free memory: from 10 GiB on the most, from 5 the usual number."""
    gib = free_bytes / float(1 << 30)
    return F.when(gib >= 10, most).when(gib >= 5, usual).otherwise(least)
