"""Catalogue scans: GeoJSON features, product records, geometry-grid rows. Every row gets an outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.operators.outcomes import ladder

RADIUS_M = 1737400.0


def _ring_area(ring: Column) -> Column:
    """Area in square kilometres on the sphere of a closed ring of [lon, lat]."""
    following = F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0)))
    edges = F.arrays_zip(F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))).alias("p"), following.alias("q"))
    step = F.transform(edges, lambda e: F.radians(F.get(e["q"], F.lit(0)) - F.get(e["p"], F.lit(0))) * (2 + F.sin(F.radians(F.get(e["p"], F.lit(1)))) + F.sin(F.radians(F.get(e["q"], F.lit(1))))))
    return F.abs(F.aggregate(step, F.lit(0.0), lambda a, x: a + x)) * (RADIUS_M * RADIUS_M / 2 / 1e6)


def geojson(files: DataFrame, id_name: str = "PRODUCT_ID", box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """A row per feature of the GeoJSON texts ``files`` (path, text): (path, ordinal, product_id, status, area_km2, bounds).

    Statuses in order of precedence: MISSING_ID, NO_GEOMETRY, EMPTY_RING, DEGENERATE_FOOTPRINT, OUTSIDE_BOX,
    OK. A text that is no feature collection gives one row UNREADABLE. ``box``: (min_lat, max_lat, min_lon,
    max_lon), closed and not wrapped. Polygons and the first part of multi-polygons count.
    """
    schema = "features array<struct<properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>"
    doc = files.select("path", F.from_json("text", schema).alias("doc"))
    each = doc.select("path", F.posexplode_outer("doc.features").alias("ordinal", "f"), F.col("doc.features").isNull().alias("bad")).filter("bad or f is not null")
    rings = F.when(F.col("f.geometry.type") == "Polygon", F.from_json("f.geometry.coordinates", "array<array<array<double>>>")).when(F.col("f.geometry.type") == "MultiPolygon", F.get(F.from_json("f.geometry.coordinates", "array<array<array<array<double>>>>"), F.lit(0)))
    flat = each.select("path", "ordinal", "bad", F.nullif(F.element_at("f.properties", id_name), F.lit("")).alias("product_id"), F.get(rings, F.lit(0)).alias("ring"))
    lon, lat = F.transform("ring", lambda p: F.get(p, F.lit(0))), F.transform("ring", lambda p: F.get(p, F.lit(1)))
    flat = flat.withColumn("area_km2", _ring_area(F.col("ring")))
    for name, values in (("lon", lon), ("lat", lat)):
        flat = flat.withColumn(f"min_{name}", F.array_min(values)).withColumn(f"max_{name}", F.array_max(values))
    steps = [("UNREADABLE", F.col("bad")), ("MISSING_ID", F.col("product_id").isNull()), ("NO_GEOMETRY", F.col("ring").isNull()), ("EMPTY_RING", F.size("ring") == 0), ("DEGENERATE_FOOTPRINT", F.coalesce(F.col("area_km2") <= 0, F.lit(True)))]
    if box:
        steps.append(("OUTSIDE_BOX", (F.col("max_lat") < box[0]) | (F.col("min_lat") > box[1]) | (F.col("max_lon") < box[2]) | (F.col("min_lon") > box[3])))
    return flat.select("path", "ordinal", "product_id", ladder(*steps, otherwise="OK").alias("status"), "area_km2", "min_lat", "max_lat", "min_lon", "max_lon")


def grid_rows(lines: DataFrame, names: list[str], n_lines: int | None = None, n_samples: int | None = None) -> DataFrame:
    """Rows of a geometry grid (lineno, line) as (lineno, scan, pixel, lat, lon, status).

    ``names``: the label's fields in order, with longitude, latitude, pixel and scan among them. Precedence:
    EMPTY_ROW, WRONG_FIELD_COUNT, NON_NUMERIC (pixel and scan are whole numbers), COORDINATE_OUT_OF_RANGE,
    INDEX_OUT_OF_RANGE, OK.
    """
    at = {n.lower(): i for i, n in enumerate(names)}
    parts = lines.withColumn("_c", F.transform(F.split(F.coalesce("line", F.lit("")), ","), lambda x: F.trim(F.regexp_replace(x, r"[\r\t]", " "))))

    def cell(name: str) -> Column:
        return F.get("_c", F.lit(at[name]))

    def whole(name: str) -> Column:
        return F.when(cell(name).rlike(r"^[+-]?[0-9]+$"), cell(name)).try_cast("bigint")

    cols = parts.select("lineno", "_c", whole("scan").alias("scan"), whole("pixel").alias("pixel"), cell("latitude").try_cast("double").alias("lat"), cell("longitude").try_cast("double").alias("lon"))
    numbers = [F.col(c).isNull() for c in ("scan", "pixel", "lat", "lon")]
    finite = [F.isnan(c) | (F.abs(F.col(c)) == float("inf")) for c in ("lat", "lon")]
    outside = (F.col("pixel") < 0) | (F.col("scan") < 0)
    outside = outside | (F.col("pixel") >= n_samples) if n_samples is not None else outside
    outside = outside | (F.col("scan") >= n_lines) if n_lines is not None else outside
    status = ladder(
        ("EMPTY_ROW", F.forall("_c", lambda x: x == "")),
        ("WRONG_FIELD_COUNT", F.size("_c") != len(names)),
        ("NON_NUMERIC", numbers[0] | numbers[1] | numbers[2] | numbers[3]),
        ("COORDINATE_OUT_OF_RANGE", finite[0] | finite[1] | (F.abs("lat") > 90)),
        ("INDEX_OUT_OF_RANGE", outside),
        otherwise="OK",
    )
    return cols.withColumn("status", status).drop("_c")


def assembled(rows: DataFrame) -> DataFrame:
    """Classified grid rows with repeats after the first of a (scan, pixel) marked DUPLICATE_POINT."""
    rn = F.row_number().over(Window.partitionBy("scan", "pixel").orderBy("lineno"))
    good = rows.filter("status = 'OK'").withColumn("status", F.when(rn > 1, "DUPLICATE_POINT").otherwise("OK"))
    return good.unionByName(rows.filter("status <> 'OK'"))


def records(found: DataFrame) -> DataFrame:
    """Product records (pdsid, product_name and texts of bounds and angles) as rows with outcome OK, MISSING_ID or NO_GEOMETRY."""
    bounds = {"min_lat": "minimum_latitude", "max_lat": "maximum_latitude", "min_lon": "westernmost_longitude", "max_lon": "easternmost_longitude"}
    out = found.select(F.coalesce("pdsid", "product_name").alias("product_id"), *[F.col(v).try_cast("double").alias(k) for k, v in bounds.items()], F.col("incidence_angle").try_cast("double").alias("incidence_deg"))
    missing = F.col("min_lat").isNull() | F.col("max_lat").isNull() | F.col("min_lon").isNull() | F.col("max_lon").isNull()
    status = ladder(("MISSING_ID", F.col("product_id").isNull()), ("NO_GEOMETRY", missing), otherwise="OK")
    return out.withColumn("elevation_deg", 90 - F.col("incidence_deg")).withColumn("status", status)
