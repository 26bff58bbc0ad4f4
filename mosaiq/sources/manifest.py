"""One typed row a product: from label files to the manifest, with an outcome for every label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.functions import names as n
from mosaiq.sources import labels

#: Fields that a label may give, by type, with the paths that are tried (fixed names of the label format).
FIELDS: dict[str, tuple[str, list[str]]] = {
    "product_id": ("string", ["logical_identifier"]),
    "image_file": ("string", ["File_Area_Observational/File/file_name", "File/file_name"]),
    "data_type": ("string", ["Element_Array/data_type"]),
    "start_time": ("string", ["Time_Coordinates/start_date_time", "start_date_time"]),
    "stop_time": ("string", ["Time_Coordinates/stop_date_time", "stop_date_time"]),
    "sun_azimuth_deg": ("double", ["sun_azimuth"]),
    "sun_elevation_deg": ("double", ["sun_elevation"]),
    "incidence_angle_deg": ("double", ["incidence_angle"]),
    "emission_angle_deg": ("double", ["emission_angle"]),
    "phase_angle_deg": ("double", ["phase_angle"]),
    **{f"corner{i}_{c}": ("double", [f"{side}_{long}"]) for i, side in enumerate(("upper_left", "upper_right", "lower_left", "lower_right"), 1) for c, long in (("lat", "latitude"), ("lon", "longitude"))},
}
#: Stored types of the label format, and the same in numpy's words.
DTYPES = {"UnsignedByte": "u1", "SignedByte": "i1", "UnsignedLSB2": "<u2", "SignedLSB2": "<i2", "UnsignedMSB2": ">u2", "SignedMSB2": ">i2", "IEEE754LSBSingle": "<f4", "IEEE754MSBSingle": ">f4", "IEEE754LSBDouble": "<f8", "IEEE754MSBDouble": ">f8"}


def products(files: DataFrame, archive: str, fields: dict | None = None) -> DataFrame:
    """The manifest of XML labels ``files`` (path, content): a row for every data label that could be read.

    Times that don't parse are null; a box holds the corners that resolved; ``unresolved_fields`` names what no path found and
    what isn't of its type. Other outcomes are counted by ``outcomes``.
    """
    fields = fields or FIELDS
    found = labels.elements(files)
    each = labels.fields(found, fields)
    value = F.when(F.col("status") == "RESOLVED", F.coalesce(F.when(F.col("number").isNotNull(), F.col("number").cast("string")), F.col("raw")))
    missing = F.when(F.col("status") == "UNRESOLVED", F.col("field")).when(F.col("status") == "COERCE_FAILED", F.concat("field", F.lit("(coerce_failed)")))
    wide = each.groupBy("path").agg(*[F.max(F.when(F.col("field") == f, value)).alias(f) for f in fields], F.array_join(F.sort_array(F.collect_list(missing)), ",").alias("unresolved_fields"))
    shape = labels.axes(found).select("path", "axes")
    size = lambda name: F.get(F.filter("axes", lambda a: F.lower(a["name"]) == name), F.lit(0))["elements"]
    both = wide.join(shape, "path", "left").withColumns({"lines": size("line"), "samples": size("sample"), "bands": size("band")})
    number = lambda c: F.col(c).try_cast("double") if c in fields else F.lit(None).cast("double")
    corner = lambda i, c: number(f"corner{i}_{c}")
    lats, lons = (F.array_compact(F.array(*[corner(i, c) for i in range(1, 5)])) for c in ("lat", "lon"))
    whole = (F.size(lats) > 0) & (F.size(lons) > 0)
    kind = F.col("data_type")
    numpy_type = F.coalesce(*[F.when(kind == k, v) for k, v in DTYPES.items()])
    folder = F.regexp_extract("path", r"^(.*/)[^/]*$", 1)
    image = F.when(F.col("image_file").isNotNull() & n.is_contained(F.col("image_file")), F.concat(folder, "image_file"))
    angles = [number(c) for c in ("incidence_angle_deg", "emission_angle_deg", "phase_angle_deg")]
    out = both.select(
        "product_id",
        n.guess_sensor(F.col("product_id"), n.file_name(F.col("path"))).alias("sensor"),
        F.lit(archive).alias("archive"),
        F.col("path").alias("label_path"),
        image.alias("image_path"),
        "lines",
        "samples",
        "bands",
        F.when(F.size("axes") >= 3, "cube").when(F.size("axes") == 2, "image").alias("array_kind"),
        F.when(F.col("axes").isNotNull(), F.array_join(F.transform("axes", lambda a: a["name"]), ",")).alias("axis_order"),
        kind.alias("data_type"),
        numpy_type.alias("numpy_dtype"),
        (F.col("lines") * F.col("samples") / 1e6).alias("megapixels"),
        n.utc(F.col("start_time")).alias("start_time"),
        n.utc(F.col("stop_time")).alias("stop_time"),
        *[number(c).alias(c) for c in ("sun_azimuth_deg", "sun_elevation_deg", "incidence_angle_deg", "emission_angle_deg", "phase_angle_deg")],
        *[corner(i, c).alias(f"corner{i}_{c}") for i in range(1, 5) for c in ("lat", "lon")],
        *[F.when(whole, f(v)).alias(c) for c, f, v in (("min_lat", F.array_min, lats), ("max_lat", F.array_max, lats), ("min_lon", F.array_min, lons), ("max_lon", F.array_max, lons))],
        F.coalesce(*angles).isNotNull().alias("geometry_resolved"),
        whole.alias("footprint_resolved"),
        "unresolved_fields",
        n.product_type(F.col("path")).alias("product_type"),
    )
    return out.filter(F.col("product_type") == "data")


def outcomes(files: DataFrame) -> DataFrame:
    """(status, n, first_sample) of labels: parsed, parse_error, or not_a_data_product by their names."""
    read = labels.elements(files).groupBy("path").agg(F.bool_or(F.col("status") != "OK").alias("bad"))
    kind = F.when(n.product_type(F.col("path")) != "data", "not_a_data_product").when(F.col("bad"), "parse_error").otherwise("parsed")
    return read.groupBy(kind.alias("status")).agg(F.count("*").alias("n"), F.min("path").alias("first_sample"))


def with_grids(manifest: DataFrame, grids: DataFrame) -> DataFrame:
    """``manifest`` with geometry_grid_path: of the grid files (path) that carry a product's token of date and time, the first by name."""
    key = n.grid_key(F.col("path"), F.lit(None).cast("string"))
    best = grids.select(key.alias("_key"), "path").filter("_key is not null").groupBy("_key").agg(F.min("path").alias("geometry_grid_path"))
    keyed = manifest.withColumn("_key", n.grid_key(F.col("label_path"), F.col("product_id")))
    return keyed.join(best, "_key", "left").drop("_key")
