"""Plans over labels: XML written from customers' numbers, scanned back into the manifest."""

from __future__ import annotations

from pyspark.sql import functions as F

from mosaiq.operators import views
from mosaiq.plans.catalogue import query
from mosaiq.session import table
from mosaiq.sources import manifest


def _files(spark, d):
    key = F.col("c_custkey")
    text = F.format_string(
        "<Product xmlns='urn:x'><logical_identifier>urn:ch2_ohr_%s</logical_identifier><start_date_time>%s</start_date_time><sun_azimuth>%s</sun_azimuth><upper_left_latitude>%s</upper_left_latitude><upper_left_longitude>%s</upper_left_longitude><lower_right_latitude>%s</lower_right_latitude>"
        "<Axis_Array><axis_name>Line</axis_name><elements>%s</elements><sequence_number>1</sequence_number></Axis_Array><Axis_Array><axis_name>Sample</axis_name><elements>200</elements><sequence_number>2</sequence_number></Axis_Array>%s",
        key.cast("string"),
        F.when(key % 5 == 0, "never").otherwise("2021-04-05T06:07:08Z"),
        F.when(key % 7 == 0, "n/a").otherwise((key % 360).cast("string")),
        (key % 90).cast("string"),
        (key % 180).cast("string"),
        (key % 90 + 1).cast("string"),
        (100 + key).cast("string"),
        F.when(key % 11 == 0, "").otherwise("</Product>"),
    )
    name = F.concat(F.lit("/d/ch2_ohr_"), key.cast("string"), F.when(key % 13 == 0, "_b_brw_1.xml").otherwise("_d_img_1.xml"))
    return table(spark, d, "customer").select(name.alias("path"), text.cast("binary").alias("content"))


@query(
    "label_manifest",
    """
SELECT 'urn:ch2_ohr_' || c_custkey AS product_id, 'OHRC' AS sensor, CAST(100 + c_custkey AS BIGINT) AS lines, (100 + c_custkey) * 200 / 1e6 AS megapixels, CASE WHEN c_custkey % 7 <> 0 THEN CAST(c_custkey % 360 AS DOUBLE) END AS sun_azimuth_deg,
  CAST(c_custkey % 90 AS DOUBLE) AS min_lat, CAST(c_custkey % 90 + 1 AS DOUBLE) AS max_lat, CAST(c_custkey % 180 AS DOUBLE) AS max_lon, c_custkey % 5 <> 0 AS has_start, 'Line,Sample' AS axis_order, 'data' AS product_type,
  c_custkey % 7 = 0 AS coerce_failed FROM customer WHERE c_custkey % 11 <> 0 AND c_custkey % 13 <> 0""",
)
def _manifest(spark, d):
    m = manifest.products(_files(spark, d), "test")
    return m.filter("product_id is not null").select("product_id", "sensor", "lines", "megapixels", "sun_azimuth_deg", "min_lat", "max_lat", "max_lon", F.col("start_time").isNotNull().alias("has_start"), "axis_order", "product_type", F.col("unresolved_fields").contains("sun_azimuth_deg(coerce_failed)").alias("coerce_failed"))


@query(
    "label_outcomes",
    "SELECT CASE WHEN c_custkey % 13 = 0 THEN 'not_a_data_product' WHEN c_custkey % 11 = 0 THEN 'parse_error' ELSE 'parsed' END AS status, CAST(count(*) AS BIGINT) AS n FROM customer GROUP BY 1",
)
def _outcomes(spark, d):
    return manifest.outcomes(_files(spark, d)).select("status", "n")


@query(
    "filter_choices",
    "SELECT DISTINCT 'status' AS \"column\", o_orderstatus AS value FROM orders UNION SELECT DISTINCT 'priority', o_orderpriority FROM orders",
)
def _choices(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    return views.choices(o, ["status", "priority"])


@query(
    "residual_histogram",
    "SELECT CAST(b AS INT) AS bin, CAST(count(l_quantity) AS BIGINT) AS n FROM range(0, 10) r(b) LEFT JOIN lineitem ON l_quantity BETWEEN 0 AND 40 AND least(floor(l_quantity / 4.0), 9) = b GROUP BY 1",
)
def _residuals(spark, d):
    return views.histogram(table(spark, d, "lineitem"), "l_quantity", 0.0, 40.0, 10)
