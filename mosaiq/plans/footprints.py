"""Plans over footprints, pixel geometry and evaluation figures; boxes and points are made from the tables' numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from mosaiq.functions import footprints as fp
from mosaiq.functions import pixels as px
from mosaiq.operators import evaluation as ev
from mosaiq.operators.overlap import overlaps
from mosaiq.plans.catalogue import query
from mosaiq.session import table

_BOX = "CAST(c_custkey AS BIGINT) AS id, -60 + (c_custkey * 7919 % 1200) / 10.0 AS lat, -180 + (c_custkey * 104729 % 3400) / 10.0 AS lon, 0.5 + c_custkey % 3 AS h, 0.5 + c_custkey % 4 AS w"


def _boxes(spark, d):
    k = F.col("c_custkey").cast("long")
    return table(spark, d, "customer").select(k.alias("id"), (-60 + (k * 7919 % 1200) / 10.0).alias("lat"), (-180 + (k * 104729 % 3400) / 10.0).alias("lon"), (0.5 + k % 3).alias("h"), (0.5 + k % 4).alias("w"))


def _ring():
    lat, lon, up, right = F.col("lat"), F.col("lon"), F.col("lat") + F.col("h"), F.col("lon") + F.col("w")
    return F.array(*[F.struct(a.alias("lat"), b.alias("lon")) for a, b in ((lat, lon), (lat, right), (up, right), (up, lon))])


@query(
    "footprint_overlaps",
    f"""
WITH b AS (SELECT {_BOX} FROM customer)
SELECT x.id AS id_a, y.id AS id_b, round(least(x.lat + x.h, y.lat + y.h) - greatest(x.lat, y.lat), 6) AS height, round(least(x.lon + x.w, y.lon + y.w) - greatest(x.lon, y.lon), 6) AS width
FROM b x JOIN b y ON x.id < y.id AND least(x.lat + x.h, y.lat + y.h) - greatest(x.lat, y.lat) > 1e-9 AND least(x.lon + x.w, y.lon + y.w) - greatest(x.lon, y.lon) > 1e-9""",
)
def _overlaps(spark, d):
    a = _boxes(spark, d).select("id", F.col("id").cast("string").alias("product_id"), _ring().alias("ring"), F.lit(False).alias("from_box"))
    found = overlaps(a).filter(F.col("status") == "OK")
    return found.select("id_a", "id_b", F.round(F.col("extent.max_lat") - F.col("extent.min_lat"), 6).alias("height"), F.round(F.col("extent.max_lon") - F.col("extent.min_lon"), 6).alias("width"))


@query(
    "footprint_checks",
    f"""
WITH b AS (SELECT {_BOX} FROM customer), c AS (SELECT *, CASE id % 5 WHEN 0 THEN lat + 40 ELSE lat END AS l, CASE WHEN id % 11 = 0 THEN w + 200 ELSE w END AS ww FROM b)
SELECT CASE WHEN l + h > 90 OR lon + ww > 360 THEN 'INVALID_GEOMETRY' WHEN ww > 180 AND greatest(abs(l), abs(l + h)) < 80 THEN 'ANTIMERIDIAN' WHEN ww > 180 THEN 'POLAR_BBOX_UNUSABLE' ELSE 'OK' END AS status,
  CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(greatest(abs(l), abs(l + h)) >= 80 AS INT)) AS BIGINT) AS n_polar, round(sum(radians(h) * 1737400.0), 3) AS ns_m FROM c GROUP BY 1""",
)
def _checks(spark, d):
    b = _boxes(spark, d).withColumn("lat", F.when(F.col("id") % 5 == 0, F.col("lat") + 40).otherwise(F.col("lat"))).withColumn("w", F.when(F.col("id") % 11 == 0, F.col("w") + 200).otherwise(F.col("w")))
    r = b.select(_ring().alias("ring"))
    ring = F.col("ring")
    return r.groupBy(fp.validity(ring, F.lit(True)).alias("status")).agg(F.count("*").alias("n"), F.sum(fp.is_polar(ring).cast("int")).alias("n_polar"), F.round(F.sum(fp.extent_m(ring)["ns"]), 3).alias("ns_m"))


@query(
    "sphere_distances",
    f"""
WITH b AS (SELECT {_BOX} FROM customer), v AS (SELECT id, lat, lon, cos(radians(lat)) * cos(radians(lon)) AS x, cos(radians(lat)) * sin(radians(lon)) AS y, sin(radians(lat)) AS z FROM b)
SELECT id, round(degrees(acos(least(1, greatest(-1, x)))), 4) AS from_origin, round((90 + lat) * cos(radians(lon)), 6) AS northing, round((90 + lat) * sin(radians(lon)), 6) AS easting,
  round(2 * 1737400.0 * tan(radians(90 + lat) / 2) * sin(radians(lon)), 2) AS polar_x, round(radians(lon) * 1737400.0, 2) AS eqc_x, round(cos(radians(lat)) * 1737400.0 * pi() / 180, 4) AS per_lon FROM v""",
)
def _sphere(spark, d):
    lat, lon = F.col("lat"), F.col("lon")
    plane = fp.to_plane(lat, lon, F.lit(-90.0))
    return _boxes(spark, d).select(
        "id",
        F.round(fp.angle_deg(fp.unit(lat, lon), fp.unit(F.lit(0.0), F.lit(0.0))), 4).alias("from_origin"),
        F.round(plane["lat"], 6).alias("northing"),
        F.round(plane["lon"], 6).alias("easting"),
        F.round(px.polar_to_xy(lat, lon, fp.MOON_RADIUS_M, False)["x"], 2).alias("polar_x"),
        F.round(px.eqc_to_xy(lat, lon, fp.MOON_RADIUS_M)["x"], 2).alias("eqc_x"),
        F.round(fp.metres_per_degree(lat)["lon"], 4).alias("per_lon"),
    )


@query(
    "pixel_matrices",
    """
WITH p AS (SELECT p_partkey, 100 + p_size * 8 AS w, 50 + p_size * 4 AS h, greatest(1, round_even((100 + p_size * 8) / 3.0, 0)) AS ww, greatest(1, round_even((50 + p_size * 4) / 3.0, 0)) AS wh FROM part)
SELECT p_partkey, CAST(ww AS INT) AS ww, round(w / ww * 7 + (w / ww - 1) / 2 + 3, 6) AS x, round(h / wh * 5 + (h / wh - 1) / 2 + 4, 6) AS y, round(w / ww * h / wh, 6) AS det, ceil(greatest(0.3, p_partkey % 7 / 4.0) * 2) / 2 AS gsd, CAST(w AS BIGINT) * h * 3 * 2 AS bytes FROM p""",
)
def _matrices(spark, d):
    w, h = 100 + F.col("p_size") * 8, 50 + F.col("p_size") * 4
    ww, wh = px.working_size(w, F.lit(3.0)), px.working_size(h, F.lit(3.0))
    m = px.to_native(F.lit(3.0), F.lit(4.0), w, h, ww, wh)
    p = px.applied(m, F.lit(7.0), F.lit(5.0))
    return table(spark, d, "part").select(
        "p_partkey", ww.alias("ww"), F.round(p["x"], 6).alias("x"), F.round(p["y"], 6).alias("y"), F.round(px.determinant(m), 6).alias("det"), px.working_gsd(F.lit(0.3), F.col("p_partkey") % 7 / 4.0).cast("double").alias("gsd"), px.full_load_bytes(h, w, F.lit(3), F.lit(2)).alias("bytes")
    )


@query(
    "clark_evans",
    """
WITH p AS (SELECT event_type AS k, event_id AS id, event_id * 7919 % 512 AS x, event_id * 104729 % 512 AS y FROM events),
n AS (SELECT a.k, a.id, min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS d FROM p a JOIN p b ON a.k = b.k AND a.id <> b.id GROUP BY 1, 2)
SELECT k, CAST(count(*) AS BIGINT) AS n, round(avg(d) / (0.5 * sqrt(512.0 * 512.0 / count(*))), 6) AS r FROM n GROUP BY 1""",
)
def _clark(spark, d):
    p = table(spark, d, "events").select(F.col("event_type").alias("k"), F.col("event_id").alias("id"), (F.col("event_id") * 7919 % 512).cast("double").alias("x"), (F.col("event_id") * 104729 % 512).cast("double").alias("y"))
    return ev.clark_evans(p, ["k"], 512.0, 512.0).select("k", "n", F.round("r", 6).alias("r"))


@query(
    "error_shares",
    """
WITH e AS (SELECT c_custkey, c_custkey % 13 / 4.0 AS dist, CASE WHEN c_custkey % 17 > 0 THEN c_custkey % 19 / 4.0 END AS fit FROM customer), s AS (SELECT *, CASE WHEN fit IS NOT NULL THEN sqrt(greatest(fit * fit - dist * dist, 0)) END AS corr FROM e)
SELECT c_custkey, round(corr, 6) AS correspondence_px, CASE WHEN fit IS NULL OR fit <= 0 OR (corr = 0 AND dist = 0) THEN NULL WHEN least(dist, corr) > 0 AND greatest(dist, corr) / least(dist, corr) <= 1.25 THEN NULL WHEN dist > corr THEN 'point distribution' ELSE 'correspondence error' END AS dominant FROM s""",
)
def _shares(spark, d):
    k = F.col("c_custkey")
    e = table(spark, d, "customer").select("c_custkey", (k % 13 / 4.0).alias("dist"), F.when(k % 17 > 0, k % 19 / 4.0).alias("fit"))
    return e.select("c_custkey", F.round(ev.correspondence(F.col("dist"), F.col("fit")), 6).alias("correspondence_px"), ev.dominant(F.col("dist"), F.col("fit")).alias("dominant"))


@query(
    "confidence_terms",
    """
WITH t AS (SELECT s_nationkey AS k, CASE WHEN s_suppkey % 50 = 0 THEN 'unknown' ELSE 'measured' END AS source, CASE WHEN s_suppkey % 50 > 0 THEN s_suppkey % 9 / 4.0 END AS sigma FROM supplier)
SELECT k, CASE WHEN count(*) FILTER (source = 'unknown') = 0 THEN round(sqrt(sum(sigma * sigma)), 6) END AS total, round(sqrt(coalesce(sum(sigma * sigma), 0)), 6) AS lower_bound FROM t GROUP BY 1""",
)
def _confidence(spark, d):
    key = F.col("s_suppkey")
    t = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.when(key % 50 == 0, "unknown").otherwise("measured").alias("source"), F.when(key % 50 > 0, key % 9 / 4.0).alias("sigma"))
    return ev.confidence(t, ["k"]).select("k", F.round("total", 6).alias("total"), F.round("lower_bound", 6).alias("lower_bound"))


@query(
    "stage_sweep",
    "SELECT l_returnflag AS chain, round(sqrt(avg(l_tax * l_tax) FILTER (l_linestatus = 'F')), 9) AS fit, round(sqrt(avg(l_tax * l_tax) FILTER (l_linestatus = 'O')), 9) AS oracle FROM lineitem GROUP BY 1",
)
def _sweep(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("chain"), F.when(F.col("l_linestatus") == "F", "fit").otherwise("oracle").alias("stage")).agg(F.sqrt(F.avg(F.col("l_tax") * F.col("l_tax"))).alias("rmse_px"))
    return ev.sweep(rows, ["fit", "oracle"]).select("chain", F.round("fit", 9).alias("fit"), F.round("oracle", 9).alias("oracle"))
