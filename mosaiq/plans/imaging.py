"""Pixel statistics, geometry, fits and matching."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mosaiq.functions import geodesy as G
from mosaiq.operators import raster as R
from mosaiq.operators.matching import knn2, mutual
from mosaiq.operators.uniformity import uniformity
from mosaiq.plans.catalogue import query
from mosaiq.session import table


def _events(spark, d):
    return table(spark, d, "events").select("event_id", F.col("event_type").alias("k"), F.col("value").alias("v"))


@query(
    "cell_histogram",
    "WITH c AS (SELECT CAST(trunc((l_quantity - 1) / 50 * 8) AS INT) AS row, CAST(trunc((l_discount + 0.0) / 0.11 * 8) AS INT) AS col FROM lineitem) SELECT CAST(r.i AS INT) AS row, CAST(q.i AS INT) AS col, CAST(count(c.row) AS BIGINT) AS n FROM range(8) r(i) CROSS JOIN range(8) q(i) LEFT JOIN c ON c.row = r.i AND c.col = q.i GROUP BY ALL",
)
def _cells(spark, d):
    df = table(spark, d, "lineitem").select(((F.col("l_quantity") - 1) / 50 * 8).cast("int").alias("row"), ((F.col("l_discount") + 0.0) / 0.11 * 8).cast("int").alias("col"))
    counts = df.groupBy("row", "col").agg(F.count("*").alias("n"))
    grid = spark.range(64).select((F.col("id") / 8).cast("int").alias("row"), (F.col("id") % 8).cast("int").alias("col"))
    return grid.join(counts, ["row", "col"], "left").select("row", "col", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    "uniformity_profile",
    """
WITH p AS (SELECT event_type AS k, (extract('day' FROM ts) - 1) / 31.0 AS x, value / 500.0 AS y FROM events), i AS (SELECT k, g, least(g - 1, CAST(trunc(x * g) AS INT)) AS c, least(g - 1, CAST(trunc(y * g) AS INT)) AS r FROM p, (VALUES (4),(8),(16)) t(g) WHERE x >= 0 AND x < 1 AND y >= 0 AND y < 1),
n AS (SELECT k, g, c, r, count(*) AS n FROM i GROUP BY ALL)
SELECT k AS group_key, CAST(g AS INT) AS grid, CAST(sum(n) AS BIGINT) AS n_in, round(count(*) / CAST(g * g AS DOUBLE), 8) AS coverage, round((ln(sum(n)) - sum(n * ln(n)) / sum(n)) / ln(g * g), 8) AS entropy FROM n GROUP BY k, g""",
)
def _profile(spark, d):
    points = table(spark, d, "events").select(F.col("event_type").alias("k"), ((F.dayofmonth("ts") - 1) / F.lit(31.0)).alias("x"), (F.col("value") / 500.0).alias("y"))
    out = None
    for g in (4, 8, 16):
        u = uniformity(points, ["k"], "x", "y", 1.0, 1.0, grid=g).select(F.col("k").alias("group_key"), "grid", "n_in", F.round("coverage", 8).alias("coverage"), F.round("entropy", 8).alias("entropy"))
        out = u if out is None else out.unionByName(u)
    return out


@query(
    "registration_metrics",
    "WITH r AS (SELECT l_returnflag AS k, sqrt(pow(l_quantity * 1.01 - l_quantity, 2) + pow(l_discount * 10, 2)) AS e, l_linenumber <= 4 AS inlier FROM lineitem) SELECT k, count(*) AS n_matches, count(*) FILTER (WHERE inlier) AS n_inliers, round(sqrt(avg(e * e) FILTER (WHERE inlier)), 8) AS rmse, round(avg(e) FILTER (WHERE inlier), 8) AS mae, round(quantile_cont(e, 0.5) FILTER (WHERE inlier), 8) AS median, round(quantile_cont(e, 0.95) FILTER (WHERE inlier), 8) AS p95, round(max(e) FILTER (WHERE inlier), 8) AS max FROM r GROUP BY k",
)
def _metrics(spark, d):
    e = F.sqrt(F.pow(F.col("l_quantity") * 1.01 - F.col("l_quantity"), 2) + F.pow(F.col("l_discount") * 10, 2))
    r = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("k"), F.when(F.col("l_linenumber") <= 4, e).alias("e"))
    q = F.percentile("e", F.array(F.lit(0.5), F.lit(0.95)))
    out = r.groupBy("k").agg(F.count("*").alias("n_matches"), F.count("e").alias("n_inliers"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.avg("e").alias("mae"), q.alias("_q"), F.max("e").alias("max"))
    return out.select("k", "n_matches", "n_inliers", *[F.round(c, 8).alias(n) for n, c in (("rmse", F.col("rmse")), ("mae", F.col("mae")), ("median", F.col("_q")[0]), ("p95", F.col("_q")[1]), ("max", F.col("max")))])


_STRETCH = "WITH l AS (SELECT event_type AS k, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM events GROUP BY 1) "


@query("percentile_stretch", _STRETCH + "SELECT k, CAST(CASE WHEN hi <= lo THEN 0 ELSE trunc((least(greatest(value, lo), hi) - lo) / (hi - lo) * 255) END AS INT) AS level, count(*) AS n FROM events JOIN l ON k = event_type GROUP BY ALL")
def _stretch(spark, d):
    e = _events(spark, d)
    x = e.join(R.limits(e, ["k"], "v", 0.01, 0.99), "k")
    return x.groupBy("k", R.stretched(F.col("v"), F.col("lo"), F.col("hi")).alias("level")).agg(F.count("*").alias("n"))


@query(
    "percentile_stretch_masked",
    "WITH l AS (SELECT event_type AS k, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM events WHERE event_id % 7 <> 0 GROUP BY 1) SELECT k, CAST(CASE WHEN event_id % 7 = 0 THEN 0 ELSE trunc(least(greatest((value - lo) / greatest(hi - lo, 1e-6) * 254 + 1, 1), 255)) END AS INT) AS level, count(*) AS n FROM events JOIN l ON k = event_type GROUP BY ALL",
)
def _stretch_masked(spark, d):
    e = _events(spark, d)
    valid = F.col("event_id") % 7 != 0
    x = e.join(R.limits(e.filter(valid), ["k"], "v", 0.01, 0.99), "k")
    return x.groupBy("k", R.stretched_masked(F.col("v"), F.col("lo"), F.col("hi"), valid).alias("level")).agg(F.count("*").alias("n"))


@query("zscore_per_group", "SELECT event_id, round(CASE WHEN s < 1e-8 THEN 0 ELSE (value - m) / s END, 6) AS z FROM events JOIN (SELECT event_type AS k, avg(value) AS m, stddev_pop(value) AS s FROM events GROUP BY 1) ON k = event_type")
def _z(spark, d):
    e = _events(spark, d)
    s = e.groupBy("k").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    return e.join(s, "k").select("event_id", F.round(R.zscore(F.col("v"), F.col("m"), F.col("s")), 6).alias("z"))


@query("shadow_mask", "SELECT event_type AS k, count(*) FILTER (WHERE value <= t) AS n_shadow, count(*) AS n FROM events JOIN (SELECT event_type AS k, quantile_cont(value, 0.05) AS t FROM events GROUP BY 1) ON k = event_type GROUP BY 1")
def _shadow(spark, d):
    e = _events(spark, d)
    return e.join(R.limits(e, ["k"], "v", 0.05, 1.0), "k").groupBy("k").agg(F.count_if(F.col("v") <= F.col("lo")).alias("n_shadow"), F.count("*").alias("n"))


@query(
    "shadow_gamma",
    "SELECT event_id, round(CASE WHEN hi > lo AND t - lo > 1e-6 AND value <= t THEN lo + pow(least(greatest((value - lo) / (t - lo), 0), 1), 0.5) * (t - lo) ELSE value END, 6) AS v FROM events JOIN (SELECT event_type AS k, min(value) AS lo, max(value) AS hi, quantile_cont(value, 0.05) AS t FROM events GROUP BY 1) ON k = event_type",
)
def _gamma(spark, d):
    e = _events(spark, d)
    s = e.groupBy("k").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.percentile("v", 0.05).alias("t"))
    return e.join(s, "k").select("event_id", F.round(R.shadow_gamma(F.col("v"), F.col("lo"), F.col("t"), F.col("hi")), 6).alias("v"))


@query("shadow_suppress", "SELECT event_id, round(greatest(value, t), 6) AS v FROM events JOIN (SELECT event_type AS k, quantile_cont(value, 0.05) AS t FROM events GROUP BY 1) ON k = event_type")
def _suppress(spark, d):
    e = _events(spark, d)
    return e.join(R.limits(e, ["k"], "v", 0.05, 1.0), "k").select("event_id", F.round(F.greatest("v", "lo"), 6).alias("v"))


@query("shadow_severity", "SELECT k, round(CAST(count(*) FILTER (WHERE hi > lo AND (value - lo) / (hi - lo) < 0.15) AS DOUBLE) / count(*), 8) AS severity FROM events JOIN (SELECT event_type AS k, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1) ON k = event_type GROUP BY k")
def _severity(spark, d):
    e = _events(spark, d)
    s = e.join(e.groupBy("k").agg(F.min("v").alias("lo"), F.max("v").alias("hi")), "k")
    dark = F.when(F.col("hi") > F.col("lo"), (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) < 0.15).otherwise(False)
    return s.groupBy("k").agg(F.round(F.avg(dark.cast("double")), 8).alias("severity"))


@query("log_transform", "SELECT event_id, CAST(trunc(least(greatest(255 / ln(1 + peak) * ln(1 + greatest(value - base, 0)), 0), 255)) AS INT) AS level FROM events JOIN (SELECT event_type AS k, least(0, min(value)) AS base, max(value) - least(0, min(value)) AS peak FROM events GROUP BY 1) ON k = event_type")
def _log(spark, d):
    e = _events(spark, d)
    s = e.groupBy("k").agg(F.least(F.lit(0.0), F.min("v")).alias("base"), (F.max("v") - F.least(F.lit(0.0), F.min("v"))).alias("peak"))
    level = F.when(F.col("peak") <= 0, 0).otherwise(F.least(F.greatest(255 / F.log(1 + F.col("peak")) * F.log(1 + F.greatest(F.col("v") - F.col("base"), F.lit(0.0))), F.lit(0.0)), F.lit(255.0)).cast("int"))
    return e.join(s, "k").select("event_id", level.alias("level"))


@query("invert_levels", "SELECT event_id, 255 - CAST(least(trunc(value), 255) AS INT) AS plain, CASE WHEN event_id % 7 = 0 THEN 0 ELSE least(greatest(256 - CAST(least(trunc(value), 255) AS INT), 1), 255) END AS masked FROM events")
def _invert(spark, d):
    v = F.least(F.col("v").cast("int"), F.lit(255))
    return _events(spark, d).select("event_id", (255 - v).alias("plain"), F.when(F.col("event_id") % 7 == 0, 0).otherwise(F.least(F.greatest(256 - v, F.lit(1)), F.lit(255))).alias("masked"))


@query(
    "histogram_match",
    """
WITH s AS (SELECT CAST(trunc((p_retailprice - 900) * 2.55) AS INT) AS v, p_partkey % 2 AS side FROM part), c AS (SELECT side, v, count(*) AS n FROM s GROUP BY ALL),
f AS (SELECT side, v, sum(n) OVER (PARTITION BY side ORDER BY v) / CAST(sum(n) OVER (PARTITION BY side) AS DOUBLE) AS f FROM c)
SELECT a.v, coalesce(min(b.v), 255) AS matched FROM f a LEFT JOIN f b ON b.side = 1 AND b.f >= a.f WHERE a.side = 0 GROUP BY a.v""",
)
def _match(spark, d):
    p = table(spark, d, "part").select(((F.col("p_retailprice") - 900) * 2.55).cast("int").alias("v"), (F.col("p_partkey") % 2).alias("side"))
    return R.match_levels(p.filter("side = 0"), p.filter("side = 1"))


@query(
    "tile_plan",
    """
WITH p AS (SELECT p_partkey, p_size * 20 AS h, p_size * 13 AS w FROM part), s AS (SELECT p_partkey, h, w, CASE WHEN h <= 256 THEN [0] ELSE list_distinct(list_concat(range(0, h - 256 + 1, 192), [h - 256])) END AS rs, CASE WHEN w <= 256 THEN [0] ELSE list_distinct(list_concat(range(0, w - 256 + 1, 192), [w - 256])) END AS cs FROM p)
SELECT p_partkey, CAST(r AS INT) AS row_off, CAST(c AS INT) AS col_off, least(256, h) AS height, least(256, w) AS width FROM (SELECT p_partkey, h, w, cs, unnest(rs) AS r FROM s) x, unnest(cs) t(c)""",
)
def _tiles(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 20).alias("h"), (F.col("p_size") * 13).alias("w"))
    return R.plan_tiles(p, "p_partkey", "h", "w", 256).select("p_partkey", "row_off", "col_off", "height", "width")


_GRID = "g AS (SELECT CAST(extract('day' FROM ts) AS INT) AS r, CAST(user_id % 40 AS INT) AS c, max(value) AS v FROM events GROUP BY 1, 2)"


def _grid(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.dayofmonth("ts").alias("r"), (F.col("user_id") % 40).cast("int").alias("c")).agg(F.max("value").alias("v"))


@query("max_filter", f"WITH {_GRID} SELECT a.r, a.c, max(b.v) AS v FROM g a JOIN g b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 GROUP BY 1, 2")
def _dilate(spark, d):
    return R.dilate(_grid(spark, d), [], "r", "c", "v")


@query("area_resample", f"WITH {_GRID} SELECT CAST(floor(r / 4) AS BIGINT) AS r, CAST(floor(c / 4) AS BIGINT) AS c, round(avg(v), 6) AS v, count(*) AS n FROM g GROUP BY 1, 2")
def _resample(spark, d):
    return R.area_mean(_grid(spark, d), [], "r", "c", "v", 4).withColumn("v", F.round("v", 6))


@query("edge_priority", "SELECT l_orderkey, l_linenumber, l_quantity, l_discount, round(least(least(l_quantity, l_discount * 100), least(50 - l_quantity, 10 - l_discount * 100)), 6) AS edge FROM lineitem")
def _edge(spark, d):
    x, y = F.col("l_quantity"), F.col("l_discount") * 100
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", F.round(F.least(x, y, 51 - 1 - x, 11 - 1 - y), 6).alias("edge"))


@query("homography_apply", "SELECT l_returnflag, round(sum((1.02 * l_quantity + 0.01 * l_tax + 12) / (0.001 * l_quantity + 1)), 4) AS sx, round(sum((-0.015 * l_quantity + 0.99 * l_tax - 7) / (0.001 * l_quantity + 1)), 4) AS sy FROM lineitem GROUP BY 1")
def _homography(spark, d):
    x, y = G.homography([1.02, 0.01, 12.0, -0.015, 0.99, -7.0, 0.001, 0.0, 1.0], F.col("l_quantity"), F.col("l_tax"))
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum(x), 4).alias("sx"), F.round(F.sum(y), 4).alias("sy"))


@query("lon_wraps", "SELECT c_custkey, round(a - floor(a / 360) * 360, 6) AS lon360, round((a + 180) - floor((a + 180) / 360) * 360 - 180, 6) AS lon180 FROM (SELECT c_custkey, c_acctbal / 7 AS a FROM customer)")
def _wraps(spark, d):
    a = F.col("c_acctbal") / 7
    return table(spark, d, "customer").select("c_custkey", F.round(G.lon_to_360(a), 6).alias("lon360"), F.round(G.lon_to_180(a), 6).alias("lon180"))


@query("circular_diff", "SELECT c_custkey, d, CASE WHEN d >= 10 THEN 'local_contrast' ELSE 'none' END AS prefilter FROM (SELECT c_custkey, least(x, 360 - x) AS d FROM (SELECT c_custkey, CAST(abs(c_custkey * 37 % 360 - c_nationkey * 101 % 360) % 360 AS DOUBLE) AS x FROM customer))")
def _circular(spark, d):
    dist = G.circular_distance((F.col("c_custkey") * 37 % 360).cast("double"), (F.col("c_nationkey") * 101 % 360).cast("double"))
    return table(spark, d, "customer").select("c_custkey", dist.alias("d"), F.when(dist >= 10, "local_contrast").otherwise("none").alias("prefilter"))


_RING = [(10.0, 5.0), (20.0, 60.0), (45.0, 80.0), (40.0, 20.0)]


def _ring():
    return F.array(*[F.struct(F.lit(a).alias("lat"), F.lit(b).alias("lon")) for a, b in _RING])


def _crossing(i: int) -> str:
    (la, lo), (lb, ob) = _RING[i], _RING[i - 1]
    return f"CASE WHEN ({la} > lat) <> ({lb} > lat) AND lon < ({ob} - {lo}) * (lat - {la}) / ({lb} - {la}) + {lo} THEN 1 ELSE 0 END"


@query("point_in_ring", "SELECT count(*) AS n, CAST(sum(" + " + ".join(f"({_crossing(i)})" for i in range(4)).join(("CASE WHEN (", ") % 2 = 1 THEN 1 ELSE 0 END")) + ") AS BIGINT) AS n_inside FROM (SELECT CAST(o_custkey % 60 AS DOUBLE) AS lat, CAST(o_orderkey % 97 AS DOUBLE) AS lon FROM orders)")
def _inside(spark, d):
    p = table(spark, d, "orders").select((F.col("o_custkey") % 60).cast("double").alias("lat"), (F.col("o_orderkey") % 97).cast("double").alias("lon"))
    return p.agg(F.count("*").alias("n"), F.count_if(G.point_in_ring(F.col("lat"), F.col("lon"), _ring())).alias("n_inside"))


_AREA = " + ".join(f"radians(({b1} + s) - ({b0} + s)) * (2 + sin(radians({a0} + s)) + sin(radians({a1} + s)))" for (a0, b0), (a1, b1) in zip(_RING, _RING[1:] + _RING[:1]))


@query("spherical_area", f"SELECT n_nationkey, round(abs({_AREA}) * 1737400.0 * 1737400.0 / 2 / 1e6, 3) AS area_km2 FROM (SELECT n_nationkey, n_nationkey / 2.0 AS s FROM nation)")
def _area(spark, d):
    n = table(spark, d, "nation").withColumn("ring", F.transform(_ring(), lambda p: F.struct((p["lat"] + F.col("n_nationkey") / 2).alias("lat"), (p["lon"] + F.col("n_nationkey") / 2).alias("lon"))))
    return n.select("n_nationkey", F.round(G.spherical_area_km2(F.col("ring")), 3).alias("area_km2"))


@query("wkt_roundtrip", "SELECT n_nationkey, printf('POLYGON ((%.9f %.9f, %.9f %.9f, %.9f %.9f, %.9f %.9f))', n_nationkey * 1.0, 1.0, n_nationkey + 2.0, 1.0, n_nationkey + 1.0, 3.5, n_nationkey * 1.0, 1.0) AS wkt, CAST(3 AS INT) AS n_vertices, CAST(n_nationkey + 2.0 AS DOUBLE) AS second_lon FROM nation")
def _wkt(spark, d):
    k = F.col("n_nationkey").cast("double")
    ring = F.array(*[F.struct(F.lit(a).alias("lat"), b.alias("lon")) for a, b in ((1.0, k), (1.0, k + 2), (3.5, k + 1))])
    n = table(spark, d, "nation").select("n_nationkey", G.wkt_polygon(ring).alias("wkt")).withColumn("back", G.ring_from_wkt(F.col("wkt")))
    return n.select("n_nationkey", "wkt", F.size("back").alias("n_vertices"), F.col("back")[1]["lon"].alias("second_lon"))


@query(
    "polar_stereo_inverse",
    "SELECT x, y, round(CASE WHEN rho = 0 THEN -90 ELSE degrees(asin(-cos(2 * atan2(rho, 2 * 1737400.0)))) END, 8) AS lat, round(CASE WHEN rho = 0 THEN 0 ELSE degrees(atan2(x, y)) END, 8) AS lon FROM (SELECT *, sqrt(x * x + y * y) AS rho FROM (SELECT CAST(a.n_nationkey - 12 AS DOUBLE) * 20000 AS x, CAST(b.n_nationkey - 12 AS DOUBLE) * 30000 AS y FROM nation a, nation b))",
)
def _polar(spark, d):
    n = table(spark, d, "nation").select("n_nationkey")
    g = n.alias("a").crossJoin(n.alias("b")).select(((F.col("a.n_nationkey") - 12).cast("double") * 20000).alias("x"), ((F.col("b.n_nationkey") - 12).cast("double") * 30000).alias("y"))  # 625 literal nodes
    lat, lon = G.inverse_polar_stereographic(F.col("x"), F.col("y"), north=False)
    return g.select("x", "y", F.round(lat, 8).alias("lat"), F.round(lon, 8).alias("lon"))


@query(
    "affine_lsq",
    "SELECT l_returnflag AS k, count(*) AS n, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS shift FROM (SELECT l_returnflag, l_quantity AS x, l_extendedprice AS y FROM lineitem) GROUP BY 1",
)
def _lsq(spark, d):
    df = table(spark, d, "lineitem")
    return df.groupBy(F.col("l_returnflag").alias("k")).agg(F.count("*").alias("n"), F.round(F.regr_slope("l_extendedprice", "l_quantity"), 6).alias("slope"), F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 6).alias("shift"))


@query("memory_profile_fit", "SELECT p_brand AS matcher, count(*) AS n_ok, round(regr_slope(p_retailprice * 1000 + p_size * p_size * 3.5, p_size * p_size), 6) AS bytes_per_px, round(regr_intercept(p_retailprice * 1000 + p_size * p_size * 3.5, p_size * p_size), 3) AS fixed FROM part GROUP BY 1 HAVING count(*) >= 3 AND count(DISTINCT p_size) >= 2")
def _memory(spark, d):
    area, peak = F.col("p_size") * F.col("p_size"), F.col("p_retailprice") * 1000 + F.col("p_size") * F.col("p_size") * 3.5
    out = table(spark, d, "part").groupBy(F.col("p_brand").alias("matcher")).agg(F.count("*").alias("n_ok"), F.countDistinct("p_size").alias("_d"), F.round(F.regr_slope(peak, area), 6).alias("bytes_per_px"), F.round(F.regr_intercept(peak, area), 3).alias("fixed"))
    return out.filter("n_ok >= 3 and _d >= 2").drop("_d")


@query("scaling_exponent", "SELECT p_type, round(regr_slope(ln(p_retailprice * p_size), ln(p_size)), 6) AS exponent FROM part GROUP BY 1")
def _exponent(spark, d):
    return table(spark, d, "part").groupBy("p_type").agg(F.round(F.regr_slope(F.log(F.col("p_retailprice") * F.col("p_size")), F.log("p_size")), 6).alias("exponent"))


@query(
    "largest_fitting_tile",
    "SELECT p_partkey, CAST(coalesce(max(t) FILTER (WHERE greatest(trunc(p_retailprice * 1e5 + 3000.0 * t * t), 1) <= p_size * 2e8 * 0.75), 256) AS INT) AS tile FROM part, (SELECT 1408 - 64 * i AS t FROM range(19) r(i)) WHERE t >= 256 GROUP BY 1",
)
def _largest(spark, d):
    sizes = F.sequence(F.lit(1408), F.lit(256), F.lit(-64))
    fits = F.filter(sizes, lambda t: F.greatest((F.col("p_retailprice") * 1e5 + 3000.0 * t * t).cast("long"), F.lit(1)) <= F.col("p_size") * 2e8 * 0.75)
    return table(spark, d, "part").select("p_partkey", F.coalesce(F.array_max(fits), F.lit(256)).alias("tile"))


@query("rss_budget", "SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE round(sqrt(s_acctbal * s_acctbal + (5.0 / sqrt(12)) * (5.0 / sqrt(12)) + s_nationkey * s_nationkey), 6) END AS total_sigma, round(sqrt(CASE WHEN s_suppkey % 7 = 0 THEN 0 ELSE s_acctbal * s_acctbal END + (5.0 / sqrt(12)) * (5.0 / sqrt(12)) + s_nationkey * s_nationkey), 6) AS lower_bound FROM supplier")
def _rss(spark, d):
    known = F.when(F.col("s_suppkey") % 7 != 0, F.col("s_acctbal"))
    q = 5.0 / F.sqrt(F.lit(12.0))
    rest = q * q + F.col("s_nationkey") * F.col("s_nationkey")
    return table(spark, d, "supplier").select("s_suppkey", F.round(F.sqrt(known * known + rest), 6).alias("total_sigma"), F.round(F.sqrt(F.coalesce(known * known, F.lit(0.0)) + rest), 6).alias("lower_bound"))


@query(
    "border_mode_share",
    """
SELECT l_returnflag AS img, border, v, n, round(CAST(n AS DOUBLE) / total, 8) AS share FROM (SELECT l_returnflag, l_linenumber IN (1, 7) AS border, l_quantity AS v, count(*) AS n, sum(count(*)) OVER (PARTITION BY l_returnflag, l_linenumber IN (1, 7)) AS total,
 row_number() OVER (PARTITION BY l_returnflag, l_linenumber IN (1, 7) ORDER BY count(*) DESC, l_quantity) AS rn FROM lineitem GROUP BY 1, 2, 3) WHERE rn <= 5""",
)
def _border(spark, d):
    pixels = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("img"), F.col("l_linenumber").isin(1, 7).alias("border"), F.col("l_quantity").alias("v"))
    return R.mode_shares(pixels, ["img", "border"], "v", 5).withColumn("share", F.round("share", 8))


@query("grid_assembly", "SELECT r, c, min_by(l_quantity, l_orderkey * 100000000 + l_partkey * 1000 + l_suppkey % 1000) AS first_v, count(*) - 1 AS n_duplicates FROM (SELECT CAST(l_orderkey % 50 AS INT) AS r, l_linenumber AS c, * FROM lineitem) GROUP BY 1, 2")
def _assembly(spark, d):
    ordinal = F.col("l_orderkey") * 100000000 + F.col("l_partkey") * 1000 + F.col("l_suppkey") % 1000
    return table(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 50).cast("int").alias("r"), F.col("l_linenumber").alias("c")).agg(F.min_by("l_quantity", ordinal).alias("first_v"), (F.count("*") - 1).alias("n_duplicates"))


@query(
    "band_mean",
    "SELECT vec_id, round(list_avg(embedding::DOUBLE[]), 8) AS band_mean, CAST(list_position(embedding, list_max(embedding)) - 1 AS INT) AS strongest FROM embeddings",
)
def _bands(spark, d):
    v = F.col("embedding").cast("array<double>")
    total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    return table(spark, d, "embeddings").select("vec_id", F.round(total / F.size(v), 8).alias("band_mean"), (F.array_position("embedding", F.array_max("embedding")) - 1).cast("int").alias("strongest"))


@query(
    "band_select",
    "SELECT CAST(i - 1 AS INT) AS band, round(avg(x), 8) AS mean, round(stddev_pop(x), 8) AS std, CAST(row_number() OVER (ORDER BY stddev_pop(x) DESC, i) AS INT) AS rank FROM (SELECT unnest(range(1, 65)) AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings) GROUP BY i",
)
def _band_select(spark, d):
    b = table(spark, d, "embeddings").select(F.posexplode(F.col("embedding").cast("array<double>")).alias("band", "x")).groupBy("band").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    return b.select("band", F.round("m", 8).alias("mean"), F.round("s", 8).alias("std"), F.row_number().over(Window.orderBy(F.col("s").desc(), "band")).alias("rank"))  # one row a band


_KNN = """
WITH q AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE label < 5), t AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE label >= 5),
d AS (SELECT q.vec_id AS a, t.vec_id AS b, list_distance(q.v, t.v) AS d FROM q, t),
f AS (SELECT a, b, d, lead(d) OVER (PARTITION BY a ORDER BY d, b) AS d2, row_number() OVER (PARTITION BY a ORDER BY d, b) AS rn FROM d),
g AS (SELECT a, b, d, lead(d) OVER (PARTITION BY b ORDER BY d, a) AS d2, row_number() OVER (PARTITION BY b ORDER BY d, a) AS rn FROM d)
"""


def _sides(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")
    return e.filter("label < 5"), e.filter("label >= 5")


@query("knn2_ratio", _KNN + "SELECT a AS query_id, b AS train_id, round(d, 6) AS distance, round(1 - d / greatest(d2, 1e-9), 6) AS score FROM f WHERE rn = 1 AND d < 0.95 * d2")
def _knn(spark, d):
    q, t = _sides(spark, d)
    return knn2(q, t, ratio=0.95).select("query_id", "train_id", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"))


@query("knn_mutual", _KNN + "SELECT f.a AS query_id, f.b AS train_id, round(f.d, 6) AS distance FROM f JOIN g ON f.a = g.a AND f.b = g.b WHERE f.rn = 1 AND g.rn = 1 AND f.d < 0.95 * f.d2 AND g.d < 0.95 * g.d2")
def _mutual(spark, d):
    q, t = _sides(spark, d)
    return mutual(q, t, ratio=0.95).select("query_id", "train_id", F.round("distance", 6).alias("distance"))


@query("bbox_range_join", "SELECT s.s_suppkey, c.c_custkey FROM supplier s JOIN customer c ON abs(s.s_acctbal - c.c_acctbal) <= 3 AND abs(s.s_nationkey - c.c_nationkey) <= 2")
def _bbox(spark, d):
    """Closed boxes of half-width 3 on one axis: equi-join on bins of 6, each row offered to its neighbours' bins."""
    s = table(spark, d, "supplier").withColumn("bin", F.floor(F.col("s_acctbal") / 6))
    c = table(spark, d, "customer").withColumn("bin", F.explode(F.sequence(F.floor((F.col("c_acctbal") - 3) / 6), F.floor((F.col("c_acctbal") + 3) / 6))))
    both = s.join(c, "bin").filter((F.abs(F.col("s_acctbal") - F.col("c_acctbal")) <= 3) & (F.abs(F.col("s_nationkey") - F.col("c_nationkey")) <= 2))
    return both.select("s_suppkey", "c_custkey")
