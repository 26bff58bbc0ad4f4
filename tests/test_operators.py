import math

import pytest
from pyspark.sql import functions as F

from mosaiq.functions import geodesy as G
from mosaiq.operators import outcomes, ranking, raster
from mosaiq.operators.uniformity import uniformity


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_uniformity_of_one_point_and_of_a_full_grid(spark):
    one_point = spark.createDataFrame([("a", 0.5, 0.5)], "k string, x double, y double")
    r = uniformity(one_point, ["k"], "x", "y", 4.0, 4.0, grid=2).first()
    assert (r["n_in"], r["coverage"], r["entropy"]) == (1, 0.25, 0.0)
    full = spark.createDataFrame([("a", x + 0.5, y + 0.5) for x in range(4) for y in range(4)], "k string, x double, y double")
    r = uniformity(full, ["k"], "x", "y", 4.0, 4.0, grid=4).first()
    assert r["coverage"] == 1.0 and abs(r["score"] - 1) < 1e-12 and abs(r["cv"]) < 1e-9


def test_adaptive_grid_and_points_out_of_frame(spark):
    df = spark.createDataFrame([("a", float(i), 0.0) for i in range(-3, 9)], "k string, x double, y double")
    r = uniformity(df, ["k"], "x", "y", 9.0, 9.0, grid=8, adaptive=True).first()
    assert (r["n_in"], r["grid"]) == (9, 3)


def test_verify_gives_every_status(spark):
    a = spark.createDataFrame([(1, 5, "x"), (2, 5, "x"), (3, 5, "x"), (4, 5, "x")], "k long, s long, h string")
    b = spark.createDataFrame([(1, 5, "x"), (2, 6, "x"), (3, 5, "y"), (9, 1, "z")], "k long, s long, h string")
    got = {r["k"]: r["status"] for r in outcomes.verify(a, b, "k", "s", "h").collect()}
    assert got == {1: "OK", 2: "SIZE_MISMATCH", 3: "HASH_MISMATCH", 4: "MISSING", 9: "UNRECORDED"}


def test_tally_and_zero_counts(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), (None, 5)], "s string, i int")
    t = outcomes.tally(df, "s", F.col("i"), F.col("i"))
    assert {r["s"]: (r["n"], r["first_sample"]) for r in t.collect()} == {"a": (2, 1), None: (1, 5)}
    z = outcomes.with_zeros(t.select("s", "n"), "s", ["a", "b"])
    assert {r["s"]: r["n"] for r in z.collect()} == {"a": 2, "b": 0}


def test_cap_keeps_ties_by_order_and_empty_input(spark):
    df = spark.createDataFrame([("a", 1, 3), ("a", 1, 1), ("a", 0, 2)], "g string, v int, i int")
    assert sorted(r["i"] for r in ranking.cap(df, ["g"], [F.col("v").desc(), F.col("i")], 2).collect()) == [1, 3]
    assert ranking.cap(df.limit(0), ["g"], [F.col("v")], 2).count() == 0


@pytest.mark.parametrize("extent,starts", [(100, [0]), (256, [0]), (257, [0, 1]), (448, [0, 192]), (500, [0, 192, 244])])
def test_tile_starts(spark, extent, starts):
    df = spark.createDataFrame([(1, extent, 10)], "k int, h int, w int")
    assert sorted(r["row_off"] for r in raster.plan_tiles(df, "k", "h", "w", 256).collect()) == starts


def test_stretch_of_flat_and_masked_images(spark):
    c = {n: F.lit(float(v)) for n, v in (("lo", 2), ("hi", 2), ("v", 9))}
    assert one(spark, x=raster.stretched(c["v"], c["lo"], c["hi"]))["x"] == 0
    assert one(spark, x=raster.stretched_masked(c["v"], c["lo"], c["hi"], F.lit(True)))["x"] == 255
    assert one(spark, x=raster.stretched_masked(c["v"], c["lo"], c["hi"], F.lit(False)))["x"] == 0


def test_angles_rings_and_projection(spark):
    r = one(spark, a=G.lon_to_360(F.lit(-10.0)), b=G.lon_to_180(F.lit(190.0)), c=G.circular_distance(F.lit(350.0), F.lit(20.0)))
    assert (r["a"], r["b"], r["c"]) == (350.0, -170.0, 30.0)
    lat, lon = G.inverse_polar_stereographic(F.lit(0.0), F.lit(0.0), north=True)
    assert tuple(one(spark, lat=lat, lon=lon)) == (90.0, 0.0)
    ring = F.array(*[F.struct(F.lit(float(a)).alias("lat"), F.lit(float(b)).alias("lon")) for a, b in ((0, 0), (0, 1), (1, 1), (1, 0))])
    r = one(spark, area=G.spherical_area_km2(ring), inside=G.point_in_ring(F.lit(0.5), F.lit(0.5), ring), out=G.point_in_ring(F.lit(1.5), F.lit(0.5), ring))
    side = math.radians(1) * G.MOON_RADIUS_M / 1000
    assert abs(r["area"] / side**2 - 1) < 1e-3 and r["inside"] and not r["out"]


def test_wkt_refuses_other_shapes(spark):
    for text in ("POINT (1 2)", "POLYGON EMPTY", "", None):
        assert one(spark, r=G.ring_from_wkt(F.lit(text).cast("string")))["r"] is None
