import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaiq.functions import footprints as fp
from mosaiq.functions import pixels as px
from mosaiq.operators import overlap

RING = "array<struct<lat:double,lon:double>>"


def frame(spark, rings, box=()):
    rows = [(i, f"p{i}", None if r is None else [tuple(map(float, p)) for p in r], i in box) for i, r in enumerate(rings)]
    return spark.createDataFrame(rows, f"id long, product_id string, ring {RING}, from_box boolean")


def box(lat, lon, dlat, dlon):
    return [(lat, lon), (lat, lon + dlon), (lat + dlat, lon + dlon), (lat + dlat, lon)]


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def ring(points):
    return F.array(*[F.struct(F.lit(float(a)).alias("lat"), F.lit(float(b)).alias("lon")) for a, b in points])


def test_overlaps_of_boxes_seams_poles_and_bad_rings(spark):
    rings = [
        box(0, 10, 2, 2),
        box(1, 11, 2, 2),  # meets 0
        box(2, 10, 2, 1),  # touches 0, meets 1 (11 of width 0): touches
        box(0, -350, 1, 1),  # 0 in the other convention
        box(0, 179.5, 1, 1),
        [(0.2, -179.9), (0.2, -179.6), (0.8, -179.6), (0.8, -179.9)],  # inside 4 across the seam
        [(-85, 0), (-85, 90), (-85, 180), (-85, 270)],  # about the south pole
        [(-89, 10), (-89, 100), (-89, 190), (-89, 280)],
        [(5, 0), (5, 200), (6, 200), (6, 0)],  # antimeridian
        [(5, 0), (float("nan"), 1), (6, 1)],
        None,
        [(10, 10), (10, 14), (14, 14), (14, 10), (12, 12)],  # not convex
        [(9, 13), (13, 13), (13, 15), (11, 14), (9, 15)],
    ]
    a = frame(spark, rings)
    got = {(r["id_a"], r["id_b"]): r for r in overlap.overlaps(a).collect()}
    status = {k: r["status"] for k, r in got.items() if r["status"] != "DISJOINT"}
    assert status == {(0, 1): "OK", (0, 2): "TOUCHING_ONLY", (0, 3): "OK", (1, 3): "TOUCHING_ONLY", (1, 2): "TOUCHING_ONLY", (4, 5): "OK", (6, 7): "OK", (11, 12): "OK"}
    assert got[0, 3]["area_m2"] == pytest.approx(one(spark, fp.great_circle_area_m2(ring(box(0, 10, 1, 1))))[0], rel=1e-9)
    assert got[6, 7]["area_m2"] == pytest.approx(one(spark, fp.great_circle_area_m2(ring(rings[7])))[0], rel=1e-9) and got[6, 7]["reference_fraction"] == pytest.approx(1)
    counted = {r["status"]: r["n"] for r in overlap.outcomes(a).collect()}
    assert sum(counted.values()) == 13 * 12 // 2 and counted["OK"] == 5 and counted["TOUCHING_ONLY"] == 3
    assert counted["ANTIMERIDIAN"] == 12 and counted["INVALID_GEOMETRY"] == 1 + 2 * 10
    ids = [(r["id_a"], r["id_b"]) for r in overlap.usable(overlap.overlaps(a), 0.2).collect()]
    assert set(ids) == {(0, 1), (0, 3), (6, 7), (11, 12), (4, 5)} - {k for k, r in got.items() if r["source_fraction"] < 0.2}


def test_overlaps_against_all_pairs_clipped(spark):
    rng = np.random.default_rng(2)
    a = [box(rng.uniform(-88, 86), rng.uniform(-180, 350), rng.uniform(0.2, 3), rng.uniform(0.2, 6)) for _ in range(130)]
    b = [[(x + rng.uniform(-0.1, 0.1), y + rng.uniform(-0.1, 0.1)) for x, y in box(rng.uniform(-88, 86), rng.uniform(-180, 350), 4, 9)] for _ in range(130)]
    found = {(r["id_a"], r["id_b"]): r["area_m2"] for r in overlap.overlaps(frame(spark, a), frame(spark, b).withColumn("product_id", F.lit("q"))).collect() if r["status"] == "OK"}
    want = {}
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            u, v = np.array(x), np.array(y)
            polar = max(abs(u[:, 0]).max(), abs(v[:, 0]).max()) >= 80
            most = max([*u[:, 0], *v[:, 0]], key=abs)
            pole = math.copysign(90, most) if polar else None
            if polar and max(abs(pole - u[:, 0]).max(), abs(pole - v[:, 0]).max()) > 60:
                continue
            s, area, _ = overlap.meet(u, v, pole)
            if s == "OK":
                want[i, j] = area
    assert found.keys() == want.keys() and len(want) > 5
    assert all(found[k] == pytest.approx(want[k]) for k in want)


def test_boxes_meet_without_the_kernel_as_in_it(spark):
    rng = np.random.default_rng(7)
    a = [box(rng.integers(-70, 70), rng.integers(-180, 190), rng.integers(1, 8), rng.integers(1, 90)) for _ in range(90)]
    a += [[(x, y - 360 if y > 180 else y) for x, y in box(rng.integers(-9, 9), rng.integers(150, 180), 5, rng.integers(1, 30))] for _ in range(20)]
    a = [[(float(x), float(y)) for x, y in r] for r in a if not any(abs(u[1] - v[1]) > 180 for u in r for v in r)]
    a += [[(x + 1e-10, y) for x, y in a[0]], [(x, y + 360 if y < 0 else y - 360) for x, y in a[1]], a[2][::-1]]
    df = overlap.overlaps(frame(spark, a))
    assert "MapInPandas" not in df._jdf.queryExecution().toString()
    rows = df.collect()
    got = {(r["id_a"], r["id_b"]): r for r in rows}
    assert len(rows) == len(got)
    n = {"OK": 0, "TOUCHING_ONLY": 0, "DISJOINT": 0}
    for i, x in enumerate(a):
        for j in range(i + 1, len(a)):
            u, v = np.array(x), np.array(a[j])
            v[:, 1] += 360 * round((u[:, 1].mean() - v[:, 1].mean()) / 360)
            want, area, rings = overlap.meet(u, overlap._rewrap(v, u[:, 1].mean()), None) if abs(u[0, 1] - v[:, 1].mean()) < 180 else (None, 0, [])
            found = got.get((i, j))
            if want is None:
                continue
            assert (found["status"] if found else "DISJOINT") == want, (x, a[j])
            n[want] += 1
            if want == "OK":
                assert found["area_m2"] == pytest.approx(area, rel=1e-9)
                e, p = found["extent"], np.concatenate(rings)
                assert (e["max_lat"] - e["min_lat"], e["max_lon"] - e["min_lon"]) == pytest.approx(tuple(np.ptp(p, axis=0)))
                assert {(round(p["lat"], 6), round((p["lon"] + 720) % 360, 6)) for p in found["rings"][0]} == {(round(p, 6), round((q + 720) % 360, 6)) for p, q in rings[0]}
    assert min(n.values()) > 5


def test_sphere_functions(spark):
    cap = [(80.0, k) for k in range(0, 360)]
    area = one(spark, fp.great_circle_area_m2(ring(cap)))[0]
    assert area == pytest.approx(2 * math.pi * fp.MOON_RADIUS_M**2 * (1 - math.cos(math.radians(10))), rel=1e-3)
    lat, lon = F.lit(-85.0), F.lit(33.0)
    p = fp.to_plane(lat, lon, F.lit(-90.0))
    back = fp.to_sphere(p["lat"], p["lon"], F.lit(-90.0))
    assert one(spark, back["lat"], back["lon"]) == pytest.approx((-85, 33))
    assert one(spark, fp.rewrapped(ring([(0, 350), (1, 10), (2, 5)]), F.lit(0.0)))[0] == [(0, -10), (1, 10), (2, 5)]
    gap = fp.cap_gap_deg(fp.cap(ring(box(0, 0, 2, 2))), fp.cap(ring(box(0, 90, 2, 2))))
    assert 85 < one(spark, gap)[0] < 90
    s = fp.sun_direction(F.lit(0.0), F.lit(1.0), F.lit(1.0), F.lit(0.0), F.lit(90.0))
    assert one(spark, s["azimuth"], s["elevation"]) == pytest.approx((0, 45))
    assert one(spark, fp.grid_azimuth(F.lit(10.0), F.lit(1.0), F.lit(1.0)), fp.signed_difference(F.lit(350.0), F.lit(10.0)), fp.relon(F.lit(350.0), F.lit(0.0))) == pytest.approx((325, -20, -10))
    null = F.lit(None).cast("double")
    corners = [(F.lit(1.0), F.lit(i * 1.0)) for i in range(3)]
    found = fp.ring_of([*corners, (null, null)], F.lit(None).cast(RING), (F.lit(0.0), F.lit(1.0), F.lit(2.0), F.lit(3.0)))
    assert one(spark, found["from_box"], F.size(found["ring"])) == (True, 4)
    grid = fp.ground_grid(ring(box(0, 0, 1, 1)), 10_000.0)
    assert one(spark, F.size(grid))[0] == 16
    e = fp.extent_m(ring(box(-1, 0, 2, 3)))
    assert one(spark, e["ns"], e["ew"]) == pytest.approx((2 * fp.METRES_PER_DEGREE, 3 * fp.METRES_PER_DEGREE))


def test_pixel_matrices(spark):
    lit = lambda v: F.lit(float(v))
    n = px.to_native(lit(10), lit(20), lit(400), lit(200), lit(100), lit(100))
    want = np.array([[4, 0, 11.5], [0, 2, 20.5], [0, 0, 1.0]])
    assert one(spark, n)[0] == want.ravel().tolist()
    assert np.allclose(one(spark, px.inverse(n))[0], np.linalg.inv(want).ravel())
    h = F.array(*map(F.lit, [1.1, 0.02, 3.0, -0.01, 0.9, 4.0, 1e-4, 2e-4, 1.0]))
    H = np.array([1.1, 0.02, 3.0, -0.01, 0.9, 4.0, 1e-4, 2e-4, 1.0]).reshape(3, 3)
    assert np.allclose(one(spark, px.lifted(h, n, n))[0], (want @ H @ np.linalg.inv(want)).ravel())
    assert one(spark, px.resized(lit(100), lit(50), lit(50), lit(100)))[0] == [0.5, 0, -0.25, 0, 2, 0.5, 0, 0, 1]
    p = px.applied(h, lit(5), lit(6))
    v = H @ [5, 6, 1]
    assert one(spark, p["x"], p["y"]) == pytest.approx((v[0] / v[2], v[1] / v[2]))
    assert one(spark, px.working_size(F.lit(5), lit(2)), px.working_size(F.lit(1), lit(9)), px.working_gsd(lit(0.3), lit(1.2)), px.snapped(lit(2.9995)), px.snapped(lit(2.9))) == (2, 1, 1.5, 3, 2.9)
    w = px.pixel_window(F.array(lit(-3), lit(7.99999)), F.array(lit(2.5), lit(4.5)), F.lit(100), F.lit(4))
    assert tuple(one(spark, w)[0]) == (2, 0, 2, 9)
    assert one(spark, px.pixel_window(F.array(lit(-9), lit(-3)), F.array(lit(0), lit(1)), F.lit(10), F.lit(10)))[0] is None
    xy = px.polar_to_xy(lit(-85), lit(40), fp.MOON_RADIUS_M, False)
    from mosaiq.functions.geodesy import inverse_polar_stereographic

    assert one(spark, *inverse_polar_stereographic(xy["x"], xy["y"], False)) == pytest.approx((-85, 40))
    e = px.eqc_to_xy(lit(10), lit(20), 1000.0, 30.0, 5.0)
    b = px.xy_to_eqc(e["x"], e["y"], 1000.0, 30.0, 5.0)
    assert one(spark, b["lat"], b["lon"]) == pytest.approx((10, 20))
    free = one(spark, px.analytic_tile(lit(8e9), 1000.0, 2))[0]
    assert one(spark, px.dense_peak_bytes(F.lit(free), 1000.0, 2))[0] <= 6e9 and (free == 1408 or one(spark, px.dense_peak_bytes(F.lit(free + 64), 1000.0, 2))[0] > 6e9)
    assert one(spark, *[px.keypoint_budget(lit(g * 2**30)) for g in (12, 6, 1)]) == (4096, 2048, 1024)


def test_evaluation_figures(spark):
    from mosaiq.operators import evaluation as ev

    rng = np.random.default_rng(6)
    xy = np.concatenate([rng.uniform(0, 100, (80, 2)), rng.uniform(50, 50.01, (40, 2)), [[7.0, 7.0], [7.0, 7.0]]])
    p = spark.createDataFrame([("a", i, float(x), float(y)) for i, (x, y) in enumerate(xy)] + [("b", 500, 1.0, 2.0)], "k string, id long, x double, y double")
    d = np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1)) + np.diag([np.inf] * len(xy))
    got = {r["id"]: r["d"] for r in ev.nearest(p, ["k"]).collect()}
    assert got.pop(500) is None and all(got[i] == pytest.approx(d[i].min(), abs=1e-12) for i in range(len(xy)))
    r = {x["k"]: (x["n"], x["r"]) for x in ev.clark_evans(p, ["k"], 100.0, 100.0).collect()}
    assert r["a"] == (122, pytest.approx(d.min(axis=1).mean() / (0.5 * math.sqrt(1e4 / 122)))) and math.isnan(r["b"][1])
    assert one(spark, ev.is_clustered(F.lit(0.2)), ev.is_clustered(F.lit(float("nan"))), ev.contradicted(F.lit(0.96), F.lit(0.1)), ev.is_subpixel(F.lit(0.9), F.lit(None).cast("double"))) == (True, False, True, False)
    eye = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    pairs = spark.createDataFrame([(eye, [1.0, 0.0, 3.0, 0.0, 1.0, 4.0, 0.0, 0.0, 1.0])], "estimated array<double>, truth array<double>")
    assert ev.transform_rms(pairs, 33, 20).first()["rms_px"] == pytest.approx(5)
    terms = ev.confidence_terms(spark.createDataFrame([(1, 12.0, 0.0, 2.0), (2, 1.0, 1.0, None)], "id long, source_gsd double, reference_gsd double, measured_m double"))
    found = {x["id"]: (x["total"], x["lower_bound"]) for x in ev.confidence(terms, ["id"]).collect()}
    assert found == {1: (pytest.approx(4), pytest.approx(4)), 2: (None, pytest.approx(math.sqrt(2 / 12)))}
    pts = spark.createDataFrame([("a", 0.0, 0.0, 3.0, 4.0, eye), ("a", 1.0, 1.0, 1.0, 1.0, eye)], "k string, sx double, sy double, dx double, dy double, transform array<double>")
    v = ev.validated(pts, ["k"], gsd_m=2.0).first()
    assert (v["n"], v["max_px"], v["rmse_m"]) == (2, 5, pytest.approx(2 * math.sqrt(12.5)))
    fits = spark.createDataFrame([("a", [1.0, 0.0, 0.0, 0.0, 1.0, 0.0]), ("a", [1.0, 0.0, 2.0, 0.0, 1.0, 0.0])], "pair string, affine array<double>")
    grid = ev.conditioning_map(fits, 10.0, 10.0, 3).collect()
    assert len(grid) == 9 and all(g["px"] == pytest.approx(1) for g in grid)
