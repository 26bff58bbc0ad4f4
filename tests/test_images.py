import numpy as np
import pytest

from mosaiq.operators import images as im
from mosaiq.operators import kernels as k


def rows(spark, images):
    return spark.createDataFrame([(i, int(x.shape[0]), int(x.shape[1]), [None if np.isnan(v) else float(v) for v in x.ravel()]) for i, x in images], im.IMAGE)


def test_blur_fill_dilate_and_areas_against_loops():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(12, 9))
    reach = 6
    w = np.exp(-0.5 * (np.arange(-reach, reach + 1) / 2.0) ** 2)
    w /= w.sum()
    p = np.pad(x, reach, mode="reflect")
    want = [[sum(w[a] * w[b] * p[i + a, j + b] for a in range(13) for b in range(13)) for j in range(9)] for i in range(12)]
    assert np.allclose(k.gaussian(x, 2.0), want)
    ok = rng.random((12, 9)) < 0.6
    y, m = np.where(ok, x, 0.0), ok.copy()
    for _ in range(2):
        z, q = y.copy(), m.copy()
        for i in range(12):
            for j in range(9):
                if not m[i, j]:
                    near = [y[a, b] for a in range(max(0, i - 1), min(12, i + 2)) for b in range(max(0, j - 1), min(9, j + 2)) if m[a, b]]
                    if near:
                        z[i, j], q[i, j] = np.mean(near), True
        y, m = z, q
    assert np.allclose(k.fill_invalid(x, ok, 2), y)
    for size, shape in ((3, "rect"), (5, "cross"), (5, "ellipse")):
        r = size // 2
        inside = {"rect": lambda a, b: True, "cross": lambda a, b: a == 0 or b == 0, "ellipse": lambda a, b: a * a + b * b <= (r + 0.5) ** 2}[shape]
        want = [[max(x[i + a, j + b] for a in range(-r, r + 1) for b in range(-r, r + 1) if inside(a, b) and 0 <= i + a < 12 and 0 <= j + b < 9) for j in range(9)] for i in range(12)]
        assert np.allclose(k.dilated(x, size, shape), want)
    assert np.allclose(k.area_resized(x, 4, 3), x.reshape(4, 3, 3, 3).mean(axis=(1, 3)))
    assert k.area_resized(x, 5, 4).sum() * (12 / 5) * (9 / 4) == pytest.approx(x.sum())


def test_stretch_levels_shadows_and_equalisation():
    x = np.arange(100.0).reshape(10, 10)
    assert k.stretch(x).min() == 0 and k.stretch(x).max() == 255 and (k.stretch(np.full((3, 3), 7.0)) == 0).all()
    ok = x > 9
    s = k.stretch(x, ok)
    assert (s[~ok] == 0).all() and s[ok].min() == 1 and s[ok].max() == 255
    assert (k.invert(s, ok)[ok] == np.clip(256 - s[ok].astype(int), 1, 255)).all() and (k.invert(s, ok)[~ok] == 0).all()
    assert k.log_transform(x - 5).max() == 255 and k.log_transform(x - 5)[0, 0] == 0
    dark = k.shadows(x)
    assert dark.sum() == 5 and (k.lift_shadows(x, "mask")[dark] == np.median(x[~dark])).all()
    g = k.lift_shadows(x, "gamma")
    assert np.allclose(g[dark], 0 + np.sqrt(np.arange(5) / 4.95) * 4.95) and (g[~dark] == x[~dark]).all()
    with pytest.raises(ValueError):
        k.lift_shadows(x, "other")
    r = k.lift_shadows(x, "retinex", sigma=2.0)
    assert r.min() == pytest.approx(0) and r.max() == pytest.approx(99)
    flat = np.full((64, 64), 100, np.uint8)
    flat[::2] = 104
    assert np.ptp(k.equalised(flat).astype(int)) >= 4 and k.equalised(flat, valid=flat > 101)[flat == 100].max() == 0
    c = k.local_contrast(np.random.default_rng(0).normal(size=(40, 40)) * 9 + 50)
    assert 118 < c.mean() < 138 and 30 < c.std() < 50


def test_warps_and_samples():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(20, 30))
    shift = np.array([[1, 0, 2], [0, 1, -3], [0, 0, 1.0]])
    w = k.warped(x, shift, 20, 30, "linear")
    assert np.allclose(w[:17, 2:], x[3:, :28]) and np.isnan(w[17:]).all() and np.isnan(w[:, :2]).all()
    plane = np.add.outer(2.0 * np.arange(20), 3.0 * np.arange(30))
    px, py = rng.uniform(1, 27, 50), rng.uniform(1, 17, 50)
    assert np.allclose(k.sampled(plane, px, py, "linear"), 3 * px + 2 * py) and np.allclose(k.sampled(plane, np.rint(px), np.rint(py), "cubic"), 3 * np.rint(px) + 2 * np.rint(py))
    assert np.allclose(k.sampled(np.full((9, 9), 4.0), px % 8, py % 8, "cubic"), 4)
    assert np.allclose(k.sampled(plane, px, py, "nearest"), 3 * np.rint(px) + 2 * np.rint(py)) and np.isnan(k.sampled(plane, np.array([29.2]), np.array([0.0])))


def test_shading_and_shadows():
    z = np.zeros((40, 40))
    z[:, 20] = 10.0  # a wall
    dark = k.cast_shadow(z, 1.0, 90.0, 45.0)  # the Sun in the east
    assert dark[5, 12:20].all() and not dark[5, :9].any() and not dark[5, 21:].any()
    ramp = np.tile(np.arange(40.0), (40, 1))  # rises to the east, so it faces west
    assert k.hillshade(ramp, 1.0, 270.0, 45.0)[5, 5] == pytest.approx(1) and k.hillshade(ramp, 1.0, 90.0, 45.0)[5, 5] == pytest.approx(0, abs=1e-9)
    t = k.terrain(64, seed=1)
    assert t.std() == pytest.approx(1) and (t == k.terrain(64, seed=1)).all() and not np.allclose(t, k.add_craters(t, 5))


@pytest.mark.parametrize("model,matrix", [("homography", [1.02, 0.05, 3, -0.04, 0.97, 5, 1e-4, -5e-5, 1]), ("affine", [1.1, 0.2, 3, -0.1, 0.9, 5, 0, 0, 1]), ("partial_affine", [0.9, -0.3, 3, 0.3, 0.9, 5, 0, 0, 1])])
def test_fits_and_consensus(model, matrix):
    rng = np.random.default_rng(5)
    m = np.array(matrix, float).reshape(3, 3)
    src = rng.uniform(0, 200, (120, 2))
    dst = k.applied(m, src)
    assert np.allclose(k.fit(src, dst, model), m, atol=1e-6)
    assert k.fit(src[:1], dst[:1], model) is None and k.fit(np.repeat(src[:1], 9, 0), np.repeat(dst[:1], 9, 0), model) is None
    noisy = dst + rng.normal(size=dst.shape) * 0.1
    noisy[:50] += rng.uniform(20, 90, (50, 2))
    found, inliers = k.robust(src, noisy, model)
    assert inliers[50:].all() and not inliers[:50].any() and np.abs(k.applied(found, src) - dst).max() < 0.5
    again, _ = k.robust(src, noisy, model)
    assert (found == again).all() and k.robust(src[:1], dst[:1], model)[0] is None


def test_chain_reports_each_step(spark):
    rng = np.random.default_rng(2)
    image = rng.uniform(0, 1000, (32, 40))
    image[0, :5] = np.nan
    y, ok, m, states = im.run_chain(image, {"normalize": {}, "resample": {"gsd": 1.0, "target": 2.0}, "histogram_match": {}, "clahe": {"grid": 0}, "invert": {}})
    assert [s[:2] for s in states] == [("resample", "RAN"), ("normalize", "RAN"), ("histogram_match", "SKIPPED"), ("clahe", "FAILED"), ("invert", "RAN")] or states[3][1] == "FAILED"
    assert y.shape == (16, 20) and np.allclose(m, [[0.5, 0, -0.25], [0, 0.5, -0.25], [0, 0, 1]]) and not ok[0, :2].any()
    assert im.run_chain(np.ones((4, 4)), {"normalize": {}, "invert": {}})[3] == [("normalize", "DEGENERATE", "fewer than two values are left")]
    assert im.run_chain(rng.normal(size=(8, 8, 3)), {"band_reduction": {"method": "select"}})[0].shape == (8, 8)
    matched = im.run_chain(np.arange(64.0).reshape(8, 8), {"histogram_match": {}}, reference=np.arange(64.0).reshape(8, 8) * 2)[0]
    assert np.allclose(matched, np.arange(64.0).reshape(8, 8) * 2)
    with pytest.raises(ValueError):
        im.run_chain(image, {"other": {}})
    df = rows(spark, [(1, image), (2, np.ones((4, 4)))]).union(spark.createDataFrame([(3, 2, 2, [1.0])], im.IMAGE))
    found = im.preprocess(df, "standard")
    got = {(r["step"], r["status"]): (r["n"], r["first_id"]) for r in im.step_counts(found).collect()}
    assert got == {("normalize", "RAN"): (1, 1), ("shadow", "RAN"): (1, 1), ("clahe", "RAN"): (1, 1), ("normalize", "DEGENERATE"): (1, 2), ("read", "FAILED"): (1, 3)}
    assert im.preprocess(df.limit(0), "none").count() == 0


def test_pairs_are_registered_in_a_batch(spark):
    m = np.array([[1, 0, 6.0], [0, 1, -4.0], [0, 0, 1]])
    a, b = k.illumination_pair(192, (135, 45), (150, 50), m, seed=3)
    images = rows(spark, [(1, a.astype(float)), (2, b.astype(float)), (3, np.ones((16, 16)))])
    pairs = spark.createDataFrame([("p1", 1, 2), ("p2", 1, 3), ("p3", 1, 9)], "pair string, source_id long, reference_id long")
    got = {r["pair"]: r for r in im.register_pairs(pairs, images, model="partial_affine").collect()}
    assert got["p2"]["status"] == "DEGENERATE_INPUT" and got["p3"]["status"] == "LOAD_FAILED"
    assert got["p1"]["status"] == "OK" and got["p1"]["n_inliers"] >= 10 and np.abs(np.array(got["p1"]["matrix"]).reshape(3, 3) - m).max() < 3
    report = [(r["status"], r["n"]) for r in im.batch_report(im.register_pairs(pairs, images, model="partial_affine")).collect()]
    assert sorted(report) == [("DEGENERATE_INPUT", 1), ("LOAD_FAILED", 1), ("OK", 1)]
    moved = im.warp(images.filter("id = 1"), spark.createDataFrame([(1, [float(v) for v in m.ravel()], 192, 192)], "id long, matrix array<double>, out_height int, out_width int"), "linear").first()
    assert np.allclose(np.array(moved["pixels"], float).reshape(192, 192)[:188, 6:], a[4:, :186])
