"""Images as rows (id, height, width, pixels): chains of steps with a status each, presets, warps, pairs registered in batches.

An image row is a tile of bounded size (``raster.plan_tiles``); a task holds one row at a time. A step that can't run says so in
its status; it never fails the job.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.operators import kernels as k

IMAGE = "id long, height int, width int, pixels array<double>"
STEPS = "array<struct<step:string,status:string,detail:string>>"
#: Steps in the order in which a chain runs them.
ORDER = ("band_reduction", "resample", "normalize", "shadow", "histogram_match", "clahe", "invert", "dilate", "log_transform", "local_contrast")
#: Fixed presets: the steps that each turns on.
PRESETS = {"none": {}, "standard": {"normalize": {}, "shadow": {"method": "mask"}, "clahe": {}}, "clahe": {"normalize": {}, "clahe": {}}, "shadow_gamma": {"normalize": {}, "shadow": {"method": "gamma"}}, "retinex": {"normalize": {}, "shadow": {"method": "retinex"}}, "lcn": {"normalize": {}, "local_contrast": {}}}


def _matched(image: np.ndarray, reference: np.ndarray, valid: np.ndarray, reference_valid: np.ndarray) -> np.ndarray:
    """Levels by equal shares, over valid pixels."""
    s, r = (np.cumsum(np.bincount(x[v].astype(np.uint8), minlength=256)) / max(1, v.sum()) for x, v in ((image, valid), (reference, reference_valid)))
    table = np.minimum(np.searchsorted(r, s, side="left"), 255)
    return np.where(valid, table[image.astype(np.uint8)], 0)


def run_chain(image: np.ndarray, config: dict, valid: np.ndarray | None = None, reference: np.ndarray | None = None):
    """(image, mask, matrix of pixels in to pixels out, [(step, status, detail)]) of the steps that ``config`` turns on.

    Status: RAN, NOOP (nothing to do), SKIPPED (something is missing), FAILED (an error, the image stays), DEGENERATE (the image
    lost all contrast; the chain ends).
    """
    x = np.asarray(image, float)
    ok = (np.isfinite(x).all(axis=-1) if x.ndim == 3 else np.isfinite(x)) if valid is None else valid.astype(bool)
    matrix, states = np.eye(3), []

    def note(step, status, detail=""):
        states.append((step, status, detail))

    unknown = sorted(set(config) - set(ORDER))
    if unknown:
        raise ValueError(f"unknown steps {unknown}")
    for step in ORDER:
        if step not in config:
            continue
        how = config[step]
        try:
            if step == "band_reduction":
                if x.ndim == 2:
                    note(step, "NOOP", "one band")
                    continue
                if how.get("method", "mean") == "select":
                    x = x[..., int(np.argmax([x[..., i][ok].std() for i in range(x.shape[-1])]))]
                else:
                    x = x[..., slice(*how.get("bands", (0, 60)))].mean(axis=-1)
            elif step == "resample":
                if not how.get("gsd") or not how.get("target"):
                    note(step, "SKIPPED", "no ground sample distance")
                    continue
                h, w = (max(1, round(n * how["gsd"] / how["target"])) for n in x.shape)
                if (h, w) == x.shape:
                    note(step, "NOOP", "same size")
                    continue
                sy, sx = h / x.shape[0], w / x.shape[1]
                share = k.area_resized(ok, h, w) if sx < 1 else None
                if sx < 1:
                    x = np.where(share > 1e-9, k.area_resized(np.where(ok, x, 0), h, w) / np.maximum(share, 1e-9), 0)
                    ok = share >= 1 - 1e-6
                else:
                    y, u = np.mgrid[:h, :w]
                    px, py = np.clip((u + 0.5) / sx - 0.5, 0, x.shape[1] - 1), np.clip((y + 0.5) / sy - 0.5, 0, x.shape[0] - 1)
                    ok = k.sampled(ok.astype(float), px.ravel(), py.ravel(), "nearest").reshape(h, w) > 0.5
                    x = k.sampled(np.where(np.isfinite(x), x, 0), px.ravel(), py.ravel(), "cubic").reshape(h, w)
                matrix = np.array([[sx, 0, 0.5 * sx - 0.5], [0, sy, 0.5 * sy - 0.5], [0, 0, 1]]) @ matrix
            elif step == "normalize":
                x = k.stretch(x, ok).astype(float)
            elif step == "shadow":
                if how.get("method", "gamma") == "none":
                    note(step, "NOOP", "method none")
                    continue
                x = k.lift_shadows(x, valid=ok, **{"method": "gamma", **how})
            elif step == "histogram_match":
                if reference is None:
                    note(step, "SKIPPED", "no reference")
                    continue
                x = _matched(np.clip(x, 0, 255), np.clip(np.nan_to_num(reference), 0, 255), ok, np.isfinite(reference))
            elif step == "clahe":
                x = k.equalised(np.clip(np.nan_to_num(x), 0, 255).astype(np.uint8), how.get("clip", 2.0), how.get("grid", 8), ok).astype(float)
            elif step == "invert":
                x = k.invert(np.clip(np.nan_to_num(x), 0, 255).astype(np.uint8), ok).astype(float)
            elif step == "dilate":
                x = np.where(ok, k.dilated(np.where(ok, x, 0), how.get("size", 3), how.get("shape", "ellipse")), 0)
            elif step == "log_transform":
                x = k.log_transform(np.where(ok, x, 0), how.get("scale")).astype(float)
            else:
                x = np.where(ok, k.local_contrast(k.fill_invalid(x, ok), how.get("sigma", 8.0)), 0).astype(float)
        except (ValueError, ArithmeticError, IndexError, KeyError, TypeError, np.linalg.LinAlgError) as error:
            note(step, "FAILED", f"{type(error).__name__}: {error}"[:200])
            continue
        if not ok.any() or np.ptp(x[ok]) == 0:
            note(step, "DEGENERATE", "fewer than two values are left")
            break
        note(step, "RAN")
    return np.where(ok, x, 0) if x.ndim == 2 else x, ok, matrix, states


def _array(row_pixels, h, w) -> np.ndarray:
    x = np.array([np.nan if v is None else v for v in row_pixels], float) if row_pixels is not None else np.empty(0)
    if h is None or w is None or h < 1 or w < 1 or len(x) != h * w:
        raise ValueError(f"{len(x)} pixels for {h} x {w}")
    return x.reshape(int(h), int(w))


def preprocess(images: DataFrame, config: dict | str, nodata: float | None = None) -> DataFrame:
    """(id, height, width, pixels, matrix, steps) of every image row after the steps of a config or the preset of that name.

    A row whose pixels don't fit its size comes back empty with the one step ``read`` FAILED. ``nodata`` and non-finite pixels are
    invalid and come out as 0.
    """
    config = PRESETS[config] if isinstance(config, str) else config

    def run(batches):
        for pdf in batches:
            out = []
            for key, h, w, pixels in zip(pdf["id"], pdf["height"], pdf["width"], pdf["pixels"]):
                try:
                    x = _array(pixels, h, w)
                except ValueError as error:
                    out.append((key, 0, 0, [], [], [{"step": "read", "status": "FAILED", "detail": str(error)}]))
                    continue
                ok = np.isfinite(x) if nodata is None else np.isfinite(x) & (x != nodata)
                y, _, m, states = run_chain(x, config, ok)
                out.append((key, *y.shape, y.ravel(), m.ravel(), [dict(zip(("step", "status", "detail"), s)) for s in states]))
            yield pd.DataFrame(out, columns=["id", "height", "width", "pixels", "matrix", "steps"])

    return images.select("id", "height", "width", "pixels").mapInPandas(run, f"{IMAGE}, matrix array<double>, steps {STEPS}")


def step_counts(found: DataFrame) -> DataFrame:
    """(step, status, n, first_id) over all images."""
    each = found.select("id", F.explode("steps").alias("s"))
    return each.groupBy(F.col("s.step").alias("step"), F.col("s.status").alias("status")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def warp(images: DataFrame, transforms: DataFrame, kind: str = "cubic") -> DataFrame:
    """(id, height, width, pixels): images as their transforms (id, matrix, out_height, out_width) send them, null without pixels."""

    def run(batches):
        for pdf in batches:
            out = []
            for key, h, w, pixels, m, oh, ow in zip(*[pdf[c] for c in ("id", "height", "width", "pixels", "matrix", "out_height", "out_width")]):
                y = k.warped(_array(pixels, h, w), np.array(m), int(oh), int(ow), kind)
                out.append((key, int(oh), int(ow), [None if np.isnan(v) else v for v in y.ravel()]))
            yield pd.DataFrame(out, columns=["id", "height", "width", "pixels"])

    both = images.join(transforms, "id").select("id", "height", "width", "pixels", "matrix", "out_height", "out_width")
    return both.mapInPandas(run, IMAGE)


def detect(image: np.ndarray, most: int = 800) -> tuple[np.ndarray, np.ndarray]:
    """(descriptors, points) of an image by phase congruency: corners of the smallest moment, index-map histograms."""
    _, small, amplitudes = k.phase_congruency(image)
    return k.described(amplitudes, k.corners(small, most))


def nearest_matches(a: np.ndarray, b: np.ndarray, ratio: float = 0.9) -> list[tuple[int, int, float]]:
    """(i, j, score) of descriptors whose nearest is clearly nearer than the second."""
    if len(a) == 0 or len(b) < 2:
        return []
    d = np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * a @ b.T, 0))
    two = np.argpartition(d, 1, axis=1)[:, :2]
    two = np.take_along_axis(two, np.argsort(np.take_along_axis(d, two, 1), axis=1, kind="stable"), 1)
    first, second = (np.take_along_axis(d, two[:, [c]], 1)[:, 0] for c in (0, 1))
    good = np.flatnonzero(first < ratio * second)
    return [(int(i), int(two[i, 0]), float(1 - first[i] / max(second[i], 1e-9))) for i in good]


RESULT = "pair string, status string, detail string, n_matches int, n_inliers int, rmse_px double, p95_px double, matrix array<double>, steps " + STEPS


def register(source: np.ndarray, reference: np.ndarray, preset: str = "none", model: str = "homography", threshold: float = 3.0, refit: float = 1.0, ratio: float = 0.9):
    """A result row but for its pair: both images preprocessed, detected, matched, fitted. Never raises on odd images."""
    images, matrices, steps = [], [], []
    for name, image in (("source", source), ("reference", reference)):
        ok = np.isfinite(image) & (image > 0)
        if not ok.any() or np.ptp(image[ok]) == 0:
            return ("DEGENERATE_INPUT", f"{name} has no contrast", 0, 0, None, None, None, steps)
        y, _, m, states = run_chain(image, PRESETS[preset], ok)
        images.append(y)
        matrices.append(m)
        steps += [{"step": f"{name}:{s}", "status": t, "detail": d} for s, t, d in states]
    (da, pa), (db, pb) = (detect(x) for x in images)
    found = nearest_matches(da, db, ratio)
    if len(found) < 4:
        return ("TOO_FEW_MATCHES", f"{len(found)} matches", len(found), 0, None, None, None, steps)
    src, dst = pa[[i for i, _, _ in found]].astype(float), pb[[j for _, j, _ in found]].astype(float)
    m, inliers = k.robust(src, dst, model, threshold, refit)
    if m is None or inliers.sum() < 4:
        return ("NO_TRANSFORM", "no consensus", len(found), int(inliers.sum()), None, None, None, steps)
    e = np.hypot(*(k.applied(m, src[inliers]) - dst[inliers]).T)
    native = np.linalg.inv(matrices[1]) @ m @ matrices[0]
    return ("OK", "", len(found), int(inliers.sum()), float(np.sqrt((e * e).mean())), float(np.percentile(e, 95)), (native / native[2, 2]).ravel(), steps)


def register_pairs(pairs: DataFrame, images: DataFrame, **how) -> DataFrame:
    """A result row for every pair (pair, source_id, reference_id): a batch, one pair of images a row, spread over tasks.

    An id without an image gives LOAD_FAILED, an error inside a pair FAILED: a bad pair never stops the others.
    """
    side = lambda name: images.select(F.col("id").alias(f"{name}_id"), F.struct("height", "width", "pixels").alias(name))
    both = pairs.join(side("source"), "source_id", "left").join(side("reference"), "reference_id", "left").select("pair", "source", "reference")

    def run(batches):
        for pdf in batches:
            out = []
            for pair, a, b in zip(pdf["pair"], pdf["source"], pdf["reference"]):
                try:
                    x, y = (None if z is None else _array(z["pixels"], z["height"], z["width"]) for z in (a, b))
                    row = ("LOAD_FAILED", "no image", 0, 0, None, None, None, []) if x is None or y is None else register(x, y, **how)
                except Exception as error:  # noqa: BLE001  reported in the pair's own row
                    row = ("FAILED", f"{type(error).__name__}: {error}"[:200], 0, 0, None, None, None, [])
                out.append((pair, *row))
            yield pd.DataFrame(out, columns=["pair", "status", "detail", "n_matches", "n_inliers", "rmse_px", "p95_px", "matrix", "steps"])

    return both.repartition("pair").mapInPandas(run, RESULT)


def batch_report(results: DataFrame) -> DataFrame:
    """(status, n, first_sample) of a batch, commonest first."""
    sample = F.concat_ws(": ", "pair", F.when(F.col("detail") != "", F.col("detail")))
    return results.groupBy("status").agg(F.count("*").alias("n"), F.min_by(sample, F.col("pair")).alias("first_sample")).orderBy(F.desc("n"), "status")
