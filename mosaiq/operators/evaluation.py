"""Figures about results: nearest neighbours, error budgets, confidence, comparison with truth, choice of a result."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.functions import pixels as px
from mosaiq.storage import stored


def nearest(points: DataFrame, keys: list[str], cell: str = "_cell") -> DataFrame:
    """(keys, id, d): distance of each point (id, x, y) to the nearest other of its group; null if it is alone.

    Points meet in square cells sized for about two of a group each, and their eight neighbours. A distance is
    final if it is no larger than what the searched square reaches to all sides; the others are searched again with cells of
    twice the size, until all are final or a cell holds the group. So every point meets a few others a round.
    """
    box = points.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("x").alias("_x0"), F.min("y").alias("_y0"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("_span"))
    sized = points.join(box, keys).withColumn("_size", F.greatest(F.col("_span") * F.sqrt(F.lit(2.0) / F.col("_n")), F.lit(1e-12)))
    same = sized.groupBy(*keys, "x", "y").agg(F.count("*").alias("_m"), F.min("id").alias("id"))
    alone = same.join(box.select(*keys, "_n", "_x0", "_y0", "_span"), keys).withColumn("_size", F.greatest(F.col("_span") * F.sqrt(F.lit(2.0) / F.col("_n")), F.lit(1e-12)))
    rounds = []
    left = alone.filter("_m = 1")
    for _ in range(64):
        at = lambda df: df.withColumn("_i", F.floor((F.col("x") - F.col("_x0")) / F.col("_size"))).withColumn("_j", F.floor((F.col("y") - F.col("_y0")) / F.col("_size")))
        scale = left.select(*keys, "_size").distinct()
        other = at(alone.drop("_size").join(scale, keys)).select(*keys, F.col("x").alias("_ox"), F.col("y").alias("_oy"), "_i", "_j")
        steps = F.array(F.lit(-1), F.lit(0), F.lit(1))
        asked = at(left).withColumn("_di", F.explode(steps)).withColumn("_dj", F.explode(steps)).withColumn("_i", F.col("_i") + F.col("_di")).withColumn("_j", F.col("_j") + F.col("_dj"))
        d2 = F.pow(F.col("x") - F.col("_ox"), 2) + F.pow(F.col("y") - F.col("_oy"), 2)
        met = asked.join(other, [*keys, "_i", "_j"], "left").withColumn("_d", F.when(d2 > 0, F.sqrt(d2)))
        met = met.groupBy(*keys, "id", "x", "y", "_m", "_n", "_x0", "_y0", "_span", "_size").agg(F.min("_d").alias("d"))
        done = (F.col("d") <= F.col("_size")) | (F.col("_size") > F.col("_span")) | (F.col("_n") == 1)
        met = stored(met.withColumn("_done", F.coalesce(done, F.lit(False))))
        rounds.append(met.filter("_done").select(*keys, "x", "y", "d"))
        left = met.filter("not _done").drop("_done", "d").withColumn("_size", F.col("_size") * 2)
        if left.isEmpty():
            break
    out = same.filter("_m > 1").select(*keys, "x", "y", F.lit(0.0).alias("d"))
    for r in rounds:
        out = out.union(r)
    return points.join(out, [*keys, "x", "y"], "left").select(*keys, "id", "d")


def clark_evans(points: DataFrame, keys: list[str], width: float, height: float) -> DataFrame:
    """(keys, n, r): mean distance to the nearest neighbour by that of points strewn at random; NaN for a single point."""
    found = nearest(points, keys).groupBy(*keys).agg(F.count("*").alias("n"), F.avg("d").alias("_d"))
    return found.select(*keys, "n", F.when(F.col("n") < 2, F.lit(float("nan"))).otherwise(F.col("_d") / (0.5 * F.sqrt(width * height / F.col("n")))).alias("r"))


def is_clustered(r: Column) -> Column:
    return ~F.isnan(r) & (r < 0.25)


def contradicted(score: Column, r: Column) -> Column:
    """An even grid whose points lie in clusters."""
    return (score > 0.95) & is_clustered(r)


def is_subpixel(rmse: Column, p95: Column) -> Column:
    return F.coalesce((rmse < 1) & (p95 < 1), F.lit(False))


def metrics(points: DataFrame, keys: list[str], residual: str, inlier: str | None = None, gsd_m: float | None = None) -> DataFrame:
    """(keys, n_matches, n, inlier_ratio, rmse_px, mae_px, median_px, p95_px, max_px, rmse_m) over inliers, or over all without a mask."""
    used = F.col(residual) if inlier is None else F.when(F.col(inlier), F.col(residual))
    n, total = F.count(used), F.count("*")
    p = F.percentile(used, F.array(F.lit(0.5), F.lit(0.95)))
    out = points.groupBy(*keys).agg(total.alias("n_matches"), n.alias("n"), F.when(total > 0, n / total).otherwise(0.0).alias("inlier_ratio"), F.sqrt(F.avg(used * used)).alias("rmse_px"), F.avg(F.abs(used)).alias("mae_px"), p[0].alias("median_px"), p[1].alias("p95_px"), F.max(used).alias("max_px"))
    return out.withColumn("rmse_m", F.col("rmse_px") * F.lit(gsd_m).cast("double"))


def correspondence(distribution: Column, fit: Column) -> Column:
    """What localisation adds to a fit's error, independent of how points are distributed."""
    return F.sqrt(F.greatest(fit * fit - distribution * distribution, F.when(fit.isNotNull() & distribution.isNotNull(), 0.0)))


def dominant(distribution: Column, fit: Column) -> Column:
    """The larger of two causes; null where one is within a quarter of the other, or nothing is known."""
    c = correspondence(distribution, fit)
    larger, smaller = F.greatest(distribution, c), F.least(distribution, c)
    unknown = fit.isNull() | distribution.isNull() | (fit <= 0) | (larger == 0) | ((smaller > 0) & (larger / smaller <= 1.25))
    return F.when(~unknown, F.when(distribution > c, "point distribution").otherwise("correspondence error"))


def sweep(rows: DataFrame, stages: list[str]) -> DataFrame:
    """(chain, one column a stage) of rows (chain, stage, rmse_px)."""
    return rows.groupBy("chain").pivot("stage", stages).agg(F.first("rmse_px"))


def transform_rms(pairs: DataFrame, width: int, height: int, step: int = 16) -> DataFrame:
    """``pairs`` (estimated, truth as nine doubles) with rms_px: how far apart both send the points of a grid."""
    cols, rows = F.sequence(F.lit(0), F.lit(width - 1), F.lit(step)), F.sequence(F.lit(0), F.lit(height - 1), F.lit(step))

    def square(x, y):
        a, b = px.applied(F.col("estimated"), x, y), px.applied(F.col("truth"), x, y)
        return F.pow(a["x"] - b["x"], 2) + F.pow(a["y"] - b["y"], 2)

    each = F.flatten(F.transform(rows, lambda y: F.transform(cols, lambda x: square(x, y))))
    return pairs.withColumn("_e", each).withColumn("rms_px", F.sqrt(F.aggregate("_e", F.lit(0.0), lambda s, v: s + v) / F.size("_e"))).drop("_e")


def confidence(terms: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, total, lower_bound) of terms (source, sigma): root of the sum of squares; no total while a source is unknown."""
    known = F.sqrt(F.coalesce(F.sum(F.col("sigma") * F.col("sigma")), F.lit(0.0)))
    return terms.groupBy(*keys).agg(F.when(F.count_if(F.lower("source") == "unknown") == 0, known).alias("total"), known.alias("lower_bound"))


def confidence_terms(pairs: DataFrame) -> DataFrame:
    """(id, term, source, sigma) of pairs (id, source_gsd, reference_gsd, measured_m): quantisation of both sides, then what was measured.

    Without a measured residual its two causes are unknown terms.
    """
    q = lambda c: F.col(c) / F.sqrt(F.lit(12.0))
    term = lambda name, source, sigma: F.struct(F.lit(name).alias("term"), F.lit(source).alias("source"), sigma.alias("sigma"))
    none = F.lit(None).cast("double")
    sides = [term("source quantisation", "derived", q("source_gsd")), term("reference quantisation", "derived", q("reference_gsd")), term("corner ordering", "verified", F.lit(0.0))]
    rest = F.when(F.col("measured_m").isNotNull(), F.array(term("residual", "measured", F.col("measured_m")))).otherwise(F.array(term("corner accuracy", "unknown", none), term("terrain", "unknown", none)))
    return pairs.select("id", F.explode(F.concat(F.array(*sides), rest)).alias("t")).select("id", "t.*")


def validated(points: DataFrame, keys: list[str], transform: str = "transform", gsd_m: float | None = None) -> DataFrame:
    """(keys, n, rmse_px, median_px, p95_px, max_px, rmse_m) of where ``transform`` sends (sx, sy) against (dx, dy)."""
    sent = px.applied(F.col(transform), F.col("sx"), F.col("sy"))
    with_error = points.withColumn("_e", F.hypot(sent["x"] - F.col("dx"), sent["y"] - F.col("dy")))
    return metrics(with_error, keys, "_e", None, gsd_m).drop("n_matches", "inlier_ratio", "mae_px")


def loop_closure(points: DataFrame, keys: list[str], gsd_m: float) -> DataFrame:
    """(keys, closure_m): the largest way that a point is off after a round through transforms, (x, y) against (bx, by)."""
    return points.groupBy(*keys).agg((F.max(F.hypot(F.col("x") - F.col("bx"), F.col("y") - F.col("by"))) * gsd_m).alias("closure_m"))


def conditioning_map(fits: DataFrame, width: float, height: float, probes: int = 24) -> DataFrame:
    """(pair, row, col, px): at each probe the largest distance of a resample's prediction from the mean of all.

    ``fits`` holds six affine coefficients a resample, a bounded number a pair.
    """

    def spread(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = (g.ravel() for g in np.meshgrid(np.linspace(0, width - 1, probes), np.linspace(0, height - 1, probes)))
        a = np.stack(pdf["affine"])
        sent = np.stack([a[:, [0]] * x + a[:, [1]] * y + a[:, [2]], a[:, [3]] * x + a[:, [4]] * y + a[:, [5]]])
        worst = np.hypot(*(sent - sent.mean(axis=1, keepdims=True))).max(axis=0)
        at = np.arange(probes * probes)
        return pd.DataFrame({"pair": [pdf["pair"].iloc[0]] * len(at), "row": at // probes, "col": at % probes, "px": worst})

    kind = fits.schema["pair"].dataType.simpleString()
    return fits.filter("affine is not null").groupBy("pair").applyInPandas(spread, f"pair {kind}, row int, col int, px double")


def points_outside(x: Column, y: Column, width: float, height: float) -> Column:
    """Aggregate: points that don't lie in the frame."""
    return F.count_if(~((x >= 0) & (x < width) & (y >= 0) & (y < height)))
