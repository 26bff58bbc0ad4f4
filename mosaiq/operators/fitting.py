"""Fits of affine transforms, robust and resampled, principal components, azimuths and bilinear lookups.

All work on correspondences (pair, id, sx, sy, dx, dy) or pixel rows as aggregates; only sums of fixed size leave the executors' partial aggregates.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_TERMS = ("n", "x", "y", "xx", "xy", "yy", "u", "xu", "yu", "v", "xv", "yv")


def _sums(weight: Column) -> list[Column]:
    x, y, u, v = (F.col(c) for c in ("sx", "sy", "dx", "dy"))
    each = dict(zip(_TERMS, (F.lit(1.0), x, y, x * x, x * y, y * y, u, x * u, y * u, v, x * v, y * v)))
    return [F.sum(weight * c).alias(f"m_{k}") for k, c in each.items()]


def _solution() -> Column:
    """Least squares [a, b, c, d, e, f] of u = ax + by + c, v = dx + ey + f from centred sums; null where rank < 3."""
    m = {k: F.col(f"m_{k}") for k in _TERMS}
    sxx, sxy, syy = m["xx"] - m["x"] * m["x"] / m["n"], m["xy"] - m["x"] * m["y"] / m["n"], m["yy"] - m["y"] * m["y"] / m["n"]
    det = sxx * syy - sxy * sxy
    out = []
    for t in ("u", "v"):
        p, q = m["x" + t] - m["x"] * m[t] / m["n"], m["y" + t] - m["y"] * m[t] / m["n"]
        a, b = (syy * p - sxy * q) / det, (sxx * q - sxy * p) / det
        out += [a, b, (m[t] - a * m["x"] - b * m["y"]) / m["n"]]
    return F.when((m["n"] >= 3) & (det > 1e-12 * sxx * syy) & (sxx > 0) & (syy > 0), F.array(*out))


def affine(points: DataFrame, keys: list[str], weight: Column | None = None) -> DataFrame:
    """(keys, n, affine): least squares by group in one partial aggregate; points of null coordinates take no part."""
    sums = points.dropna(subset=["sx", "sy", "dx", "dy"]).groupBy(*keys).agg(F.count("*").alias("n"), *_sums(F.lit(1.0) if weight is None else weight))
    return sums.select(*keys, "n", _solution().alias("affine"))


def _error(a) -> Column:
    """Distance between what the six coefficients ``a`` (an array column or a list of columns) predict and (dx, dy)."""
    return F.hypot(a[0] * F.col("sx") + a[1] * F.col("sy") + a[2] - F.col("dx"), a[3] * F.col("sx") + a[4] * F.col("sy") + a[5] - F.col("dy"))


def robust_affine(points: DataFrame, threshold: float = 2.0, refit: float = 1.0, deals: int = 8, triples: int = 25) -> DataFrame:
    """(pair, n, n_inliers, affine): the affine transform that most correspondences of a pair follow.

    Seeded consensus: in each of ``deals`` orders by hash the first 3 * ``triples`` points of a pair make
    triples, each one a hypothesis; all points vote (error at most ``threshold``), and the winner (ties to the
    smaller number) is fitted anew to its voters and once more to those within ``refit`` of that fit. Only the
    hypotheses, at most deals * triples a pair, are gathered. A pair without three points in general position has null.
    """
    good = points.dropna(subset=["sx", "sy", "dx", "dy"]).select("pair", "id", "sx", "sy", "dx", "dy")
    dealt = good.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))
    rank = F.row_number().over(Window.partitionBy("pair", "deal").orderBy(F.xxhash64("id", "deal"), "id"))
    drawn = dealt.withColumn("rn", rank).filter(F.col("rn") <= 3 * triples).withColumn("guess", F.col("deal") * triples + F.floor((F.col("rn") - 1) / 3))
    guesses = affine(drawn, ["pair", "guess"]).filter("affine is not null").groupBy("pair").agg(F.sort_array(F.collect_list(F.struct("guess", "affine"))).alias("guesses"))
    each = good.join(guesses, "pair").select("pair", "sx", "sy", "dx", "dy", F.explode("guesses").alias("g"))
    a = [F.col("g.affine")[i].alias(f"a{i}") for i in range(6)]
    # six doubles, not an array, so that votes are counted in a hash aggregate
    votes = each.select("pair", "sx", "sy", "dx", "dy", F.col("g.guess").alias("guess"), *a).filter(_error([F.col(f"a{i}") for i in range(6)]) <= threshold)
    counted = votes.groupBy("pair", "guess").agg(F.count("*").alias("votes"), *[F.first(f"a{i}").alias(f"a{i}") for i in range(6)])
    best = counted.groupBy("pair").agg(F.max_by(F.array(*[f"a{i}" for i in range(6)]), F.struct("votes", -F.col("guess"))).alias("first"))
    again = affine(good.join(best, "pair").filter(_error(F.col("first")) <= threshold), ["pair"]).select("pair", F.col("affine").alias("second"))
    last = affine(good.join(again, "pair").filter(_error(F.col("second")) <= refit), ["pair"]).select("pair", F.col("n").alias("n_inliers"), "affine")
    sizes = good.groupBy("pair").agg(F.count("*").alias("n"))
    return sizes.join(last, "pair", "left").select("pair", "n", F.coalesce("n_inliers", F.lit(0)).cast("long").alias("n_inliers"), "affine")


def bootstrap(points: DataFrame, width: float, height: float, resamples: int = 40, probes: int = 24, seed: int = 0) -> DataFrame:
    """(pair, n_points, n_fits, median_px, p95_px, max_px): how far a pair's affine fit wanders when its points are drawn anew.

    A point's number of copies in a resample is Poisson of mean one, drawn from a hash of its id: the limit of
    drawing with replacement, and one partial aggregate over all points. The fits, ``resamples`` a pair, predict
    a ``probes`` x ``probes`` grid; a resample's figure is its largest distance from the mean prediction. Fewer
    than five fits give infinity.
    """
    share = (F.pmod(F.xxhash64("id", "resample", F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    steps = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, k + 1)) for k in range(12)]).tolist()
    copies = sum(F.when(share > s, 1.0).otherwise(0.0) for s in steps)
    drawn = points.withColumn("resample", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1)))).withColumn("_w", copies).filter("_w > 0")
    fits = affine(drawn, ["pair", "resample"], F.col("_w")).filter("affine is not null")

    def spread(pdf: pd.DataFrame) -> pd.DataFrame:  # at most ``resamples`` rows
        n = len(pdf)
        figures = [float("inf")] * 3
        if n >= 5:
            x, y = (g.ravel() for g in np.meshgrid(np.linspace(0, width - 1, probes), np.linspace(0, height - 1, probes)))
            a = np.stack(pdf["affine"])
            sent = np.stack([a[:, [0]] * x + a[:, [1]] * y + a[:, [2]], a[:, [3]] * x + a[:, [4]] * y + a[:, [5]]])
            worst = np.hypot(*(sent - sent.mean(axis=1, keepdims=True))).max(axis=1)
            figures = [float(np.median(worst)), float(np.percentile(worst, 95)), float(worst.max())]
        return pd.DataFrame([[pdf["pair"].iloc[0], n, *figures]], columns=["pair", "n_fits", "median_px", "p95_px", "max_px"])

    kind = points.schema["pair"].dataType.simpleString()
    found = fits.groupBy("pair").applyInPandas(spread, f"pair {kind}, n_fits long, median_px double, p95_px double, max_px double")
    sizes = points.groupBy("pair").agg(F.count("*").alias("n_points"))
    inf = F.lit(float("inf"))
    return sizes.join(found, "pair", "left").select("pair", "n_points", F.coalesce("n_fits", F.lit(0)).cast("long").alias("n_fits"), *[F.coalesce(c, inf).alias(c) for c in ("median_px", "p95_px", "max_px")])


def _moments(batches):
    total = None
    for pdf in batches:
        rows = [np.asarray(v, float) for v in pdf["bands"] if v is not None]
        rows = [v for v in rows if np.isfinite(v).all()]
        if rows:
            x = np.column_stack([np.ones(len(rows)), np.stack(rows)])
            total = x.T @ x if total is None else total + x.T @ x
    if total is not None:
        yield pd.DataFrame({"row": np.arange(len(total)), "sums": list(total)})


def principal_component(pixels: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """(mean, direction, share of variance) of array column ``bands``; pixels with a non-finite band take no part.

    Each task returns its sums of products, bands squared in size; those are added up and solved on the
    driver. The direction's largest entry is positive. Without pixels all three are empty or zero.
    """
    parts = pixels.select("bands").mapInPandas(_moments, "row int, sums array<double>").select("row", F.posexplode("sums").alias("col", "v")).groupBy("row", "col").agg(F.sum("v").alias("v")).toPandas()
    if not len(parts):
        return np.zeros(0), np.zeros(0), 0.0
    m = np.zeros((parts["row"].max() + 1,) * 2)
    m[parts["row"], parts["col"]] = parts["v"]
    mean = m[0, 1:] / m[0, 0]
    values, vectors = np.linalg.eigh(m[1:, 1:] / m[0, 0] - np.outer(mean, mean))
    d = vectors[:, -1]
    return mean, d * np.sign(d[np.argmax(np.abs(d))]), float(values[-1] / max(values.sum(), 1e-300))


def azimuth_scores(pixels: DataFrame, keys: list[str], elevation_deg: float, step_deg: float = 1.0) -> DataFrame:
    """(keys, azimuth, ncc): correlation of ``image`` with the shading of ``slope`` and ``aspect`` (radians) at each azimuth."""
    n = int(np.ceil(360.0 / step_deg))
    az = F.radians(F.col("azimuth"))
    up = F.radians(F.lit(elevation_deg))
    shade = F.greatest(F.lit(0.0), F.sin(up) * F.cos("slope") + F.cos(up) * F.sin("slope") * F.cos(az - F.col("aspect")))
    every = pixels.dropna(subset=["slope", "aspect", "image"]).withColumn("azimuth", F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i * F.lit(float(step_deg)))))
    return every.groupBy(*keys, "azimuth").agg(F.corr(shade, F.col("image")).alias("ncc"))


def azimuth_fit(scores: DataFrame, keys: list[str], apart_deg: float = 20.0) -> DataFrame:
    """(keys, azimuth, ncc, second, margin): the best azimuth and the best at least ``apart_deg`` from it; ties to the smaller."""
    finite = scores.filter("ncc is not null and not isnan(ncc)")
    order = F.struct("ncc", -F.col("azimuth"))
    best = finite.groupBy(*keys).agg(F.max_by(F.struct("azimuth", "ncc"), order).alias("best"))
    gap = F.pmod(F.col("azimuth") - F.col("best.azimuth"), F.lit(360.0))
    far = finite.join(best, keys).filter(F.least(gap, 360.0 - gap) >= apart_deg)
    second = far.groupBy(*keys).agg(F.max("ncc").alias("second"))
    out = best.join(second, keys, "left")
    return out.select(*keys, F.col("best.azimuth").alias("azimuth"), F.col("best.ncc").alias("ncc"), "second", (F.col("best.ncc") - F.col("second")).alias("margin"))


def bilinear(queries: DataFrame, nodes: DataFrame, step: int) -> DataFrame:
    """``queries`` (x, y, ...) with ``value`` between the four ``nodes`` (col, row, value) around each.

    Nodes sit at multiples of ``step``; on the last one a query belongs to the cell before. A query outside
    the grid, or in a cell with a missing node, has null: nothing is extrapolated. The corners of a cell come
    in one row, so the lookup is a single equi-join.
    """
    n = nodes.select(F.floor(F.col("col") / step).alias("i"), F.floor(F.col("row") / step).alias("j"), "value")
    top = nodes.agg((F.floor(F.max("col") / step) - 1).alias("hi_i"), (F.floor(F.max("row") / step) - 1).alias("hi_j"), F.max("col").alias("x1"), F.max("row").alias("y1"))
    corner = n.select(F.explode(F.array(*[F.struct((F.col("i") - a).alias("i"), (F.col("j") - b).alias("j"), F.lit(2 * a + b).alias("k")) for a in (0, 1) for b in (0, 1)])).alias("c"), "value")
    cells = corner.groupBy("c.i", "c.j").agg(*[F.max(F.when(F.col("c.k") == k, F.col("value"))).alias(f"v{k}") for k in range(4)])
    inside = (F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") <= F.col("x1")) & (F.col("y") <= F.col("y1"))
    q = queries.join(F.broadcast(top))  # one row of extents
    q = q.withColumn("i", F.when(inside, F.least(F.floor(F.col("x") / step), F.col("hi_i")))).withColumn("j", F.when(inside, F.least(F.floor(F.col("y") / step), F.col("hi_j"))))
    fx, fy = F.col("x") / step - F.col("i"), F.col("y") / step - F.col("j")
    value = F.col("v0") * (1 - fx) * (1 - fy) + F.col("v2") * fx * (1 - fy) + F.col("v1") * (1 - fx) * fy + F.col("v3") * fx * fy
    return q.join(cells, ["i", "j"], "left").select(*queries.columns, value.alias("value"))
