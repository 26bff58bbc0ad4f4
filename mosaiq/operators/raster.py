"""Pixel-row operators: stretch, shadows, levels, histogram matching, tiles, dilation, resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def limits(df: DataFrame, keys: list[str], v: str, lo: float, hi: float) -> DataFrame:
    """Exact percentiles of each image, interpolated; nulls and NaN don't count."""
    x = F.when(~F.isnan(v), F.col(v))
    return df.groupBy(*keys).agg(F.percentile(x, F.array(F.lit(lo), F.lit(hi))).alias("_p")).select(*keys, F.col("_p")[0].alias("lo"), F.col("_p")[1].alias("hi"))


def stretched(v: Column, lo: Column, hi: Column) -> Column:
    """0..255 without mask: a flat image is all 0; fractions are cut off."""
    return F.when(hi <= lo, 0).otherwise(((F.least(F.greatest(v, lo), hi) - lo) / (hi - lo) * 255).cast("int"))


def stretched_masked(v: Column, lo: Column, hi: Column, valid: Column) -> Column:
    """1..255 where valid, 0 elsewhere."""
    z = (v - lo) / F.greatest(hi - lo, F.lit(1e-6)) * 254 + 1
    return F.when(valid, F.least(F.greatest(z, F.lit(1.0)), F.lit(255.0)).cast("int")).otherwise(0)


def zscore(v: Column, mean: Column, std: Column) -> Column:
    return F.when(std < 1e-8, F.lit(0.0)).otherwise((v - mean) / std)


def shadow_gamma(v: Column, lo: Column, thr: Column, hi: Column, gamma: float = 0.5) -> Column:
    inside = lo + F.pow(F.least(F.greatest((v - lo) / (thr - lo), F.lit(0.0)), F.lit(1.0)), F.lit(gamma)) * (thr - lo)
    return F.when((hi > lo) & (thr - lo > 1e-6) & (v <= thr), inside).otherwise(v)


def match_levels(source: DataFrame, reference: DataFrame, v: str = "v") -> DataFrame:
    """(v, matched): for each level 0..255 of the source the least reference level whose share reaches its own."""

    def cdf(df, name):
        n = df.groupBy(F.col(v).alias("v")).agg(F.count("*").alias("n"))
        w = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)  # at most 256 rows
        return n.select("v", (F.sum("n").over(w) / F.sum("n").over(Window.partitionBy())).alias(name))

    s, r = cdf(source, "s"), cdf(reference, "r").withColumnRenamed("v", "level")
    found = s.join(F.broadcast(r), F.col("r") >= F.col("s"), "left").groupBy("v").agg(F.min("level").alias("matched"))
    return found.select("v", F.coalesce("matched", F.lit(255)).alias("matched"))


def mode_shares(pixels: DataFrame, keys: list[str], v: str, most: int = 5) -> DataFrame:
    """(keys, v, n, share): the commonest values of each group with their share of its pixels; ties to the smaller value."""
    n = pixels.groupBy(*keys, v).agg(F.count("*").alias("n"))
    by = Window.partitionBy(*keys)
    ranked = n.withColumn("share", F.col("n") / F.sum("n").over(by)).withColumn("_rn", F.row_number().over(by.orderBy(F.col("n").desc(), v)))
    return ranked.filter(F.col("_rn") <= most).drop("_rn")


def border(row: Column, col: Column, height: Column, width: Column, share: float = 0.02) -> Column:
    """Whether a pixel lies in the outer share of rows or columns, one at least."""
    k, m = F.greatest(F.lit(1), (height * share).cast("int")), F.greatest(F.lit(1), (width * share).cast("int"))
    return (row < k) | (row >= height - k) | (col < m) | (col >= width - m)


def fill_candidate(shares: DataFrame, keys: list[str], v: str, least: float = 0.5) -> DataFrame:
    """(keys, fill): the value that holds at least half of a border, if one does."""
    return shares.filter(F.col("share") >= least).groupBy(*keys).agg(F.max_by(v, "share").alias("fill"))


def tile_starts(extent: Column, size: Column, stride: Column) -> Column:
    """0, stride, … up to extent - size, which is always the last; one tile for a small extent."""
    last = extent - size
    regular = F.sequence(F.lit(0), F.greatest(last, F.lit(0)), stride)
    return F.when(extent <= size, F.array(F.lit(0))).otherwise(F.array_distinct(F.concat(regular, F.array(last))))


def plan_tiles(images: DataFrame, key: str, height: str, width: str, tile: int, overlap: float = 0.25) -> DataFrame:
    """Row-major tiles of each image; the plan is an expression, no shuffle."""
    if not 0 <= overlap < 1:
        raise ValueError("overlap must lie in [0, 1)")
    stride = max(1, round(tile * (1 - overlap)))
    h, w, t, s = F.col(height).cast("int"), F.col(width).cast("int"), F.lit(tile), F.lit(stride)
    rows = images.select(key, h.alias("_h"), w.alias("_w"), F.posexplode(tile_starts(h, t, s)).alias("ti", "row_off"))
    cols = rows.select(key, "_h", "_w", "ti", "row_off", F.posexplode(tile_starts(F.col("_w"), t, s)).alias("tj", "col_off"))
    return cols.select(key, "ti", "tj", "row_off", "col_off", F.least(F.lit(tile), F.col("_h")).alias("height"), F.least(F.lit(tile), F.col("_w")).alias("width"))


def dilate(df: DataFrame, keys: list[str], r: str, c: str, v: str, reach: int = 1) -> DataFrame:
    """Square maximum filter of sparse pixels: each pixel is offered to its neighbours, then a maximum."""
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    out = df.select(*keys, F.col(r).alias("_r"), F.col(c).alias("_c"), F.col(v).alias("_v"), F.explode(steps).alias("_dr")).withColumn("_dc", F.explode(steps))
    offered = out.groupBy(*keys, (F.col("_r") + F.col("_dr")).alias(r), (F.col("_c") + F.col("_dc")).alias(c)).agg(F.max("_v").alias(v))
    return offered.join(df.select(*keys, r, c).distinct(), [*keys, r, c], "left_semi")


def area_mean(df: DataFrame, keys: list[str], r: str, c: str, v: str, factor: int) -> DataFrame:
    return df.groupBy(*keys, F.floor(F.col(r) / factor).alias(r), F.floor(F.col(c) / factor).alias(c)).agg(F.avg(v).alias(v), F.count("*").alias("n"))
