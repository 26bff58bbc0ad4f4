"""What a viewer shows: pictures made of two images, and tables sorted, filtered and looked up."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.operators.kernels import area_resized, stretch


def checkerboard(a: np.ndarray, b: np.ndarray, cells: int = 8) -> np.ndarray:
    """Squares of the two images in turn, the first image's in the upper left."""
    h, w = a.shape
    i, j = np.arange(h) * cells // max(h, 1), np.arange(w) * cells // max(w, 1)
    return np.where((i[:, None] + j[None]) % 2 == 0, a, b)


def blended(a: np.ndarray, b: np.ndarray, share: float = 0.5) -> np.ndarray:
    return (1 - share) * a + share * b


def anaglyph(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(h, w, 3) bytes: the first image in red, the second in green and blue."""
    return np.stack([stretch(a), stretch(b), stretch(b)], axis=-1)


def overlay(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(h, w, 3) bytes: red and green; what agrees is yellow."""
    return np.stack([stretch(a), stretch(b), np.zeros(a.shape, np.uint8)], axis=-1)


def side_by_side(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, int]:
    """Both images next to each other, and the column where the second begins."""
    out = np.zeros((max(a.shape[0], b.shape[0]), a.shape[1] + b.shape[1]))
    out[: a.shape[0], : a.shape[1]], out[: b.shape[0], a.shape[1] :] = a, b
    return out, a.shape[1]


def thumbnail(image: np.ndarray, most: int = 1024) -> tuple[np.ndarray, float]:
    """The image with its longer edge at most ``most`` pixels, and the scale."""
    scale = min(1.0, most / max(image.shape))
    return (image, 1.0) if scale == 1 else (area_resized(image, *(max(1, round(n * scale)) for n in image.shape)), scale)


def histogram(points: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n) of values in [low, high], the last bin closed, empty ones with zero."""
    at = F.least(F.floor((F.col(value) - low) / (high - low) * bins), F.lit(bins - 1)).cast("int")
    counts = points.filter(F.col(value).between(low, high)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    every = points.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def sorted_nulls_last(df: DataFrame, by: str, ascending: bool = True, tie: str | None = None) -> DataFrame:
    """Rows by a column, nulls and NaN after all others whichever the direction."""
    c = F.col(by)
    if dict(df.dtypes)[by] in ("double", "float"):
        c = F.when(~F.isnan(c), c)
    return df.orderBy(c.asc_nulls_last() if ascending else c.desc_nulls_last(), *([tie] if tie else []))


def choices(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value): what each filter may be set to."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
    return df.select(pairs.alias("p")).select("p.*").filter("value is not null").distinct()


def self_by_truth(own: Column, truth: Column) -> Column:
    """A residual of its own by the true one; null without truth."""
    return F.when(truth > 0, own / truth)


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)
