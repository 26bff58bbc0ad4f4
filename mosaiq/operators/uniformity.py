"""How evenly points cover a frame: cell counts, coverage, entropy, coefficient of variation, score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell(v: Column, extent, grid: Column) -> Column:
    """Index of the cell of ``v`` in [0, extent), truncated and clipped to the grid."""
    return F.least(grid - 1, F.greatest(F.lit(0), (v / F.greatest(F.lit(extent), F.lit(1.0)) * grid).cast("int")))


def cell_counts(points: DataFrame, keys: list[str], x: str, y: str, width: float, height: float, grid: Column) -> DataFrame:
    """Points in frame per occupied cell; partial sums are made before the one shuffle on (keys, cell)."""
    inside = points.filter((F.col(x) >= 0) & (F.col(x) < width) & (F.col(y) >= 0) & (F.col(y) < height))
    return inside.groupBy(*keys, cell(F.col(y), height, grid).alias("row"), cell(F.col(x), width, grid).alias("col")).agg(F.count("*").alias("n"))


def uniformity(points: DataFrame, keys: list[str], x: str, y: str, width: float, height: float, grid: int = 8, adaptive: bool = False) -> DataFrame:
    """One row per group: n_in, grid, coverage, entropy, cv and score = sqrt(coverage * entropy).

    With ``adaptive`` the grid is min(grid, max(2, floor(sqrt(n_in)))). Empty cells count as zeros in cv.
    Groups without a point in frame don't appear. Means and squares come from one aggregate over cells.
    """
    if adaptive:
        inside = (F.col(x) >= 0) & (F.col(x) < width) & (F.col(y) >= 0) & (F.col(y) < height)
        sizes = points.groupBy(*keys).agg(F.sum(inside.cast("int")).alias("_n"))
        sizes = sizes.withColumn("grid", F.least(F.lit(grid), F.greatest(F.lit(2), F.floor(F.sqrt("_n")).cast("int")))).drop("_n")
        points = points.join(sizes, keys)
    else:
        points = points.withColumn("grid", F.lit(grid))
    counts = cell_counts(points, [*keys, "grid"], x, y, width, height, F.col("grid"))
    n_in, cells = F.sum("n"), F.col("grid") * F.col("grid")
    # -sum p ln p = ln N - (sum n ln n) / N: one aggregate, no second pass for N
    sums = counts.groupBy(*keys, "grid").agg(
        n_in.alias("n_in"), F.count("*").alias("_occ"), F.sum(F.col("n") * F.col("n")).alias("_s2"), F.sum(F.col("n") * F.log("n")).alias("_nln")
    )
    mean = F.col("n_in") / cells
    return sums.select(
        *keys,
        "n_in",
        "grid",
        (F.col("_occ") / cells).alias("coverage"),
        F.when(cells == 1, F.lit(1.0)).otherwise((F.log("n_in") - F.col("_nln") / F.col("n_in")) / F.log(cells)).alias("entropy"),
        (F.sqrt(F.greatest(F.col("_s2") / cells - mean * mean, F.lit(0.0))) / mean).alias("cv"),
    ).withColumn("score", F.sqrt(F.greatest("coverage", F.lit(0.0)) * F.greatest("entropy", F.lit(0.0))))
