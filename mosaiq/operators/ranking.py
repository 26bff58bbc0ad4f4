"""Caps, de-duplication by preference, lexicographic choice, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cap(df: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """At most ``most`` rows a group in the given total order (Spark prunes groups before the shuffle)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= most).drop("_rn")


def prefer(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group; ``order`` must be total for the result to be fixed."""
    return cap(df, keys, order, 1)


def gate(results: DataFrame, tag: list[str], group: list[str], count: str, score: str, ok: str, least: int = 20, share: float = 0.7) -> DataFrame:
    """The deciding result of each tag.

    In a group the best result has most counts among those of score at least ``share``, else overall. It
    passes with ``least`` counts, that score and an agreement. A tag takes its passing group of most
    counts, else its best group.
    """
    best = prefer(results, tag + group, [(F.col(score) >= share).desc(), F.col(count).desc(), F.col(score).desc()])
    best = best.withColumn("passes", (F.col(count) >= least) & (F.col(score) >= share) & F.col(ok))
    return prefer(best, tag, [F.col("passes").desc(), F.col(count).desc(), *[F.col(g) for g in group]])
