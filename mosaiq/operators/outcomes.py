"""Classified outcomes: every row gets a status; bad rows are counted and sampled, never dropped or raised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ladder(*steps: tuple[str, Column], otherwise: str | None = None) -> Column:
    """The first status whose condition holds; a condition that is null doesn't hold."""
    out = None
    for status, condition in steps:
        hit = F.coalesce(condition, F.lit(False))
        out = F.when(hit, status) if out is None else out.when(hit, status)
    return out if otherwise is None else out.otherwise(otherwise)


def tally(df: DataFrame, status: str, sample: Column, order: Column, keys: list[str] | None = None) -> DataFrame:
    """(keys, status, n, first_sample): counts with the sample of the smallest ``order``; one partial aggregate."""
    return df.groupBy(*(keys or []), status).agg(F.count("*").alias("n"), F.min_by(sample, order).alias("first_sample"))


def with_zeros(counts: DataFrame, status: str, statuses: list[str]) -> DataFrame:
    """``counts`` (status, n) with a row for every known status; the enum is a literal table."""
    every = counts.sparkSession.createDataFrame([(s,) for s in statuses], f"{status} string")
    return every.join(counts, status, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def verify(recorded: DataFrame, found: DataFrame, key: str, size: str, digest: str | None = None, tolerance: float = 0.0) -> DataFrame:
    """Full outer verification: MISSING, UNRECORDED, SIZE_MISMATCH, HASH_MISMATCH or OK for each key."""
    a = recorded.select(F.col(key).alias("_ka"), F.col(size).alias("_sa"), *([F.col(digest).alias("_da")] if digest else []))
    b = found.select(F.col(key).alias("_kb"), F.col(size).alias("_sb"), *([F.col(digest).alias("_db")] if digest else []))
    both = a.join(b, F.col("_ka") == F.col("_kb"), "full_outer")
    steps = [("MISSING", F.col("_kb").isNull()), ("UNRECORDED", F.col("_ka").isNull()), ("SIZE_MISMATCH", F.abs(F.col("_sa") - F.col("_sb")) > tolerance)]
    if digest:
        steps.append(("HASH_MISMATCH", F.col("_da") != F.col("_db")))
    return both.select(F.coalesce("_ka", "_kb").alias(key), ladder(*steps, otherwise="OK").alias("status"))
