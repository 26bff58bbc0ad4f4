"""Descriptor matching: two nearest neighbours, ratio test, mutual check."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Train vectors held against a query block at a time.
BLOCK = 2048


def _two(queries: DataFrame, train: DataFrame) -> DataFrame:
    """(query_id, train_id, distance) of the two nearest of each query in every block pair.

    Both sides are dealt into blocks by hash and every pair of blocks is one task's matrix product:
    exact, no side is broadcast or collected, and only two rows a query and block leave the workers.
    """
    n_q, n_t = queries.count(), train.count()
    bq, bt = max(1, -(-n_q // BLOCK)), max(1, -(-n_t // BLOCK))
    q = queries.select(F.col("vec_id").alias("id"), "v", F.pmod(F.xxhash64("vec_id"), F.lit(bq)).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bt - 1).cast("long"))).alias("j"))
    t = train.select(F.col("vec_id").alias("id"), "v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bq - 1).cast("long"))).alias("i"), F.pmod(F.xxhash64("vec_id"), F.lit(bt)).alias("j"))

    def near(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "train_id": [], "distance": []})
        b = b.sort_values("id")
        x, y = np.stack(a["v"]), np.stack(b["v"])
        out = []
        for row, i in zip(x, a["id"]):
            d = np.sqrt(((y - row) ** 2).sum(axis=1))
            for j in np.argsort(d, kind="stable")[:2]:
                out.append((i, b["id"].iloc[j], d[j]))
        return pd.DataFrame(out, columns=["query_id", "train_id", "distance"])

    return q.groupBy("i", "j").cogroup(t.groupBy("i", "j")).applyInPandas(near, "query_id long, train_id long, distance double")


def knn2(queries: DataFrame, train: DataFrame, ratio: float = 0.75) -> DataFrame:
    """(query_id, train_id, distance, score): the nearest, where it is nearer than ``ratio`` times the second.

    Queries of fewer than two neighbours are passed over; ties go to the smaller id.
    """
    w = Window.partitionBy("query_id").orderBy("distance", "train_id")
    two = _two(queries, train).withColumn("rn", F.row_number().over(w)).withColumn("second", F.lead("distance").over(w))
    best = two.filter((F.col("rn") == 1) & (F.col("distance") < ratio * F.col("second")))
    return best.select("query_id", "train_id", "distance", (1 - F.col("distance") / F.greatest("second", F.lit(1e-9))).alias("score"))


def mutual(queries: DataFrame, train: DataFrame, ratio: float = 0.75) -> DataFrame:
    """Matches that pass the ratio test in both directions."""
    back = knn2(train, queries, ratio).select(F.col("query_id").alias("train_id"), F.col("train_id").alias("query_id"))
    return knn2(queries, train, ratio).join(back, ["query_id", "train_id"], "left_semi")
