"""Relational plans: tallies, de-duplication, caps, verification joins and spatial statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from mosaiq.operators.uniformity import uniformity
from mosaiq.plans.catalogue import query
from mosaiq.session import table

_UNIFORMITY = """
WITH p AS (SELECT event_type AS k, (extract('day' FROM ts) - 1) / 31.0 * 8 AS x, value / 500.0 * 8 AS y FROM events),
i AS (SELECT k, least(7, greatest(0, CAST(trunc(x) AS INT))) AS c, least(7, greatest(0, CAST(trunc(y) AS INT))) AS r
      FROM p WHERE x >= 0 AND x < 8 AND y >= 0 AND y < 8),
g AS (SELECT k, c, r, count(*) AS n FROM i GROUP BY ALL),
t AS (SELECT k, sum(n) AS n_in, count(*) AS occ, sum(n * n) AS s2 FROM g GROUP BY k),
e AS (SELECT g.k, -sum((n / n_in) * ln(n / n_in)) / ln(64.0) AS entropy FROM g JOIN t USING (k) GROUP BY g.k)
SELECT t.k AS group_key, CAST(n_in AS BIGINT) AS n_in, CAST(8 AS INT) AS grid, round(CAST(occ / 64.0 AS DOUBLE), 8) AS coverage, round(entropy, 8) AS entropy,
       round(sqrt(greatest(s2 / 64.0 - (n_in / 64.0) * (n_in / 64.0), 0)) / (n_in / 64.0), 8) AS cv,
       round(sqrt(occ / 64.0 * greatest(entropy, 0)), 8) AS score
FROM t JOIN e USING (k)
"""


@query("uniformity", _UNIFORMITY)
def _uniformity(spark, sf_dir):
    points = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("k"),
        ((F.dayofmonth("ts") - 1) / F.lit(31.0) * 8).alias("x"),
        (F.col("value") / F.lit(500.0) * 8).alias("y"),
    )
    out = uniformity(points, ["k"], "x", "y", 8.0, 8.0, grid=8)
    return out.select(F.col("k").alias("group_key"), "n_in", "grid", *[F.round(c, 8).alias(c) for c in ("coverage", "entropy", "cv", "score")])
