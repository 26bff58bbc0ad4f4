"""Plans over images as rows; small ones are made from the embeddings, 8 x 8 numbers each."""

from __future__ import annotations

from pyspark.sql import functions as F

from mosaiq.operators import images as im
from mosaiq.plans.catalogue import query
from mosaiq.session import table


def _images(spark, d):
    return table(spark, d, "embeddings").filter(F.size("embedding") >= 64).select(F.col("vec_id").cast("long").alias("id"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.slice("embedding", 1, 64).cast("array<double>").alias("pixels"))


@query(
    "image_chain_steps",
    """
WITH e AS (SELECT vec_id, list_min(embedding[1:64]) < list_max(embedding[1:64]) AS lively FROM embeddings WHERE len(embedding) >= 64)
SELECT step, status, CAST(count(*) AS BIGINT) AS n, CAST(min(vec_id) AS BIGINT) AS first_id FROM e, (VALUES ('resample', 'SKIPPED', FALSE), ('normalize', 'RAN', TRUE), ('histogram_match', 'SKIPPED', TRUE), ('invert', 'RAN', TRUE)) s(step, status, needs) WHERE lively GROUP BY 1, 2""",
)
def _steps(spark, d):
    found = im.preprocess(_images(spark, d), {"resample": {}, "normalize": {}, "histogram_match": {}, "invert": {}})
    return im.step_counts(found)


@query(
    "image_halved",
    """
WITH e AS (SELECT vec_id, embedding AS v FROM embeddings WHERE len(embedding) >= 64), c AS (SELECT vec_id, v, unnest(range(0, 16)) AS i FROM e)
SELECT CAST(vec_id AS BIGINT) AS id, CAST(i AS INT) AS cell, round((v[(i // 4) * 16 + (i % 4) * 2 + 1]::DOUBLE + v[(i // 4) * 16 + (i % 4) * 2 + 2] + v[(i // 4) * 16 + (i % 4) * 2 + 9] + v[(i // 4) * 16 + (i % 4) * 2 + 10]) / 4, 5) AS v FROM c""",
)
def _halved(spark, d):
    found = im.preprocess(_images(spark, d), {"resample": {"gsd": 1.0, "target": 2.0}})
    return found.select("id", F.posexplode("pixels").alias("cell", "v")).select("id", "cell", F.round("v", 5).alias("v"))


@query(
    "image_shifted",
    """
WITH e AS (SELECT vec_id, embedding AS v FROM embeddings WHERE len(embedding) >= 64), c AS (SELECT vec_id, v, unnest(range(0, 64)) AS i FROM e)
SELECT CAST(vec_id AS BIGINT) AS id, CAST(i AS INT) AS cell, CASE WHEN i % 8 >= 2 AND i // 8 < 7 THEN round(v[i + 8 - 2 + 1]::DOUBLE, 5) END AS v FROM c""",
)
def _shifted(spark, d):
    a = _images(spark, d)
    m = F.array(*[F.lit(float(v)) for v in (1, 0, 2, 0, 1, -1, 0, 0, 1)])
    moved = im.warp(a, a.select("id", m.alias("matrix"), F.lit(8).alias("out_height"), F.lit(8).alias("out_width")), "linear")
    return moved.select("id", F.posexplode("pixels").alias("cell", "v")).select("id", "cell", F.round("v", 5).alias("v"))


@query("image_pairs_registered")
def _registered(spark, d):
    """Pairs of neighbouring small images: far too little for a match, which each row's status says."""
    a = _images(spark, d)
    pairs = a.select(F.col("id").cast("string").alias("pair"), F.col("id").alias("source_id"), (F.col("id") + 1).alias("reference_id"))
    return im.batch_report(im.register_pairs(pairs, a))
