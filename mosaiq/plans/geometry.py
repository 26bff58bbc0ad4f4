"""Plans over labels, correspondences, fits, streams and page markup."""

from __future__ import annotations

from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from mosaiq.operators.fitting import azimuth_fit, azimuth_scores, bilinear, bootstrap, principal_component, robust_affine
from mosaiq.operators.graph import agreement, radius_dedup
from mosaiq.operators.outcomes import tally
from mosaiq.operators.ranking import prefer
from mosaiq.plans.catalogue import query
from mosaiq.session import table
from mosaiq.sources.catalogues import grid_rows
from mosaiq.streaming.jobs import window_tally


@query(
    "radius_dedup",
    """
WITH RECURSIVE p AS (SELECT event_id AS id, epoch(ts) AS t, value AS v FROM events),
l AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON b.t BETWEEN a.t - 30 AND a.t + 30 AND abs(a.v - b.v) * 6 <= 30 AND a.id <> b.id),
r(id, to_) AS (SELECT DISTINCT a, a FROM l UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.to_),
g AS (SELECT id, min(to_) AS first FROM r GROUP BY 1),
k AS (SELECT id, row_number() OVER (PARTITION BY first ORDER BY v DESC, id DESC) AS rn FROM g JOIN p USING (id))
SELECT id AS event_id, v AS value FROM p WHERE id NOT IN (SELECT id FROM k WHERE rn > 1)""",
)
def _dedup(spark, d):
    p = table(spark, d, "events").select(F.col("event_id").alias("id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("sx"), F.lit(0.0).alias("sy"), (F.col("value") * 6).alias("dx"), F.lit(0.0).alias("dy"), "value")
    return radius_dedup(p, 30.0, "value").select(F.col("id").alias("event_id"), "value")


@query(
    "agreement_pairwise",
    """
WITH t AS (SELECT l_linestatus AS tag, l_returnflag AS name, 1 + avg(l_tax) / 100 AS s, avg(l_quantity) AS dx, avg(l_discount) * 100 AS dy FROM lineitem GROUP BY 1, 2),
c AS (SELECT * FROM (VALUES (0.0,0.0),(511.0,0.0),(0.0,511.0),(511.0,511.0),(255.5,255.5)) v(x, y)),
p AS (SELECT tag, name, x, y, s * x + dx AS u, s * y + dy AS v FROM t, c)
SELECT a.tag, CAST((SELECT count(*) FROM t WHERE t.tag = a.tag) AS BIGINT) AS n_usable, round(max(sqrt((a.u - b.u) * (a.u - b.u) + (a.v - b.v) * (a.v - b.v))), 6) AS worst,
  max(sqrt((a.u - b.u) * (a.u - b.u) + (a.v - b.v) * (a.v - b.v))) <= 1.0 AS agrees FROM p a JOIN p b ON a.tag = b.tag AND a.name < b.name AND a.x = b.x AND a.y = b.y GROUP BY a.tag""",
)
def _agreement(spark, d):
    t = table(spark, d, "lineitem").groupBy(F.col("l_linestatus").alias("tag"), F.col("l_returnflag").alias("name")).agg((1 + F.avg("l_tax") / 100).alias("s"), F.avg("l_quantity").alias("dx"), (F.avg("l_discount") * 100).alias("dy"))
    zero, one = F.lit(0.0), F.lit(1.0)
    m = t.select("tag", "name", F.array("s", zero, "dx", zero, "s", "dy", zero, zero, one).alias("matrix"))
    out = agreement(m, "tag", 512.0, 512.0, 1.0).filter("worst is not null")
    return out.select("tag", "n_usable", F.round("worst", 6).alias("worst"), "agrees")


def _correspondences(spark, d):
    """Line items as points that follow one affine transform per return flag, every fifth one astray."""
    x, y = F.col("l_quantity"), F.col("l_linenumber") * 7.0 + F.col("l_discount") * 100
    off = F.when(F.col("l_orderkey") % 5 == 0, 40.0 + F.col("l_partkey") % 97).otherwise(0.0)
    noise = F.col("l_tax") - 0.04
    return table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("pair"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), x.alias("sx"), y.alias("sy"), (1.02 * x + 0.01 * y + 12 + noise + off).alias("dx"), (0.99 * y - 0.015 * x - 7 - noise + off).alias("dy")
    )


@query("ransac_fit")
def _robust(spark, d):
    return robust_affine(_correspondences(spark, d)).select("pair", "n", "n_inliers", F.transform("affine", lambda v: F.round(v, 6)).alias("affine"))


@query("bootstrap_conditioning")
def _bootstrap(spark, d):
    return bootstrap(_correspondences(spark, d), 512.0, 512.0)


@query(
    "azimuth_fit",
    """
WITH p AS (SELECT event_type AS k, (value / 500.0) * 0.6 AS slope, radians(event_id % 360) AS aspect, value / 500.0 + (user_id % 7) / 20.0 + cos(radians(120.0) - radians(event_id % 360)) AS image FROM events),
s AS (SELECT k, a, corr(greatest(0.0, sin(radians(35)) * cos(slope) + cos(radians(35)) * sin(slope) * cos(radians(a) - aspect)), image) AS c FROM p, (SELECT range * 10.0 AS a FROM range(36)) GROUP BY 1, 2),
b AS (SELECT k, max_by(a, c) AS a, max(c) AS c FROM s GROUP BY 1)
SELECT b.k, CAST(b.a AS DOUBLE) AS azimuth, round(b.c, 6) AS ncc, round(max(s.c), 6) AS second, round(b.c - max(s.c), 6) AS margin FROM b JOIN s ON s.k = b.k AND least(abs(s.a - b.a), 360 - abs(s.a - b.a)) >= 20 GROUP BY b.k, b.a, b.c""",
)
def _azimuth(spark, d):
    around = F.radians((F.col("event_id") % 360).cast("double"))
    p = table(spark, d, "events").select(F.col("event_type").alias("k"), (F.col("value") / 500.0 * 0.6).alias("slope"), around.alias("aspect"), (F.col("value") / 500.0 + (F.col("user_id") % 7) / 20.0 + F.cos(F.radians(F.lit(120.0)) - around)).alias("image"))
    return azimuth_fit(azimuth_scores(p, ["k"], 35.0, 10.0), ["k"]).select("k", "azimuth", *[F.round(c, 6).alias(c) for c in ("ncc", "second", "margin")])


@query(
    "convention_argmin",
    """
WITH p AS (SELECT c_nationkey AS nation, CAST(c_custkey * 37 % 360 AS DOUBLE) AS truth, CAST(CASE WHEN c_nationkey % 2 = 0 THEN c_custkey * 37 % 360 + 180 + c_custkey % 5 ELSE 360 - c_custkey * 37 % 360 + c_custkey % 3 END AS DOUBLE) AS label FROM customer),
e AS (SELECT nation, o, conv, abs((a - truth + 720.0 + 180.0) % 360.0 - 180.0) AS err FROM (SELECT nation, truth, unnest([{'o': 0, 'conv': 'as_is', 'a': label}, {'o': 1, 'conv': 'plus_180', 'a': label + 180}, {'o': 2, 'conv': 'mirror', 'a': 360 - label}, {'o': 3, 'conv': 'mirror_plus_180', 'a': 180 - label}], recursive := true) FROM p)),
m AS (SELECT nation, o, conv, median(err) AS err FROM e GROUP BY 1, 2, 3)
SELECT nation, conv AS convention, round(err, 6) AS median_error FROM m QUALIFY row_number() OVER (PARTITION BY nation ORDER BY round(err, 9), o) = 1""",
)
def _convention(spark, d):
    k = F.col("c_custkey") * 37 % 360
    label = F.when(F.col("c_nationkey") % 2 == 0, k + 180 + F.col("c_custkey") % 5).otherwise(360 - k + F.col("c_custkey") % 3).cast("double")
    p = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), k.cast("double").alias("truth"), label.alias("label"))
    ways = {"as_is": F.col("label"), "plus_180": F.col("label") + 180, "mirror": 360 - F.col("label"), "mirror_plus_180": 180 - F.col("label")}
    each = p.select("nation", "truth", F.explode(F.array(*[F.struct(F.lit(i).alias("o"), F.lit(n).alias("convention"), a.alias("a")) for i, (n, a) in enumerate(ways.items())])).alias("w"))
    error = F.abs(F.pmod(F.col("w.a") - F.col("truth") + 180.0, F.lit(360.0)) - 180.0)
    m = each.groupBy("nation", "w.o", "w.convention").agg(F.percentile(error, 0.5).alias("err"))
    return prefer(m, ["nation"], [F.round("err", 9), F.col("o")]).select("nation", "convention", F.round("err", 6).alias("median_error"))


@query(
    "bilinear_interp",
    """
WITH n AS (SELECT l_orderkey % 20 AS i, l_linenumber AS j, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2),
q AS (SELECT o_orderkey, CAST(o_custkey * 13 % 2100 AS DOUBLE) AS x, 100 + CAST(o_orderkey % 640 AS DOUBLE) AS y FROM orders),
c AS (SELECT *, CASE WHEN x <= 1900 AND y <= 700 THEN least(floor(x / 100), 18) END AS i, least(floor(y / 100), 6) AS j FROM q)
SELECT o_orderkey, round(a.v * (1 - (x / 100 - c.i)) * (1 - (y / 100 - c.j)) + b.v * (x / 100 - c.i) * (1 - (y / 100 - c.j)) + e.v * (1 - (x / 100 - c.i)) * (y / 100 - c.j) + f.v * (x / 100 - c.i) * (y / 100 - c.j), 6) AS value
FROM c LEFT JOIN n a ON a.i = c.i AND a.j = c.j LEFT JOIN n b ON b.i = c.i + 1 AND b.j = c.j LEFT JOIN n e ON e.i = c.i AND e.j = c.j + 1 LEFT JOIN n f ON f.i = c.i + 1 AND f.j = c.j + 1""",
)
def _bilinear(spark, d):
    nodes = table(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 20 * 100).alias("col"), (F.col("l_linenumber") * 100).alias("row")).agg(F.avg("l_quantity").alias("value"))
    q = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") * 13 % 2100).cast("double").alias("x"), (100 + F.col("o_orderkey") % 640).cast("double").alias("y"))
    return bilinear(q, nodes, 100).select("o_orderkey", F.round("value", 6).alias("value"))


@query("pca_top1")
def _pca(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("bands"))
    mean, direction, share = principal_component(e)
    shift = float(np.dot(mean, direction))
    dot = F.aggregate(F.zip_with("bands", F.array(*[F.lit(float(v)) for v in direction]), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return e.select("vec_id", F.round(dot - shift, 6).alias("pc1"), F.lit(round(share, 6)).alias("share"))


@query("mim_argmax_recode", "SELECT vec_id, CAST(list_position(v, list_max(v)) - 1 AS INT) AS mim, CAST((list_position(v, list_max(v)) - 1 - label % len(v) + len(v)) % len(v) AS INT) AS recoded FROM (SELECT vec_id, label, embedding AS v FROM embeddings)")
def _mim(spark, d):
    """Strongest of all orientations, and its number once the frame is turned by the row's label."""
    v = F.col("embedding")
    mim = (F.array_position(v, F.array_max(v)) - 1).cast("int")
    return table(spark, d, "embeddings").select("vec_id", mim.alias("mim"), F.pmod(mim - F.col("label"), F.size(v)).cast("int").alias("recoded"))


@query(
    "grid_row_outcomes",
    """
WITH l AS (SELECT l_orderkey * 10 + l_linenumber AS k, CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_quantity END AS q, l_orderkey % 13 = 0 AS short, l_orderkey % 17 = 0 AS far, l_linenumber AS ln FROM lineitem)
SELECT CASE WHEN q IS NULL THEN 'EMPTY_ROW' WHEN short THEN 'WRONG_FIELD_COUNT' WHEN ln = 7 THEN 'NON_NUMERIC' WHEN far THEN 'COORDINATE_OUT_OF_RANGE' WHEN q > 40 THEN 'INDEX_OUT_OF_RANGE' ELSE 'OK' END AS status, count(*) AS n, min(k) AS first_sample FROM l GROUP BY 1""",
)
def _grid_rows(spark, d):
    whole, key = F.col("l_quantity").cast("int").cast("string"), F.col("l_orderkey")
    lat = F.when(key % 17 == 0, "95.5").otherwise("12.25")
    scan = F.when(F.col("l_linenumber") == 7, "7.0").otherwise(F.col("l_linenumber").cast("string"))
    full = F.when(key % 13 == 0, F.concat_ws(",", F.lit("30.5"), lat, whole)).otherwise(F.concat_ws(",", F.lit("30.5"), lat, whole, scan))
    lines = table(spark, d, "lineitem").select((key * 10 + F.col("l_linenumber")).alias("lineno"), F.when(key % 11 == 0, " ").otherwise(full).alias("line"))
    return tally(grid_rows(lines, ["Longitude", "Latitude", "Pixel", "Scan"], n_samples=41), "status", F.col("lineno"), F.col("lineno"))


@query("window_tally", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _windows(spark, d):
    out = window_tally(table(spark, d, "events"), "ts", "event_type", "value", "1 day")
    return out.withColumn("total", F.round("total", 4))


class _Leaves(HTMLParser):
    """Leaf elements of a page: a text that lies directly between a start tag and the end tag that follows it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.text, self.found = None, [], []

    def handle_starttag(self, tag, attrs):
        self.open, self.text = tag, []

    def handle_data(self, data):
        self.text.append(data)

    def handle_endtag(self, tag):
        text = "".join(self.text).strip()
        if self.open == tag and text:
            self.found.append((tag, text))
        self.open, self.text = None, []


def _leaf_rows(batches):
    for pdf in batches:
        rows = []
        for page, html in zip(pdf["page_id"], pdf["html"]):
            parser = _Leaves()
            parser.feed(html or "")
            parser.close()
            rows += [(page, i, tag, text) for i, (tag, text) in enumerate(parser.found)]
        yield pd.DataFrame(rows, columns=["page_id", "ordinal", "tag", "value"])


@query("html_leaf_probe")
def _leaf_probe(spark, d):
    rows = table(spark, d, "pages").select("page_id", "html").mapInPandas(_leaf_rows, "page_id long, ordinal int, tag string, value string")
    return rows.withColumn("is_numeric", F.expr("try_cast(value as double)").isNotNull())
