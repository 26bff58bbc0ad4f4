"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected by several random rotations, each shifted by an offset of its own, and ordered
along a Hilbert curve of the projected cells. Spark range-partitions and sorts each ordering; a vector's
candidates are those within a window of ranks around it in any ordering, and the windows' candidates are
merged and reranked by exact inner products. Blocks are cut by rank, so equal or crowded vectors never
make a large block. The window is what a bounded sample of queries needs: it is widened until the
sample's true neighbours, found in a scan, lie within it on some curve to the wanted share.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.llm.common import sample_by_hash, stored

DIMENSIONS, BITS = 10, 6


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position of each row of ``cells`` (n, dims; integers below 2**bits) on the Hilbert curve."""
    x = [c.astype(np.int64) for c in cells.T]
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            hit = (x[i] & q) != 0
            t = (x[0] ^ x[i]) & p
            first = np.where(hit, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] = np.where(hit, x[i], x[i] ^ t)
            x[0] = first
        q >>= 1
    for i in range(1, dims):
        x[i] = x[i] ^ x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t = np.where(x[-1] & q, t ^ (q - 1), t)
        q >>= 1
    x = [v ^ t for v in x]
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for v in x:
            key = (key << 1) | ((v >> b) & 1)
    return key


class Curves:
    """Rotations, quantile edges and shifts, fitted on a sample; gives a key for each curve."""

    def __init__(self, sample: np.ndarray, curves: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        dim = sample.shape[1]
        self.maps, self.edges, self.shifts = [], [], []
        for _ in range(curves):
            m = np.linalg.qr(rng.standard_normal((dim, min(dim, DIMENSIONS))))[0]
            self.maps.append(m)
            self.edges.append(np.quantile(sample @ m, np.linspace(0, 1, 257)[1:-1], axis=0))
            self.shifts.append(rng.random(m.shape[1]))

    def keys(self, x: np.ndarray) -> list[np.ndarray]:
        out = []
        for m, edges, shift in zip(self.maps, self.edges, self.shifts):
            y = x @ m
            u = np.stack([np.searchsorted(edges[:, j], y[:, j], side="right") for j in range(y.shape[1])], axis=1) / 256
            cells = np.minimum(((u + shift) / 2 * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
            out.append(hilbert_keys(cells, BITS))
        return out


def matrix(column) -> np.ndarray:
    return np.stack([np.asarray(v, float) for v in column]) if len(column) else np.empty((0, 0))


def top(query_ids, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> pd.DataFrame:
    """The k best of x for each query but itself; ties to smaller ids; scores summed coordinate by coordinate."""
    out = []
    step = max(1, (1 << 21) // max(1, len(ids)))
    for lo in range(0, len(query_ids), step):
        own, part = query_ids[lo : lo + step], q[lo : lo + step]
        rough = part @ x.T
        rough[own[:, None] == ids[None, :]] = -np.inf
        if len(ids) > k:
            least = np.partition(rough, len(ids) - k, axis=1)[:, len(ids) - k]
            margin = 1e-10 * (1 + np.abs(np.where(np.isfinite(least), least, 0)))
            r, c = np.nonzero((rough >= (least - margin)[:, None]) & np.isfinite(rough))
        else:
            r, c = np.nonzero(np.isfinite(rough))
        score = np.zeros(len(r))
        for d in range(x.shape[1]):
            score += part[r, d] * x[c, d]
        order = np.lexsort((ids[c], -score, r))
        r, c, score = r[order], c[order], score[order]
        nth = np.arange(len(r)) - np.searchsorted(r, r, side="left")
        keep = nth < k
        out.append(pd.DataFrame({"query_id": own[r[keep]], "vec_id": ids[c[keep]], "score": score[keep]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})


_FOUND = "query_id long, vec_id long, score double"


def best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def scan(vectors: DataFrame, query_ids: np.ndarray, q: np.ndarray, k: int) -> DataFrame:
    """Exact nearest of a bounded set of queries, in one pass over all vectors."""

    def run(batches):
        for pdf in batches:
            if len(pdf):
                yield top(query_ids, q, pdf["vec_id"].to_numpy(np.int64), matrix(pdf["v"]), k)

    return best(vectors.select("vec_id", "v").mapInPandas(run, _FOUND), k)


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that take part, one row a vec_id.

    Null, empty and zero vectors and those with null or non-finite components don't, nor do rows
    without a vec_id and vectors whose length isn't the commonest (ties: the longer). Of several
    vectors of one vec_id the smallest in order stands.
    """
    v = F.col("v")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    df = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    df = df.filter(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size("v") > 0)).filter(finite & F.exists("v", lambda x: x != 0))
    df = stored(df.groupBy("vec_id").agg(F.min("v").alias("v")))
    common = df.groupBy(F.size("v").alias("n")).count().orderBy(F.col("count").desc(), F.col("n").desc()).first()
    return df.filter(F.size("v") == (common["n"] if common else 0))


def search(embeddings: DataFrame, mod: int = 20, k: int = 20, curves: int = 4, recall: float = 0.96, sample: int = 4096, tuning: int = 96, block: int = 2048, most: int = 16384) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every vector whose id divides by ``mod``.

    ``sample`` vectors fit the curves and ``tuning`` queries the window; both bounds are fixed. A block
    holds ``block`` to ``most`` ranks; a window wider than a block reaches over several. An empty
    table, or one without usable vectors, gives an empty result.
    """
    base = usable(embeddings)
    spark = embeddings.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    seen = matrix([r["v"] for r in sample_by_hash(base, "vec_id", sample).select("v").collect()])
    if not len(seen):
        return empty
    model = Curves(seen, curves)

    def keyed(batches):
        for pdf in batches:
            for c, key in enumerate(model.keys(matrix(pdf["v"])) if len(pdf) else []):
                yield pd.DataFrame({"curve": np.int32(c), "key": key, "vec_id": pdf["vec_id"].to_numpy(np.int64)})

    def numbered(batches):
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), {}
        for pdf in batches:
            local = np.empty(len(pdf), np.int64)
            curve = pdf["curve"].to_numpy()
            for c in np.unique(curve):
                n = int((curve == c).sum())
                local[curve == c] = np.arange(at.get(c, 0), at.get(c, 0) + n)
                at[c] = at.get(c, 0) + n
            yield pd.DataFrame({"curve": curve, "part": np.int32(part), "local": local, "vec_id": pdf["vec_id"]})

    ordered = base.mapInPandas(keyed, "curve int, key long, vec_id long").repartitionByRange("curve", "key", "vec_id").sortWithinPartitions("curve", "key", "vec_id")
    places = stored(ordered.mapInPandas(numbered, "curve int, part int, local long, vec_id long"))
    # One count for each curve and partition: bounded by the number of partitions, not by rows.
    counts = sorted((r["curve"], r["part"], r["n"]) for r in places.groupBy("curve", "part").agg(F.count("*").alias("n")).collect())
    offsets, total = [], {}
    for c, p, n in counts:
        offsets.append((c, p, total.get(c, 0)))
        total[c] = total.get(c, 0) + n
    ranks = places.join(F.broadcast(spark.createDataFrame(offsets, "curve int, part int, first long")), ["curve", "part"]).select("curve", "vec_id", (F.col("first") + F.col("local")).alias("rank"))
    radius = _radius(base, ranks, mod, k, recall, tuning)
    if radius is None:
        return empty
    size = int(min(most, max(block, radius)))
    reach, blocks = -(-radius // size), -(-total[0] // size)

    spots = ranks.groupBy("vec_id").agg(F.collect_list(F.struct("curve", (F.col("rank") / size).cast("long").alias("block"))).alias("spots"))
    rows = stored(base.join(spots, "vec_id").select("vec_id", "v", F.explode("spots").alias("s")).select(F.col("s.curve").alias("curve"), F.col("s.block").alias("block"), "vec_id", "v"))
    asked = rows.filter(F.pmod("vec_id", F.lit(mod)) == 0)
    asked = asked.withColumn("block", F.explode(F.sequence(F.greatest(F.col("block") - reach, F.lit(0)), F.least(F.col("block") + reach, F.lit(blocks - 1)))))

    def rerank(key, queries: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(near):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return top(queries["vec_id"].to_numpy(np.int64), matrix(queries["v"]), near["vec_id"].to_numpy(np.int64), matrix(near["v"]), k)

    found = asked.groupBy("curve", "block").cogroup(rows.groupBy("curve", "block")).applyInPandas(rerank, _FOUND)
    return best(found, k)


def _radius(base: DataFrame, ranks: DataFrame, mod: int, k: int, recall: float, tuning: int) -> int | None:
    """Ranks that a window must reach to each side; None without queries."""
    asked = sample_by_hash(base.filter(F.pmod("vec_id", F.lit(mod)) == 0), "vec_id", tuning, salt=3).collect()
    if not asked:
        return None
    ids = np.array([r["vec_id"] for r in asked], np.int64)
    pairs = [(r["query_id"], r["vec_id"]) for r in scan(base, ids, matrix([r["v"] for r in asked]), k).collect()]
    if not pairs:
        return 1
    wanted = base.sparkSession.createDataFrame([(int(i),) for i in sorted({i for p in pairs for i in p})], "vec_id long")
    at = {(r["curve"], r["vec_id"]): r["rank"] for r in ranks.join(F.broadcast(wanted), "vec_id").collect()}
    curves = {c for c, _ in at}
    gaps = np.sort([min(abs(at[c, a] - at[c, b]) for c in curves) for a, b in pairs])
    return max(64, int(gaps[min(len(gaps) - 1, int(np.ceil(recall * len(gaps))) - 1)]))


