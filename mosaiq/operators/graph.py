"""Groups of rows linked by pairs, and de-duplication of correspondences within a radius."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.storage import discard, stored


def _union(batches):
    """(id, first) of all ids in the pairs (a, b) of one task, by union-find with the smaller id as root."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not parts:
        return
    ids, at = np.unique(np.concatenate([x for x, _ in parts] + [y for _, y in parts]), return_inverse=True)
    half = len(at) // 2
    root = list(range(len(ids)))
    for x, y in zip(at[:half].tolist(), at[half:].tolist()):
        while root[x] != x:
            root[x] = x = root[root[x]]
        while root[y] != y:
            root[y] = y = root[root[y]]
        if x < y:
            root[y] = x
        else:
            root[x] = y
    for i, r in enumerate(root):  # a root is smaller than its children, so it is final by now
        root[i] = root[r]
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[root])], names=["id", "first"])


def groups(pairs: DataFrame, fits: int = 500_000) -> DataFrame:
    """(id, first): the smallest id (long) that each id of ``pairs`` (a, b) reaches; ids without a pair don't appear.

    While more than ``fits`` pairs are open, each round contracts them: by a coin of the round every id is a head or a
    tail, and a tail joins its smallest neighbour among the heads. So paths never have to be followed, and at least a
    quarter of the ids is expected to go in a round, in whatever order a chain is numbered. The pairs left then fit in
    one task, which ends the work by union-find; the rounds are unwound from there. Minima combine before they are
    shuffled, so a hub costs no more than its pairs. Pairs with a null or with two equal ids count for nothing.
    """
    ends = pairs.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b")
    live = stored(ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    joined: list[DataFrame] = []
    while live.count() > fits:
        heads = F.xxhash64("v", F.lit(len(joined))) % 2 == 0
        both = live.selectExpr("a u", "b v").union(live.selectExpr("b u", "a v"))
        tails = both.filter(heads).groupBy("u").agg(F.min("v").alias("to")).filter(F.xxhash64("u", F.lit(len(joined))) % 2 != 0)
        step = stored(tails)
        joined.append(step)
        moved = live.join(step.selectExpr("u a", "to ta"), "a", "left").join(step.selectExpr("u b", "to tb"), "b", "left").select(F.coalesce("ta", "a").alias("a"), F.coalesce("tb", "b").alias("b"))
        rest = stored(moved.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        discard(live)
        live = rest
    found = live.coalesce(1).mapInArrow(_union, "id long, first long")
    if not joined:
        return stored(found)
    found = stored(found)
    for step in reversed(joined):
        down = step.join(found.withColumnRenamed("id", "to"), "to", "left").select(F.col("u").alias("id"), "to", F.coalesce("first", "to").alias("first"))
        tops = down.select(F.col("to").alias("id"), "first").distinct().join(found, "id", "left_anti")
        found = stored(found.union(down.select("id", "first")).union(tops))
    least = found.groupBy("first").agg(F.min("id").alias("least"))
    return stored(found.join(least, "first").select("id", F.col("least").alias("first")))


def radius_dedup(points: DataFrame, tolerance: float, priority: str | None = None) -> DataFrame:
    """Rows of ``points`` (id, sx, sy, dx, dy, ...) less the repeats of one correspondence.

    Two rows are linked if they lie within ``tolerance`` (inclusive) of each other at both ends; of all that
    are linked, directly or through others, the one of highest ``priority`` stays, of ties the one of largest
    id. A null or NaN priority counts as lowest. Rows with a null coordinate stay.

    Rows that share a cell of a quarter of the tolerance at both ends are linked for certain: each is tied to
    the cell's first row only, and only pairs from different small cells are measured.
    """
    fine = [F.floor(F.col(c) / (tolerance / 4)).alias(f"f_{c}") for c in ("sx", "sy", "dx", "dy")]
    names = [f"f_{c}" for c in ("sx", "sy", "dx", "dy")]
    at = points.select("id", "sx", "sy", "dx", "dy", *fine).dropna()
    cells = at.groupBy(*names).agg(F.min("id").alias("lead"))
    tied = at.join(cells, names).filter("id <> lead").select(F.col("id").alias("a"), F.col("lead").alias("b"))

    coarse = [F.floor(F.col(c) / tolerance) for c in ("sx", "sy", "dx", "dy")]
    around = [F.sequence(c - 1, c + 1) for c in coarse]
    x = at.select(*[F.col(c).alias(f"x_{c}") for c in at.columns], *[c.alias(f"k{i}") for i, c in enumerate(coarse)])
    y = at.withColumns({f"n{i}": c for i, c in enumerate(around)})
    for i in range(4):
        y = y.withColumn(f"k{i}", F.explode(f"n{i}")).drop(f"n{i}")
    pair = x.join(y, [f"k{i}" for i in range(4)]).filter(F.col("x_id") < F.col("id"))
    other = F.lit(False)
    for n in names:
        other = other | (F.col(n) != F.col(f"x_{n}"))
    square = tolerance * tolerance

    def near(u: str, v: str):
        return F.pow(F.col(u) - F.col(f"x_{u}"), 2) + F.pow(F.col(v) - F.col(f"x_{v}"), 2) <= square

    across = pair.filter(other & near("sx", "sy") & near("dx", "dy")).select(F.col("id").alias("a"), F.col("x_id").alias("b"))
    found = groups(tied.unionByName(across))
    p = F.coalesce(F.nanvl(F.col(priority), F.lit(float("-inf"))), F.lit(float("-inf"))) if priority else F.lit(0.0)
    member = points.select("id", p.alias("_p")).join(found, "id")
    gone = member.join(member.groupBy("first").agg(F.max(F.struct("_p", "id")).alias("best")), "first").filter(F.col("id") != F.col("best.id")).select("id")
    return points.join(gone, "id", "left_anti")


def agreement(transforms: DataFrame, tag: str, width: float, height: float, most: float) -> DataFrame:
    """(tag, n_usable, worst, agrees): how far the 3x3 ``matrix`` of each name sends the corners and the centre apart.

    Matrices of null or non-finite entries or a determinant below 1e-12 are no use. ``worst`` is the largest
    distance over probes and pairs of names; a tag agrees if it has two usable matrices and ``worst`` is at most ``most``.
    """
    m = F.col("matrix")
    det = m[0] * (m[4] * m[8] - m[5] * m[7]) - m[1] * (m[3] * m[8] - m[5] * m[6]) + m[2] * (m[3] * m[7] - m[4] * m[6])
    good = transforms.filter((F.size(m) == 9) & F.forall(m, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & (F.abs(det) >= 1e-12))
    probes = [(0.0, 0.0), (width - 1, 0.0), (0.0, height - 1), (width - 1, height - 1), ((width - 1) / 2, (height - 1) / 2)]

    def sent(x: float, y: float):
        w = m[6] * x + m[7] * y + m[8]
        return F.struct(((m[0] * x + m[1] * y + m[2]) / w).alias("x"), ((m[3] * x + m[4] * y + m[5]) / w).alias("y"))

    points = good.select(tag, "name", F.array(*[sent(x, y) for x, y in probes]).alias("p"))
    usable = points.groupBy(tag).agg(F.count("*").alias("n_usable"))
    a, b = points.select(tag, F.col("name").alias("na"), F.col("p").alias("pa")), points.select(tag, F.col("name").alias("nb"), F.col("p").alias("pb"))
    apart = F.array_max(F.zip_with("pa", "pb", lambda u, v: F.hypot(u["x"] - v["x"], u["y"] - v["y"])))
    worst = a.join(b, tag).filter("na < nb").groupBy(tag).agg(F.max(apart).alias("worst"))
    return usable.join(worst, tag, "left").withColumn("agrees", (F.col("n_usable") >= 2) & F.coalesce(F.col("worst") <= most, F.lit(False)))
