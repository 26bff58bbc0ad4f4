"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source starts with the same expected number of copies, target / source size. The
whole part is taken as is; the fractions are rounded in pairs: words are moved at random between two
documents, so that the expected words stay what they were, until one of them is integral. Groups of a
bounded number of documents do this apart, and the one fraction that each leaves goes up a reduction
tree. A source's words so miss its target by less than one (mostly short) document.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.llm.common import SPACES, stored

WEIGHTS = (3, 1, 2)
_EPS = 1e-12


def word_count(text):
    """Number of runs without ASCII white space; null: 0."""
    body = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(body == "", F.lit(0)).otherwise(F.size(F.split(body, "[ \\t\\n\\x0B\\f\\r]+"))).cast("long")


def row_key():
    """A hash of id, text and source, nulls told apart from empty texts."""
    return F.xxhash64(*[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null")) for c in ("doc_id", "text", "source")])


def targets(sizes: DataFrame, weights=WEIGHTS, total: float = 1.5, most: float = 2.0) -> DataFrame:
    """``sizes`` (source, source_size: one row a source) with column target.

    Sources by code point, null last, get the weights in turn; together they get ``total`` of all
    words, none more than ``most`` of its own. What the capped leave is shared by weight until none
    is above: that is min(cap, level * weight). In the order of cap / weight, the level that fills what
    the sources before leave rises while the next source is capped too and falls after, so the
    greatest is the right one. The windows run over sources, one row each, not over documents.
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode(F.col("source"), "UTF-8"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    df = sizes.withColumn("_w", w).withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), "source")
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    capped, open_ = F.coalesce(F.sum("_cap").over(before), F.lit(0.0)), F.sum("_w").over(after)
    df = df.withColumn("_level", (F.sum("source_size").over(Window.partitionBy()) * total - capped) / open_)
    level = F.max("_level").over(Window.partitionBy())
    return df.withColumn("target", F.least("_cap", F.coalesce(level * F.col("_w"), F.col("_cap")))).select("source", "source_size", "target")


def _uniform(seed: int, a: int, b: int) -> float:
    import xxhash

    return (xxhash.xxh3_64_intdigest(f"{seed}:{a}:{b}".encode()) >> 11) / (1 << 53)


def pivot(size: np.ndarray, p: np.ndarray, draws) -> int:
    """Rounds ``p`` in place; returns the index that is left with a fraction, or -1.

    The sum of size * p is kept: the pair moves words from one to the other or back, with chances
    that leave the expectation of both, and stops where one of them is 0 or 1.
    """
    i = -1
    for j in range(len(p)):
        if p[j] <= _EPS or p[j] >= 1 - _EPS:
            p[j] = round(p[j])
            continue
        if i < 0:
            i = j
            continue
        up, down = min((1 - p[i]) * size[i], p[j] * size[j]), min(p[i] * size[i], (1 - p[j]) * size[j])
        move = up if next(draws) * (up + down) < down else -down
        p[i] += move / size[i]
        p[j] -= move / size[j]
        for x in (i, j):
            if p[x] <= _EPS or p[x] >= 1 - _EPS:
                p[x] = round(p[x])
        i = i if 0 < p[i] < 1 else (j if 0 < p[j] < 1 else -1)
    return i


def _round_group(seed: int):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "row_key", "doc_id"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        p, size = pdf["p"].to_numpy(float).copy(), pdf["size"].to_numpy(float)
        source, level, group = (int(x) for x in key)
        draws = (_uniform(seed, source * 1009 + level, group * 1_000_003 + n) for n in range(len(p) + 1))
        pivot(size, p, draws)
        pdf["p"] = p
        return pdf[["source_no", "doc_id", "row_key", "size", "p"]]

    return run


def rounded(fractions: DataFrame, seed: int = 1, fan_in: int = 2048, levels: int = 8) -> DataFrame:
    """``fractions`` (source_no int, doc_id, row_key, size > 0, p in (0, 1)) with every p rounded to 0 or 1.

    Level 0 deals documents by the hash of their key into groups of about ``fan_in``; each later level
    deals what the groups left, until a source is one group. The group number depends on data alone,
    so that reruns agree. The last fraction of a source is drawn by itself.
    """
    schema = "source_no int, doc_id long, row_key long, size long, p double"
    done, open_ = None, fractions
    for level in range(levels):
        counts = open_.groupBy("source_no").agg(F.ceil(F.count("*") / F.lit(fan_in)).cast("long").alias("groups"))
        most = counts.agg(F.max("groups")).first()[0]
        if most is None:
            break
        dealt = open_.join(counts, "source_no").withColumn("grp", F.pmod(F.xxhash64("row_key", "doc_id", F.lit(level)), F.col("groups")))
        out = stored(dealt.withColumn("lvl", F.lit(level)).groupBy("source_no", "lvl", "grp").applyInPandas(_round_group(seed), schema))
        whole = out.filter("p = 0 or p = 1")
        done, open_ = whole if done is None else done.unionByName(whole), out.filter("p > 0 and p < 1")
        if most <= 1:
            break
    if done is None:
        return fractions
    last = F.pmod(F.xxhash64("row_key", "doc_id", F.lit(seed + 17)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return done.unionByName(open_.withColumn("p", (last < F.col("p")).cast("double")))


def mix(docs: DataFrame, seed: int = 1) -> DataFrame:
    """(row_key, doc_id, source, size, source_size, target, copies, taken) of every row of ``docs``.

    ``row_key`` tells rows of one doc_id apart (a hash of id, text and source); rows equal in these are alike and
    may share copies between them in any way. Documents without words take nothing. Null sources are
    a source of their own, the last. An empty table gives an empty result.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"), row_key().alias("row_key"))
    plain = stored(plain)
    sources = targets(plain.groupBy("source").agg(F.sum("size").alias("source_size")))
    sources = stored(sources.withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")).cast("int")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rated = plain.join(sources, plain["source"].eqNullSafe(sources["source"])).drop(sources["source"]).withColumn("base", F.floor(rate + 1e-12)).withColumn("p", F.greatest(rate - F.col("base"), F.lit(0.0)))
    open_ = rated.filter((F.col("size") > 0) & (F.col("p") > _EPS)).select("source_no", "doc_id", "row_key", "size", "p")
    extra = rounded(open_, seed).groupBy("row_key").agg(F.sum("p").cast("long").alias("extras"))
    # Equal keys (repeated rows) are paired off by number.
    rated = rated.withColumn("nth", F.row_number().over(Window.partitionBy("row_key").orderBy("doc_id")))
    copies = F.col("base") + F.when(F.col("nth") <= F.coalesce("extras", F.lit(0)), 1).otherwise(0)
    out = rated.join(extra, "row_key", "left").select("row_key", "doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies"))
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def report(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def repeated(docs: DataFrame, seed: int = 1) -> DataFrame:
    """``docs`` as the mix takes them: a row for each copy, rows of no copy gone, own columns only."""
    counts = mix(docs, seed).groupBy("row_key").agg(F.sum("copies").alias("_mq_copies"), F.count("*").alias("_mq_rows"))
    keyed = docs.withColumn("_mq_key", row_key())
    both = keyed.join(counts, keyed["_mq_key"] == counts["row_key"]).withColumn("_mq_nth", F.row_number().over(Window.partitionBy("_mq_key").orderBy(F.lit(1))))
    share = F.floor(F.col("_mq_copies") / F.col("_mq_rows")) + F.when(F.col("_mq_nth") <= F.col("_mq_copies") % F.col("_mq_rows"), 1).otherwise(0)
    copies = both.withColumn("_mq_copy", F.explode(F.array_repeat(F.lit(1), share.cast("int"))))
    return copies.select(*[F.col(f"`{c}`") for c in docs.columns])
