"""Near-duplicate documents: circulant MinHash, banding, exact Jaccard, components.

One permutation (sigma, a hash of shingles to bins) breaks up structure; the other (pi, a table) is
shifted circularly to give every signature coordinate: coordinate k of a set is the minimum of
pi[(bin + k) mod bins]. Equal sets are first folded to one representative, so exact copies, however
many, meet only in a partial aggregate. Candidates within a band's bucket are tried with its smallest
and then its largest member; what stays apart is then compared across components, as far as the sketches
of signatures leave the similarity possible. So no true link between components inside a bucket is lost,
and a group of copies never gives all its pairs.
"""

from __future__ import annotations

from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.common import Lexicon, connected_components, mix64, stored, words

BINS = 1 << 20
_ROWS = 4096


@lru_cache(1)
def _shifts(k: int) -> np.ndarray:
    pi = np.random.Generator(np.random.PCG64(20240501)).permutation(BINS).astype(np.int32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[:k]]), k)


def shingle_set(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the windows of ``width`` words; a shorter text is one shingle."""
    n = len(hashes)
    if n == 0:
        return np.empty(0, np.uint64)
    span = min(n, width)
    with np.errstate(over="ignore"):
        h = np.full(n - span + 1, np.uint64(span), np.uint64)
        for i in range(span):
            h = mix64(h ^ hashes[i : n - span + 1 + i])
    h.sort()
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def signature(shingles: np.ndarray, k: int = 128) -> np.ndarray:
    """The k circulant minima of a non-empty set; long sets go through in bounded slices."""
    bins, view = (mix64(shingles) >> np.uint64(44)).astype(np.int64), _shifts(k)
    out = view[bins[:_ROWS]].min(axis=0)
    for i in range(_ROWS, len(bins), _ROWS):
        np.minimum(out, view[bins[i : i + _ROWS]].min(axis=0), out=out)
    return out


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    rows = sig.reshape(bands, -1).astype(np.uint64)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for j in range(rows.shape[1]):
        key = mix64(key ^ rows[:, j])
    return key.view(np.int64)


def two_bits(sig: np.ndarray) -> np.ndarray:
    """Two bits of every coordinate, as longs: equal coordinates agree in both, others in each by chance."""
    low = np.concatenate([sig & 1, (sig >> 1) & 1]).astype(np.uint8)
    return np.packbits(np.append(low, np.zeros(-len(low) % 64, np.uint8))).view(np.int64)


def bits_apart(k: int, percent: int) -> int:
    """The most bits in which the sketches of a pair at the similarity may differ: mean and 5.5 deviations."""
    j = percent / 100
    return int(np.ceil(k * (1 - j) + 5.5 * np.sqrt(k * (1 - j) / 2 + k * j * (1 - j))))


def _sketches(width: int, k: int, bands: int):
    def run(batches):
        lex = Lexicon()
        for pdf in batches:
            out = []
            for key, text in zip(pdf["doc_id"], pdf["text"]):
                s = shingle_set(lex(words(text)), width)
                if len(s):
                    sig = signature(s, k)
                    out.append((key, len(s), blake2b(s.tobytes(), digest_size=16).digest(), band_keys(sig, bands), two_bits(sig)))
                else:
                    out.append((key, 0, None, None, None))
            out = pd.DataFrame(out, columns=["doc_id", "n_shingles", "set_key", "bands", "bits"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return run


def _shingles(width: int):
    def run(batches):
        lex = Lexicon()
        for pdf in batches:
            yield pd.DataFrame({"node": pdf["doc_id"], "comp": pdf["comp"], "shingles": [shingle_set(lex(words(t)), width).view(np.int64) for t in pdf["text"]]})

    return run


def _confirm(width: int, percent: int):
    """(a, b) of the pairs whose full sets reach the similarity; the text of a leader is shingled once a batch."""

    def run(batches):
        lex = Lexicon()
        for pdf in batches:
            sets: dict[int, np.ndarray] = {}
            keep = np.zeros(len(pdf), bool)
            for i, (a, b, ta, tb) in enumerate(zip(pdf["a"], pdf["b"], pdf["ta"], pdf["tb"])):
                for key, text in ((a, ta), (b, tb)):
                    if key not in sets:
                        sets[key] = shingle_set(lex(words(text)), width)
                x, y = sets[a], sets[b]
                if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield pdf.loc[keep, ["a", "b"]]

    return run


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, k: int = 128, bands: int = 32) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text).

    Two documents are linked if their sets of distinct ``width``-word shingles have a Jaccard
    similarity of at least ``percent`` hundredths, confirmed on full sets; a component is what links
    connect, and its smallest doc_id is kept. With 32 bands of 4 coordinates a pair at 0.8 is missed
    with a chance below 1e-7. Texts without words (or null) have an empty set and are linked with
    nothing. Repeated rows of one doc_id share its fate; rows without a doc_id take no part in links,
    have a null component and are kept. An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = stored(docs.mapInPandas(_sketches(width, k, bands), "doc_id long, n_shingles long, set_key binary, bands array<long>, bits array<long>"))
    sets = sketches.filter("set_key is not null and doc_id is not null")
    reps = stored(sets.groupBy("set_key").agg(F.min("doc_id").alias("rep")))
    nodes = reps.select(F.col("rep").alias("doc_id")).join(sets, "doc_id").select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), "bits", "bands")
    buckets = nodes.select("node", F.explode("bands").alias("bucket")).distinct()
    crowded = buckets.groupBy("bucket").agg(F.count("*").alias("size"), F.min("node").alias("lead"), F.max("node").alias("last")).filter("size > 1")
    members = stored(buckets.join(crowded, "bucket").join(nodes.drop("bands").dropDuplicates(["node"]), "node"))

    # The texts of all members are dealt out once; a merge join at every size, the ids being unbounded.
    texts = stored(docs.join(members.select(F.col("node").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"]))

    def confirmed(pairs: DataFrame) -> DataFrame:
        both = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
        return stored(both.select("a", "b", "ta", "tb").mapInPandas(_confirm(width, percent), "a long, b long"))

    words_in_bits = -(-2 * k // 64)
    apart = " + ".join(f"bit_count(xa[{i}] ^ xb[{i}])" for i in range(words_in_bits))
    near = F.expr(f"100 * least(na, nb) >= {percent} * greatest(na, nb) and {apart} <= {bits_apart(k, percent)}")

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def stars(own: DataFrame, hub: str) -> DataFrame:
        """Pairs of each bucket's hub with its members of other components."""
        hubs = own.filter(F.col("node") == F.col(hub)).select("bucket", F.col("node").alias("a"), F.col("n").alias("na"), F.col("bits").alias("xa"), F.col("comp").alias("ca"))
        rest = own.filter(F.col("node") != F.col(hub)).select("bucket", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("xb"), F.col("comp").alias("cb"))
        return ordered(rest.join(hubs, "bucket").filter(near & (F.col("ca") != F.col("cb"))))

    def placed_in(comps: DataFrame, own: DataFrame) -> DataFrame:
        """Members of the buckets of three or more that hold several components yet."""
        own = own.filter("size > 2").drop("comp").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        split = own.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("bucket")
        return stored(own.join(split, "bucket"))

    first = stored(stars(members.withColumn("comp", F.col("node")), "lead"))
    links = confirmed(first)
    comps = connected_components(links)
    left = placed_in(comps, members)
    second = stored(stars(left, "last").join(first, ["a", "b"], "left_anti"))
    links = links.union(confirmed(second))
    comps = connected_components(links)
    # What is still apart: every pair across components that sketches and shared shingles leave possible.
    # A shingle that only one component holds can't be shared across, which bounds a pair's similarity.
    left = placed_in(comps, left)
    own = left.select(F.col("node").alias("doc_id"), "comp").distinct()
    held = stored(texts.join(own, "doc_id").mapInPandas(_shingles(width), "node long, comp long, shingles array<long>"))
    each = held.select("node", "comp", F.explode("shingles").alias("shingle"))
    private = each.groupBy("shingle").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo = hi").select("shingle")
    alone = each.join(private, "shingle").groupBy("node").agg(F.count("*").alias("own"))
    # what a document can share at most with others must reach the similarity for itself
    sets = held.join(alone, "node", "left").select("node", "shingles", (F.size("shingles") - F.coalesce("own", F.lit(0))).alias("m")).filter(100 * F.col("m") >= percent * F.size("shingles"))
    left = left.join(sets, "node")
    x = left.select("bucket", F.col("node").alias("a"), F.col("n").alias("na"), F.col("bits").alias("xa"), F.col("comp").alias("ca"), F.col("m").alias("ma"), F.col("shingles").alias("sa"))
    y = left.select("bucket", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("xb"), F.col("comp").alias("cb"), F.col("m").alias("mb"), F.col("shingles").alias("sb"))
    can = F.expr(f"100 * least(ma, mb) >= {percent} * (na + nb - least(ma, mb))")
    linked = F.expr(f"{100 + percent} * size(array_intersect(sa, sb)) >= {percent} * (na + nb)")
    # The sets are compared within the join, so that only links leave it.
    more = stored(ordered(x.join(y, (x["bucket"] == y["bucket"]) & (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & can & near & linked)))
    if more.limit(1).count():
        comps = connected_components(links.union(more))

    placed = sketches.join(reps.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("set_key", F.coalesce("comp", "rep").alias("comp")), "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id"))
    out = placed.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.col("component_id").isNull() | (F.col("doc_id") == F.col("component_id")))


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that are their component's first, with their own columns only."""
    ids = near_duplicates(docs, **how).filter(~F.col("kept")).select(F.col("doc_id").alias("_mq_gone")).distinct()
    return docs.join(ids, docs["doc_id"] == ids["_mq_gone"], "left_anti")
