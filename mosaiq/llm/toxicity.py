"""Toxicity by a factorization machine over hashed terms.

Terms are a document's distinct words and their beginnings, hashed. A weight for each term adds up as in
a linear model; a short vector for each term makes pairs count through inner products, so an insult
that is harmless alone and harmful beside a mention of a group can be told. The machine is fitted on a
bounded sample of labelled rows; every document is scored on its whole text.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.common import bucket_of, sample_by_hash, stored

SPACE = 1 << 18
_EDGES = ".,;:!?\"'()[]{}<>|*#$%&-_"
_PREFIXES = (3, 4, 5, 6, 7)


class Terms:
    """Hashed terms of texts; the terms of words seen lately are at hand (bounded)."""

    def __init__(self, slots: np.ndarray | None = None, limit: int = 400_000):
        import xxhash

        self._hash, self._slots, self._limit, self._seen = xxhash.xxh3_64_intdigest, slots, limit, {}

    def _of(self, word: str) -> tuple[int, ...]:
        w = word.strip(_EDGES)
        if not w:
            return ()
        names = [w + "$", *(w[:n] for n in _PREFIXES if len(w) >= n)]
        ids = [self._hash(n.encode("utf-8", "replace")) & (SPACE - 1) for n in names]
        if self._slots is not None:
            ids = [int(s) for s in self._slots[ids] if s >= 0]
        return tuple(set(ids))

    def __call__(self, text) -> list[int]:
        out: set[int] = set()
        seen = self._seen
        if len(seen) > self._limit:
            seen.clear()
        for w in set(text.lower().split()) if isinstance(text, str) else ():
            ids = seen.get(w)
            if ids is None:
                ids = seen[w] = self._of(w)
            out.update(ids)
        return sorted(out)


class Machine:
    """bias + sum w + (|sum v|^2 - sum |v|^2) / 2 over a document's terms, through a logistic function."""

    def __init__(self, terms: int, factors: int = 6, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.bias, self.w, self.v = 0.0, np.zeros(terms), rng.normal(0, 0.01, (terms, factors))

    def raw(self, flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Scores of documents whose terms lie in ``flat`` up to ``ends``."""
        out = np.full(len(ends), self.bias)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        full = ends > starts
        if full.any():
            s = starts[full]
            v = self.v[flat]
            total = np.add.reduceat(v, s, axis=0)
            out[full] += np.add.reduceat(self.w[flat], s) + 0.5 * ((total**2).sum(axis=1) - np.add.reduceat((v**2).sum(axis=1), s))
        return out

    def score(self, flat, ends) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(flat, ends), -30, 30)))

    def fit(self, docs: list[np.ndarray], y: np.ndarray, epochs: int = 12, batch: int = 256, rate: float = 0.08, decay: float = 1e-4, seed: int = 3) -> Machine:
        """AdaGrad on the logistic loss with decaying weights; both labels weigh by their number's root."""
        n, pos = len(y), max(1.0, y.sum())
        heavy = np.sqrt(max(1.0, (n - pos) / pos))
        self.bias = float(np.log((pos + 0.5) / (n - pos + 0.5)))
        gw, gv, gb = np.full(len(self.w), 1e-3), np.full(self.v.shape, 1e-3), 1e-3
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            order = rng.permutation(n)
            for lo in range(0, n, batch):
                pick = order[lo : lo + batch]
                part = [docs[i] for i in pick]
                ends = np.cumsum([len(p) for p in part])
                flat = np.concatenate(part).astype(np.int64) if len(part) else np.empty(0, np.int64)
                miss = (self.score(flat, ends) - y[pick]) * np.where(y[pick] > 0, heavy, 1.0) / len(pick)
                gb += miss.sum() ** 2
                self.bias -= rate * miss.sum() / np.sqrt(gb)
                if not len(flat):
                    continue
                doc = np.repeat(np.arange(len(part)), [len(p) for p in part])
                v = self.v[flat]
                total = np.zeros((len(part), v.shape[1]))
                np.add.at(total, doc, v)
                used, where = np.unique(flat, return_inverse=True)
                dw = np.bincount(where, miss[doc], len(used)) + decay * self.w[used]
                each = miss[doc, None] * (total[doc] - v)
                dv = np.stack([np.bincount(where, each[:, f], len(used)) for f in range(v.shape[1])], axis=1) + decay * self.v[used]
                gw[used] += dw**2
                gv[used] += dv**2
                self.w[used] -= rate * dw / np.sqrt(gw[used])
                self.v[used] -= 0.5 * rate * dv / np.sqrt(gv[used])
        return self


def _term_counts(batches):
    terms, n = Terms(), np.zeros((2, SPACE), np.int64)
    for pdf in batches:
        for text, y in zip(pdf["text"], pdf["y"]):
            n[int(y), terms(text)] += 1
    some = np.flatnonzero(n.sum(axis=0))
    yield pd.DataFrame({"term": some, "good": n[0, some], "bad": n[1, some]})


def _term_lists(slots: np.ndarray):
    def run(batches):
        terms = Terms(slots)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "y": pdf["y"], "terms": [np.array(terms(t), np.int32) for t in pdf["text"]]})

    return run


def chosen_terms(counts: pd.DataFrame, n_bad: int, n_good: int, most: int, least_df: int) -> np.ndarray:
    """Terms of a document frequency of at least ``least_df``, the ``most`` whose share differs most between labels."""
    a, b = counts["bad"].to_numpy(float), counts["good"].to_numpy(float)
    share = (a + b) / (n_bad + n_good)
    z = (a / n_bad - b / n_good) / np.sqrt(share * (1 - share) * (1 / n_bad + 1 / n_good) + 1e-12)
    order = np.lexsort((counts["term"], -np.abs(np.where(a + b >= least_df, z, 0))))[:most]
    order = order[(a + b)[order] >= least_df]  # a term that tells nothing alone may do so beside another
    return counts["term"].to_numpy()[order]


def train(docs: DataFrame, labels: DataFrame, bound: int = 20_000, terms: int = 6000, least_df: int = 4, label: str = "toxic"):
    """(slots of hashed terms, machine), from at most ``bound`` labelled rows outside the held-out fold.

    Of labels that disagree about an id, toxic counts; of texts that share one, the least. The sample's ids are broadcast and its term lists collected: both are limited by ``bound``. The counts
    that choose terms are limited by the hash space. Without labels of both kinds: (None, None).
    """
    y = F.col(label).cast("int")
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (bucket_of(F.col("doc_id"), 5) != 0)).select(F.col("doc_id").cast("long").alias("doc_id"), F.when(y > 0, 1).otherwise(0).alias("y")).groupBy("doc_id").agg(F.max("y").alias("y"))
    known = sample_by_hash(known, "doc_id", bound, salt=9)
    seen = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")))
    sizes = {r["y"]: r["n"] for r in seen.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None, None
    counts = seen.select("text", "y").mapInPandas(_term_counts, "term int, good long, bad long").groupBy("term").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).toPandas().sort_values("term")
    pick = chosen_terms(counts, sizes[1], sizes[0], terms, least_df)
    slots = np.full(SPACE, -1, np.int32)
    slots[pick] = np.arange(len(pick))
    rows = sorted(seen.mapInPandas(_term_lists(slots), "doc_id long, y int, terms array<int>").collect(), key=lambda r: r["doc_id"])
    machine = Machine(max(1, len(pick))).fit([np.array(r["terms"], np.int64) for r in rows], np.array([r["y"] for r in rows], float))
    return slots, machine


def _scores(slots, machine):
    def run(batches):
        terms = Terms(slots) if machine is not None else None
        for pdf in batches:
            if machine is None:
                score = np.zeros(len(pdf))
            else:
                lists = [terms(t) for t in pdf["text"]]
                ends = np.cumsum([len(x) for x in lists])
                score = machine.score(np.array([i for x in lists for i in x], np.int64), ends)
            out = pdf[["doc_id", "held_out"]].copy()
            out["doc_id"] = out["doc_id"].astype("Int64")
            out["score"] = score
            yield out

    return run


def score(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``.

    Held out are the ids whose CRC-32 modulo 5 is 0: their labels are never read. Null and empty texts
    get the machine's bias. Without labels of both kinds every score is 0. Repeated rows are scored alike; an empty
    table gives an empty result.
    """
    slots, machine = train(docs, labels, **how)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (bucket_of(F.col("doc_id"), 5) == 0).alias("held_out"))
    out = slim.mapInPandas(_scores(slots, machine), "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int"))
