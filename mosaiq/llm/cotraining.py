"""Quality by co-training: two views of a document teach each other.

The text view sees shares and hashed words of the whole text; the metadata view sees source, language
and stated length. Each is a logistic model. Over rounds, each view labels the unlabelled rows that it
is surest of, and the other learns from them too. Labelled rows are a bounded sample; of the unlabelled ones all
take part, through histograms of scores and sums of Newton steps over the whole table. At the end both are calibrated on labelled rows that
neither learned from, their calibrated log odds are combined, and every document is scored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.common import Lexicon, bytes_of, sample_by_hash, stored

HASHED, SOURCES, LANGS = 128, 64, 16
_UPPER = bytes(range(65, 91))
_SHARES = 11


def text_view(text, lex: Lexicon) -> np.ndarray:
    """Shares of the whole text and a hashed bag of its words, its length one."""
    data = bytes_of(text)
    size = max(1, len(data))
    tokens = data.split()
    n = max(1, len(tokens))
    lines = [x for x in data.split(b"\n") if x.strip()]

    def share(chars: bytes) -> float:
        return (len(data) - len(data.translate(None, chars))) / size

    out = np.zeros(_SHARES + HASHED, np.float32)
    distinct = len(set(tokens))
    again = sum(a == b for a, b in zip(tokens, tokens[1:])) / n
    out[:_SHARES] = (
        share(b"#*$%&"), share(b"|<>"), share(b"!"), share(_UPPER), share(b"0123456789"), min(1.0, len(data) / n / 20), distinct / n,
        again, len(set(lines)) / max(1, len(lines)), np.log1p(len(tokens)) / 10, np.log1p(n / max(1, len(lines))) / 10,
    )
    if tokens:
        bag = np.bincount((lex(tokens) % np.uint64(HASHED)).astype(np.int64), minlength=HASHED).astype(np.float32)
        out[_SHARES:] = bag / np.sqrt((bag * bag).sum())
    return out


def meta_view(source, lang, n_chars) -> np.ndarray:
    out = np.zeros(SOURCES + LANGS + 3, np.float32)
    out[zlib.crc32(str(source).encode("utf-8", "replace")) % SOURCES] = 1
    out[SOURCES + zlib.crc32(str(lang).encode("utf-8", "replace")) % LANGS] = 1
    known = n_chars is not None and n_chars == n_chars
    size = np.log1p(max(0.0, float(n_chars))) / 10 if known else 0.0
    out[-3:] = (size, size * size, 0.0 if known else 1.0)
    return out


class Logistic:
    """Standardised features, ridge penalty, Newton steps; rows may carry weights."""

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0, steps: int = 12) -> Logistic:
        x = x.astype(float)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        a = np.c_[np.ones(len(x)), (x - self.mean) / self.scale]
        weight = np.ones(len(y)) if weight is None else weight
        b, penalty = np.zeros(a.shape[1]), np.full(a.shape[1], ridge)
        penalty[0] = 1e-6
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
            h = (a * (weight * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ a + np.diag(penalty)
            step = np.linalg.solve(h, a.T @ (weight * (y - p)) - penalty * b)
            b += step
            if np.abs(step).max() < 1e-6:
                break
        self.b = b
        return self

    def copy(self) -> Logistic:
        out = Logistic()
        out.mean, out.scale, out.b = self.mean, self.scale, self.b
        return out

    def sums(self, x: np.ndarray, y: np.ndarray, weight: float) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and Hessian of the rows at the present weights, without the penalty."""
        a = np.c_[np.ones(len(x)), (x - self.mean) / self.scale]
        p = 1 / (1 + np.exp(-np.clip(a @ self.b, -30, 30)))
        return weight * (a.T @ (y - p)), weight * ((a * np.maximum(p * (1 - p), 1e-4)[:, None]).T @ a)

    def step(self, gradient: np.ndarray, hessian: np.ndarray, ridge: float = 1.0) -> float:
        penalty = np.full(len(self.b), ridge)
        penalty[0] = 1e-6
        step = np.linalg.solve(hessian + np.diag(penalty), gradient - penalty * self.b)
        self.b = self.b + step
        return float(np.abs(step).max())

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.b[0] + ((x - self.mean) / self.scale) @ self.b[1:], -30, 30)


def _sigmoid(z):
    return 1 / (1 + np.exp(-z))


_BINS = 6000


def _bins(z: np.ndarray) -> np.ndarray:
    return np.minimum(((z + 30) * (_BINS / 60)).astype(np.int64), _BINS - 1)


def _log_odds(model, x: np.ndarray) -> np.ndarray:
    view, calibration = model
    return calibration.logit(view.logit(x)[:, None])


def _histogram(views: list[np.ndarray], models: list) -> np.ndarray:
    """Rows by bin of each view's calibrated log odds, and their number."""
    return np.concatenate([np.bincount(_bins(_log_odds(m, x)), minlength=_BINS) for m, x in zip(models, views)] + [[len(views[0])]]).astype(float)


def _given(views: list[np.ndarray], rules: list) -> list[np.ndarray]:
    """Labels that each view has been given by the other, the earliest first; -1: none. A rule is a round's (model, low bin, high bin) by view."""
    label = [np.full(len(views[0]), -1) for _ in views]
    for turn in rules:
        for v, (model, low, high) in enumerate(turn):
            at, to = _bins(_log_odds(model, views[v])), label[1 - v]
            to[(to < 0) & (at >= high)] = 1
            to[(to < 0) & (at <= low)] = 0
    return label


def _steps(views: list[np.ndarray], rules: list, models: list) -> np.ndarray:
    """Number, gradient and Hessian of the rows that each view has been given, in one vector."""
    out = []
    for x, label, model in zip(views, _given(views, rules), models):
        rows = np.flatnonzero(label >= 0)
        gradient, hessian = model.sums(x[rows].astype(float), label[rows], 0.5)
        out += [[len(rows)], gradient, hessian.ravel()]
    return np.concatenate(out)


class CoTrained:
    """Two views, their calibrations and the combination of their log odds."""

    def fit(self, text: np.ndarray, meta: np.ndarray, y: np.ndarray, **how) -> CoTrained:
        """``y`` is 1, 0, or -1 where unlabelled."""
        free = [text[y < 0], meta[y < 0]]
        return self.teach(text[y >= 0], meta[y >= 0], y[y >= 0], lambda summed, *args: summed(free, *args), **how)

    def teach(self, text: np.ndarray, meta: np.ndarray, y: np.ndarray, over_free, rounds: int = 4, sure: float = 0.95, share: float = 0.1, steps: int = 4) -> CoTrained:
        """Labelled rows, and ``over_free``: the sum of a function of (views, ...) over all unlabelled rows.

        Every fifth labelled row calibrates and teaches nothing. A round takes, by view and label, the surest ``share``
        of the unlabelled rows (to a hundredth of log odds) as far as they are ``sure``.
        """
        held = np.arange(len(y))[::5]
        own = np.setdiff1d(np.arange(len(y)), held)
        views, odds = [text, meta], np.log(sure / (1 - sure))
        self.views, self.taught, rules = [Logistic().fit(x[own], y[own].astype(float)) for x in views], 0, []

        def calibrated(v):
            return Logistic().fit(self.views[v].logit(views[v][held])[:, None], y[held].astype(float), ridge=1e-2)

        for _ in range(rounds):
            models = [(m.copy(), calibrated(v)) for v, m in enumerate(self.views)]
            found = over_free(_histogram, models)
            if not found[-1]:
                break
            most, turn = max(1, int(share * found[-1])), []
            for v, model in enumerate(models):
                n = found[v * _BINS : (v + 1) * _BINS]

                def reach(counts):
                    """How many bins of ``counts`` to take: the first that holds rows, and more while there are few enough."""
                    return max(int(np.searchsorted(np.cumsum(counts), most, side="right")), int(np.argmax(counts > 0)) + 1)

                edge = int(np.ceil((odds + 30) * (_BINS / 60)))
                turn.append((model, min(reach(n) - 1, _BINS - 1 - edge), max(_BINS - reach(n[::-1]), edge)))
            rules.append(turn)
            before = self.taught
            for _ in range(steps):
                sums, at, moved = over_free(_steps, rules, self.views), 0, 0.0
                taught = 0
                for m, x in zip(self.views, views):
                    d = len(m.b)
                    taught += int(sums[at])
                    gradient, hessian = m.sums(x[own].astype(float), y[own], 1.0)
                    moved = max(moved, m.step(gradient + sums[at + 1 : at + 1 + d], hessian + sums[at + 1 + d : at + 1 + d + d * d].reshape(d, d)))
                    at += 1 + d + d * d
                self.taught = taught
                if taught == before or moved < 1e-6:
                    break
            if self.taught == before:
                break
        self.calibrations = [calibrated(v) for v in range(2)]
        z = self._both(text[held], meta[held])
        self.joint = Logistic().fit(z, y[held].astype(float), ridge=1e-1)
        return self

    @staticmethod
    def _calibrated(calibration: Logistic, z: np.ndarray) -> np.ndarray:
        return calibration.logit(z[:, None])

    def _both(self, text, meta) -> np.ndarray:
        return np.stack([self._calibrated(c, m.logit(x)) for c, m, x in zip(self.calibrations, self.views, (text, meta))], axis=1)

    def scores(self, text, meta) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z = self._both(text, meta)
        return _sigmoid(z[:, 0]), _sigmoid(z[:, 1]), _sigmoid(self.joint.logit(z))


def _views(pdf: pd.DataFrame, lex: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    text = np.stack([text_view(t, lex) for t in pdf["text"]])
    meta = np.stack([meta_view(*r) for r in zip(pdf["source"], pdf["lang"], pdf["n_chars"])])
    return text, meta


def _featured(batches):
    lex = Lexicon()
    for pdf in batches:
        if len(pdf):
            text, meta = _views(pdf, lex)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "text": list(text), "meta": list(meta)})


def _arrays(batch) -> list[np.ndarray]:
    return [batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for c in ("text", "meta")]


def _over(free: DataFrame):
    """Sums of a function's vectors over the rows of ``free``; the driver gets one vector of fixed length."""

    def total(summed, *args) -> np.ndarray:
        def run(batches):
            out = None
            for batch in batches:
                if batch.num_rows:
                    v = summed(_arrays(batch), *args)
                    out = v if out is None else out + v
            if out is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out), dtype=np.int32)), pa.array(out)], names=["i", "v"])

        rows = free.select("text", "meta").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas().sort_values("i")
        return rows["v"].to_numpy() if len(rows) else np.zeros(2 * _BINS + 1)

    return total


def train(rows: DataFrame, bound: int = 8_000) -> CoTrained | None:
    """Fitted on at most ``bound`` labelled rows, those of the smallest hashes, and on all unlabelled ones; None without both labels.

    ``rows``: doc_id, both views and y (1, 0, -1 where unlabelled, null where there is no id). The sample is collected.
    """
    ids = sample_by_hash(rows.filter("y >= 0").select("doc_id").distinct(), "doc_id", bound, salt=5)
    known = rows.filter("y >= 0").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct("text", "meta")).alias("v")).select("doc_id", "y", "v.*").toPandas()
    y = known["y"].to_numpy(int) if len(known) else np.empty(0, int)
    if (y == 1).sum() < 10 or (y == 0).sum() < 10:
        return None
    known = known.assign(o=[zlib.crc32(str(i).encode()) for i in known["doc_id"]]).sort_values(["o", "doc_id"])
    return CoTrained().teach(np.stack(known["text"]), np.stack(known["meta"]), known["y"].to_numpy(int), _over(rows.filter("y < 0")))


def _scored(model: CoTrained | None):
    def run(batches):
        for batch in batches:
            t = m = s = np.ones(batch.num_rows)
            if model is not None and batch.num_rows:
                t, m, s = model.scores(*_arrays(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(t), pa.array(m), pa.array(s)], names=["doc_id", "text_score", "meta_score", "score"])

    return run


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", **how) -> DataFrame:
    """(doc_id, text_score, meta_score, score, kept) of every row of ``docs``; kept: score of at least a half.

    Null and empty texts and null metadata are values like others. Without labels of both kinds (ten of
    each) all are kept with score 1. Repeated rows are scored alike; of labels that disagree about an id, bad counts. An
    empty table gives an empty result.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("double").alias("n_chars"))
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col(label) > 0, 1).otherwise(0).alias("y")).groupBy("doc_id").agg(F.min("y").alias("y"))
    views = slim.mapInPandas(_featured, "doc_id long, text array<float>, meta array<float>").join(known, "doc_id", "left")
    rows = stored(views.select("doc_id", "text", "meta", F.when(F.col("doc_id").isNotNull(), F.coalesce("y", F.lit(-1))).alias("y")))
    out = rows.select("doc_id", "text", "meta").mapInArrow(_scored(train(rows, **how)), "doc_id long, text_score double, meta_score double, score double")
    return out.withColumn("kept", F.col("score") >= 0.5)
