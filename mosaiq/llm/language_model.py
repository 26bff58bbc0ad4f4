"""Language-model scores: a hashed maximum-entropy model with a class-factored softmax.

A word's probability is that of its class in its context, times that of the word in its class. Each of the most frequent
words is a class of its own, the others fall into classes of words that begin alike. The class comes from a
maximum-entropy model over hashed features: the word before, the word before that (a skip), and the n-gram of the three classes before. Every training text updates the
weights once: tasks run gradient steps over their own texts, and the weights that they moved are averaged
by feature row between rounds. Words in a class are counted over all training texts. Scoring looks up
frequent words (a bounded number) in the workers and all others by a join.
"""

from __future__ import annotations

import zlib
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.common import bucket_of, chunks_of, most_frequent, stored, word_rows

CLASSES, ROWS = 32, 1 << 14
END = b"\n"  # no word holds white space
_STEP = 8192
#: Bytes of text taken apart at once (a longer text is by itself).
_CHUNK = 1 << 21


#: Classes of a single word each.
OWN = 16


def class_of(word: bytes, own: dict[bytes, int]) -> int:
    found = own.get(word)
    return OWN + zlib.crc32(word[:3]) % (CLASSES - OWN) if found is None else found


def classes_of(distinct, own: dict[bytes, int]) -> np.ndarray:
    """``class_of`` of an Arrow array of words; the first bytes are hashed once each."""
    import pyarrow as pa
    import pyarrow.compute as pc

    words = distinct.cast(pa.binary())
    heads = pc.binary_slice(words, 0, 3).dictionary_encode()
    crc = np.fromiter(map(zlib.crc32, heads.dictionary.to_pylist()), np.int64, len(heads.dictionary))
    out = (OWN + crc % (CLASSES - OWN))[heads.indices.to_numpy()]
    at = pc.index_in(words, pa.array(list(own), pa.binary())).fill_null(-1).to_numpy()
    single = np.flatnonzero(at >= 0)
    out[single] = np.array(list(own.values()), np.int64)[at[single]]
    return out


def hashes_of(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def coded(texts):
    """(distinct words and the end as an Arrow array, number of each token in it, number of tokens by text)."""
    import pyarrow as pa

    found, sizes = word_rows(texts)
    words = found.dictionary_encode()
    sizes = sizes + 1
    ends = np.cumsum(sizes) - 1
    codes = np.full(int(sizes.sum()), len(words.dictionary))
    inner = np.ones(len(codes), bool)
    inner[ends] = False
    codes[inner] = words.indices.to_numpy()
    return pa.concat_arrays([words.dictionary, pa.array([END.decode()], words.dictionary.type)]), codes, sizes


def context_rows(h: np.ndarray, k: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Feature rows (n, 3) of tokens by their hashes and classes; ``sizes``: tokens by text."""
    n = len(h)
    first = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    one, two = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    one[1:], two[2:] = h[:-1], h[:-2]
    one[first < 1], two[first < 2] = np.uint64(1), np.uint64(2)
    gram = np.zeros(n, np.int64)
    for back in (1, 2, 3):
        before = np.full(n, CLASSES, np.int64)
        before[back:] = k[: max(0, n - back)]
        before[first < back] = CLASSES
        gram = gram * (CLASSES + 1) + before
    shift = np.uint64(64 - ROWS.bit_length() + 1)
    with np.errstate(over="ignore"):  # multiply and shift: the words' own hashes are well mixed
        rows = np.stack([(one * np.uint64(0x9E3779B97F4A7C15)) >> shift, (two * np.uint64(0xC2B2AE3D27D4EB4F)) >> shift, (gram.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> shift], axis=1)
    return rows.astype(np.uint16)


def _taken(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows of ``x``; every index lies in range, so that nothing is clipped: the mode only spares the check."""
    return np.take(x, at, axis=0, mode="clip")


def _logits(w: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    one, two, three = np.ascontiguousarray(rows.T).astype(np.intp)
    z = _taken(w, one)
    z += _taken(w, two)
    z += _taken(w, three)
    z += bias
    return z


def run_sums(x: np.ndarray, at: np.ndarray, starts: np.ndarray, counts: np.ndarray, long: int = 16) -> np.ndarray:
    """Sums of the rows x[at] by runs of ``at``: of short runs the first, the second, ... rows of all at once, long ones each by itself."""
    out = _taken(x, at[starts])
    for i in np.flatnonzero(counts > long).tolist():
        _taken(x, at[starts[i] : starts[i] + counts[i]]).sum(axis=0, out=out[i])
    left, nth = np.flatnonzero((counts > 1) & (counts <= long)), 1
    while len(left):
        out[left] += _taken(x, at[starts[left] + nth])
        nth += 1
        left = left[counts[left] > nth]
    return out


def _exp(w: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials by class, and their sums; shifted by each row's largest logit only where some would leave the range of floats."""
    z = _logits(w, bias, rows)
    if z.max(initial=0) < 60:
        total = np.exp(z, out=z).sum(axis=1)
        if total.min(initial=1) > 1e-25:
            return z, total
        z = _logits(w, bias, rows)
    z -= z.max(axis=1, keepdims=True)
    return np.exp(z, out=z), z.sum(axis=1)


def probabilities(w: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    z, total = _exp(w, bias, rows)
    z /= total[:, None]
    return z


def log_probability(w: np.ndarray, bias: np.ndarray, rows: np.ndarray, k: np.ndarray) -> np.ndarray:
    """log10 of the probability of class ``k`` in each row's context."""
    z, total = _exp(w, bias, rows)
    return np.log10(np.maximum(z[np.arange(len(k)), k].astype(float), 1e-37)) - np.log10(total.astype(float))


def _chunks(batches, own: dict[bytes, int], least: int):
    """(hashes, classes, texts' numbers of tokens) in pieces of whole texts, each as short as ``least`` tokens allow."""
    import pyarrow as pa

    h, k, n = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        texts = batch.column("text")
        for lo, hi in chunks_of(texts, _CHUNK):
            distinct, codes, sizes = coded(texts.slice(lo, hi - lo))
            h = np.append(h, hashes_of(distinct.cast(pa.binary()).to_pylist())[codes])
            k, n = np.append(k, classes_of(distinct, own)[codes]), np.append(n, sizes)
            ends, a, i = np.cumsum(n), 0, 0
            while (j := int(np.searchsorted(ends, a + least)) + 1) <= len(n):
                yield h[a : ends[j - 1]], k[a : ends[j - 1]], n[i:j]
                a, i = int(ends[j - 1]), j
            h, k, n = h[a:], k[a:], n[i:]
    if len(n):
        yield h, k, n


def _updates(start: tuple[np.ndarray, np.ndarray, dict], rate: float):
    """Gradient steps over a task's texts from the given weights; yields how far each touched row moved."""

    def run(batches):
        import pyarrow as pa

        w0, bias0, own = start
        w, bias = w0.copy(), bias0.copy()
        square = np.full(ROWS, 1e-2, np.float32)
        seen, n_all = np.zeros(ROWS, np.int64), 0
        for h_all, k_all, sizes in _chunks(batches, own, 4 * _STEP):
            rows_all = context_rows(h_all, k_all, sizes)
            for lo in range(0, len(k_all), _STEP):
                k, rows = k_all[lo : lo + _STEP], rows_all[lo : lo + _STEP]
                miss = probabilities(w, bias, rows)
                miss[np.arange(len(k)), k] -= 1
                flat = rows.ravel()
                order = np.argsort(flat, kind="stable")  # 16-bit keys: a radix sort
                at = flat[order].astype(np.int64)
                starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                touched = at[starts]
                counts = np.diff(np.append(starts, len(at)))
                g = run_sums(miss, order // 3, starts, counts)
                g /= np.sqrt(counts)[:, None]
                square[touched] += (g * g).mean(axis=1)
                w[touched] -= (rate / np.sqrt(square[touched]))[:, None] * g
                bias -= np.float32(0.5 * rate) * miss.mean(axis=0)
                seen[touched] += counts
                n_all += len(k)
        some = np.flatnonzero(seen)
        moved = np.concatenate([(w[some] - w0[some]).astype(float) * seen[some, None], ((bias - bias0).astype(float) * n_all)[None, :]])
        columns = {"row": np.append(some, ROWS).astype(np.int32), "weight": np.append(seen[some], n_all)}
        yield pa.RecordBatch.from_pydict(columns | {f"d{i}": np.ascontiguousarray(moved[:, i]) for i in range(CLASSES)})

    return run


def train(docs: DataFrame, folds: list[list[int]], start: np.ndarray, own: dict[bytes, int], rate: float = 0.25) -> tuple[np.ndarray, np.ndarray]:
    """Weights (ROWS, CLASSES) and bias after one round for each list of folds; ``start``: log shares of classes.

    What comes back to the driver is the model, of fixed size.
    """
    w, bias = np.zeros((ROWS, CLASSES), np.float32), start.astype(np.float32)
    names = [f"d{i}" for i in range(CLASSES)]
    schema = "row int, weight long, " + ", ".join(f"{c} double" for c in names)
    context = docs.sparkSession.sparkContext
    for part in folds:
        sent = context.broadcast((w, bias, own))
        moved = docs.filter(F.col("fold").isin(part)).select("text").mapInArrow(lambda b, s=sent: _updates(s.value, rate)(b), schema)
        total = moved.groupBy("row").agg(F.sum("weight").alias("weight"), *[F.sum(c).alias(c) for c in names]).filter("weight > 0").toPandas().sort_values("row")
        step = (total[names].to_numpy() / total["weight"].to_numpy()[:, None]).astype(np.float32)
        rows = total["row"].to_numpy()
        w, bias = w.copy(), bias.copy()
        w[rows[rows < ROWS]] += step[rows < ROWS]
        for d in step[rows == ROWS]:
            bias += d
    return w, bias


def _counts(batches):
    """(word, occurrences) in some texts at a time."""
    import pyarrow as pa

    for batch in batches:
        texts = batch.column("text")
        for lo, hi in chunks_of(texts, 8 * _CHUNK):
            found = word_rows(texts.slice(lo, hi - lo))[0].value_counts()
            words, n = found.field("values"), found.field("counts")
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([words, pa.array([END.decode()], words.type)]), pa.concat_arrays([n, pa.array([hi - lo], n.type)])], ["word", "n"])


def _scores(sent):
    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        w, bias, own, class_norm, head_words, head_counts = sent.value
        head = dict(zip(head_words, head_counts))
        nth = TaskContext.get().partitionId() << 36
        for batch in batches:
            texts = batch.column("text")
            for lo, hi in chunks_of(texts, _CHUNK):
                distinct, codes, n = coded(texts.slice(lo, hi - lo))
                words = distinct.cast(pa.binary()).to_pylist()
                k = classes_of(distinct, own)[codes]
                rows = context_rows(hashes_of(words)[codes], k, n)
                gain = np.empty(len(codes))
                for a in range(0, len(codes), _STEP):
                    gain[a : a + _STEP] = log_probability(w, bias, rows[a : a + _STEP], k[a : a + _STEP])
                gain -= class_norm[k]
                c = np.fromiter(map(head.get, words, repeat(0)), np.int64, len(words))
                logs = np.log10(c + 1.0)
                starts = np.cumsum(n) - n
                rare = np.flatnonzero((c == 0)[codes])
                cuts = np.searchsorted(rare, np.append(starts, len(codes))).astype(np.int32)
                tails = pa.ListArray.from_arrays(cuts, distinct.take(pa.array(codes[rare])))
                columns = {
                    "uid": nth + np.arange(len(n)),
                    "doc_id": batch.column("doc_id").slice(lo, hi - lo),
                    "held_out": batch.column("held_out").slice(lo, hi - lo),
                    "n_tokens": n,
                    "head_known": np.add.reduceat((c > 0)[codes].astype(np.int64), starts),
                    "head_log": np.add.reduceat(logs[codes], starts),
                    "gain": np.add.reduceat(gain, starts),
                    "tail": pc.binary_join(tails, " "),
                }
                nth += len(n)
                yield pa.RecordBatch.from_pydict(columns)

    return run


def score(docs: DataFrame, head: int = 1 << 17, mod: int = 7, held: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``.

    Rows whose CRC-32 modulo ``mod`` is ``held`` are held out; the others are learned from, each once.
    ``head`` bounds the words sent to workers; the rest are joined. A token not seen in training stands
    for one unknown word of its class, so probabilities sum to one. Null and empty texts are their end
    alone. Repeated rows are scored (and learned from) each by itself. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", bucket_of(F.col("doc_id"), mod).alias("fold"))
    training = slim.filter(F.col("fold") != held)
    counts = stored(training.select("text").mapInArrow(_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("c")))
    top = most_frequent(counts, "word", "c", head).toPandas().sort_values(["c", "word"], ascending=[False, True])
    # the end of a text is a word like others here; words that share a count with the last of the table are looked up by the join
    own = {w.encode(): i for i, w in enumerate(top["word"][:OWN])}
    k = OWN + F.crc32(F.substring(F.col("word").cast("binary"), 1, 3)) % (CLASSES - OWN)
    for w, i in own.items():
        k = F.when(F.col("word") == w.decode(), i).otherwise(k)
    by_class = counts.groupBy(k.alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    size, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in by_class:
        size[r["k"]], kinds[r["k"]] = r["n"], r["v"]
    total, distinct = int(size.sum()), int(kinds.sum())
    known = [f for f in range(mod) if f != held]
    w, bias = train(slim, [known[0::2], known[1::2]], np.log((size + 1) / (size + 1).sum()), own) if total else (np.zeros((ROWS, CLASSES), np.float32), np.zeros(CLASSES, np.float32))
    sent = spark.sparkContext.broadcast((w, bias, own, np.log10(size + kinds + 1), [w.encode() for w in top["word"]], top["c"].tolist()))
    schema = "uid long, doc_id long, held_out boolean, n_tokens long, head_known long, head_log double, gain double, tail string"
    rows = stored(slim.select("doc_id", "text", (F.col("fold") == held).alias("held_out")).mapInArrow(_scores(sent), schema))
    tail = rows.filter("tail <> ''").select("uid", F.explode(F.split("tail", " ")).alias("word")).join(counts, "word").groupBy("uid").agg(F.count("*").alias("tail_known"), F.sum(F.log10(F.col("c") + 1)).alias("tail_log"))
    out = rows.drop("tail").join(tail, "uid", "left")
    logs = F.col("head_log") + F.coalesce("tail_log", F.lit(0.0))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.lit(float(np.log10(total + distinct + 1)))).alias("base_score"),
        (logs + F.col("gain")).alias("score"),
    )
