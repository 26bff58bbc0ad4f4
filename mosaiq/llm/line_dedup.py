"""Fuzzy line de-duplication: pigeonhole blocks of words, sketches, edit similarity, components.

Lines are normalised and hashed exactly first, so that repeats of one line, however many, fold into one
representative by partial aggregation. Two representatives of an edit similarity of 0.8 differ in so few words that
a run of words is the same in both (the pigeonhole principle): runs are the blocks that they are joined on
(see ``run_keys``). In each block all lines meet one of them first; what verification leaves apart is then compared
across components. Parities of word classes, more of them for long lines, bound the edits of a pair exactly before lines are fetched. Candidates
are verified by word edit similarity on the lines themselves, and all but the first occurrence of each connected
group of lines go.

Blocks of SimHash bits, the usual choice, don't serve here: lines at 0.8 differ in some 13 of 64 bits (see README).
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache
from hashlib import md5
from operator import ne

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.common import bytes_of, connected_components, discard, mix64, stored

_MARKS = b".,;:!?\"'()[]{}<>|*#$%&-_"
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else 32 if c in b"\t\x0b\x0c\r" else c for c in range(256))


def normal_words(line: bytes) -> list[bytes]:
    """Words of a line as they are compared: A-Z lower-cased, every digit as 0, ASCII punctuation dropped."""
    return line.translate(_FOLD, _MARKS).split()


#: Runs of words kept a line, and bits of their keys.
RUNS, _KEY_BITS = 12, 48


def _distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; sorts in place."""
    x.sort()
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def _lowest(owner: np.ndarray, h: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` smallest distinct keys of each owner, as owner << _KEY_BITS | key, in order."""
    x = _distinct((owner.astype(np.uint64) << np.uint64(_KEY_BITS)) | (h >> np.uint64(64 - _KEY_BITS)))
    who = x >> np.uint64(_KEY_BITS)
    first = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]])) if len(x) else np.empty(0, np.int64)
    return x[np.arange(len(x)) - np.repeat(first, np.diff(np.append(first, len(x)))) < most]


def run_keys(hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, ends by line) of runs of words, by which lines of an edit similarity of at least 0.8 find each other.

    Of the n words of the longer line at least 0.8 n are left, in at most 0.2 n + 1 runs. So two lines share four words
    in a row if n > 15, three if n > 5; if n is 5, their first two or last two words. Up to 15 words all these runs
    are keys, which misses no pair. Longer lines keep the RUNS smallest hashes of their runs of four: at
    0.8 and random edits a quarter of all runs are common, and some of them lie below both lines' bounds.
    """
    lengths = np.diff(np.append(starts, len(hashes)))
    owner = np.repeat(np.arange(len(starts)), lengths)
    left = np.repeat(lengths + starts, lengths) - np.arange(len(hashes))  # words from here to the line's end
    whole = np.repeat(lengths, lengths)

    def runs(at: np.ndarray, width: int, salt: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            sums = np.full(len(at), salt, np.uint64)
            for k in range(width):
                sums = (sums ^ hashes[at + k]) * np.uint64(0x9E3779B97F4A7C15)
                sums ^= sums >> np.uint64(32)
        return mix64(sums)

    found = []
    for width, salt, chosen in ((2, 2, (left == whole) & (whole >= 4) & (whole <= 5)), (2, 5, (left == 2) & (whole >= 4) & (whole <= 5)), (3, 3, (left >= 3) & (whole >= 5) & (whole <= 15)), (4, 4, (left >= 4) & (whole >= 13))):
        at = np.flatnonzero(chosen)
        found.append(_lowest(owner[at], runs(at, width, salt), RUNS))
    x = _distinct(np.concatenate(found))
    ends = np.searchsorted(x >> np.uint64(_KEY_BITS), np.arange(len(starts)).astype(np.uint64), side="right")
    return (x & np.uint64((1 << _KEY_BITS) - 1)).astype(np.int64), ends


#: Classes of words whose parities are kept, 64 a long.
_PARITIES = 4


def _classes(hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, line) of the words of each line: the second, third, ... time that a word stands in a line it counts as a word of its own, so that repeats show."""
    lengths = np.diff(np.append(starts, len(hashes)))
    x = (np.repeat(np.arange(len(starts), dtype=np.uint64), lengths) << np.uint64(_KEY_BITS)) | (hashes >> np.uint64(64 - _KEY_BITS))
    x.sort()
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    time = np.arange(len(x)) - np.repeat(first, np.diff(np.append(first, len(x))))
    with np.errstate(over="ignore"):
        return mix64((x << np.uint64(64 - _KEY_BITS)) + time.astype(np.uint64)), (x >> np.uint64(_KEY_BITS)).astype(np.int64)


def parities(hashes: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """_PARITIES longs a line: of each class of words, whether the line has an odd number. An edit flips two bits at most."""
    return _parities(_classes(hashes, starts)[0], starts)


def _parities(seen: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    bits = np.uint64(1) << (seen & np.uint64(63))
    part = (seen >> np.uint64(6)) & np.uint64(_PARITIES - 1)
    return [np.bitwise_xor.reduceat(np.where(part == q, bits, np.uint64(0)), starts).view(np.int64) for q in range(_PARITIES)]


#: Lines of more words also have parities of four classes a word at least: random lines differ in half of few classes, which is less than a fifth of many words.
_LONG = 128
#: Longs of those parities that joins compare; lines of more than twice as many have them all besides.
_FOLDED = 16


def wide_parities(hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(lines of more than _LONG words, parities of each): a power of two of classes, which halved are those of the power below."""
    return _wide(*_classes(hashes, starts), starts)


def _wide(seen: np.ndarray, owner: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    lengths = np.diff(np.append(starts, len(seen)))
    long = np.flatnonzero(lengths > _LONG)
    if not len(long):
        return long, []
    longs = np.zeros(len(starts), np.int64)
    longs[long] = 1 << np.ceil(np.log2(4 * lengths[long] / 64)).astype(np.int64)
    ends = np.cumsum(longs)
    chosen = longs[owner] > 0
    seen, owner = seen[chosen], owner[chosen]
    out = np.zeros(ends[-1], np.uint64)
    at = (seen >> np.uint64(6)).view(np.int64) & (longs[owner] - 1)
    np.bitwise_xor.at(out, (ends - longs)[owner] + at, np.uint64(1) << (seen & np.uint64(63)))
    return long, np.split(out.view(np.int64), ends[long][:-1])


def normal_lines(text) -> list[bytes]:
    """The normal words of each line of a text, parted by single spaces."""
    text = bytes_of(text).translate(_FOLD, _MARKS)
    while b"  " in text:
        text = text.replace(b"  ", b" ")
    return [x.strip(b" ") for x in text.split(b"\n")]


def _lines(text) -> list[bytes]:
    return bytes_of(text).split(b"\n")


_SKETCH = tuple(f"p{i}" for i in range(_PARITIES))
_LINE_SCHEMA = f"doc_id long, line int, h1 long, h2 long, words int, {', '.join(f'{p} long' for p in _SKETCH)}, bucket int, pack binary, fold array<long>, wide array<long>"
_SLICE, _SEEN, _PACKED = 1 << 15, 1 << 16, 1 << 20
_BYTE = np.where(np.arange(256) == 32, 0, np.arange(256) + 1).astype(np.uint64)
_SPAN, _WHOLE, _FACTOR = 1 << 16, 1 << 19, 0x9E3779B97F4A7C15


@lru_cache(2)
def _powers(factor: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(_WHOLE, factor, np.uint64))


def word_hashes(line_words: bytes) -> np.ndarray:
    """64-bit hashes of words that are parted by single spaces: a polynomial of the bytes of each, mixed with its length.

    Collisions only make more candidates or fewer bits differ; lines are compared by their words.
    """
    codes = np.frombuffer(line_words, np.uint8)
    starts = np.concatenate([[0], np.flatnonzero(codes == 32) + 1])
    lengths = np.diff(np.append(starts, len(codes) + 1))
    with np.errstate(over="ignore"):
        if len(codes) < _WHOLE and lengths.max() <= _SPAN:  # running sums over all words; the inverse power takes a word's place out
            sums = np.zeros(len(codes) + 1, np.uint64)
            np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _powers(_FACTOR)[: len(codes)], out=sums[1:])
            sums = sums[starts + lengths - 1] - sums[starts]
            sums[1:] *= _powers(pow(_FACTOR, -1, 1 << 64))[starts[1:] - 1]
        else:
            offsets = np.arange(len(codes)) - np.repeat(starts, lengths)[: len(codes)]
            sums = np.add.reduceat(_BYTE[codes] * _powers(_FACTOR)[offsets % _SPAN], starts)
        return mix64(sums ^ (lengths.astype(np.uint64) << np.uint64(48)))


def _hash_lines(buckets: int):
    """(doc_id, line, 128-bit hash of the normal words) of every line with a normal word, and the lines of each block.

    The number of words and parities come with the first of equal lines only, as far as the task remembers lines (a
    bounded number): the others have nulls, which no minimum sees. Long lines have wide parities. The block keys come in rows of their own, which
    have a bucket and no doc_id: a pack is many (block, h1), two longs each, so that a shuffle moves few rows.
    """

    def run(batches):
        from xxhash import xxh3_128_digest

        seen: set[bytes] = set()

        def row_batch(n, **columns):
            kinds = dict(zip(("doc_id", "line", "h1", "h2", "words", *_SKETCH, "bucket", "pack", "fold", "wide"), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * _PARITIES, pa.int32(), pa.binary(), *[pa.list_(pa.int64())] * 2)))
            return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, kind) for c, kind in kinds.items()], names=list(kinds))

        def listed(n, at, found):
            sizes = np.zeros(n, np.int64)
            sizes[at] = [len(x) for x in found]
            ends = pa.array(np.append(0, np.cumsum(sizes)), pa.int32(), mask=np.append(sizes == 0, False))  # a null begins no list
            return pa.ListArray.from_arrays(ends, pa.array(np.concatenate(found)))

        def flush(keys, nos, digests, where, lines, counts, packed):
            d = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            n = len(keys)
            at = np.array(where, np.int64)
            new = np.zeros(n, bool)
            new[at] = True
            full = np.zeros((1 + _PARITIES, n), np.int64)
            wide = {}
            if lines:
                counts = np.array(counts)
                starts = np.cumsum(counts) - counts
                hashes = word_hashes(b" ".join(lines))
                found, ends = run_keys(hashes, starts)
                packed.append(np.stack([found, np.repeat(d[at, 0], np.diff(np.append(0, ends)))], axis=1))
                classes, owner = _classes(hashes, starts)
                full[:, at] = [counts, *_parities(classes, starts)]
                long, found = _wide(classes, owner, starts)
                if found:
                    wide["fold"] = listed(n, at[long], [np.bitwise_xor.reduce(x.reshape(-1, _FOLDED)) for x in found])
                    longer = [i for i, x in enumerate(found) if len(x) > 2 * _FOLDED]
                    if longer:
                        wide["wide"] = listed(n, at[long[longer]], [found[i] for i in longer])
            sketch = {p: pa.array(x, mask=~new) for p, x in zip(_SKETCH, full[1:])}
            return row_batch(n, doc_id=pa.array(keys, pa.int64()), line=pa.array(nos, pa.int32()), h1=pa.array(d[:, 0]), h2=pa.array(d[:, 1]), words=pa.array(full[0].astype(np.int32), mask=~new), **sketch, **wide)

        def packs(packed):
            pairs = np.concatenate(packed)
            bucket = (pairs[:, 0] % buckets).astype(np.uint16)
            pairs = np.ascontiguousarray(pairs[np.argsort(bucket, kind="stable")])
            sizes = np.bincount(bucket, minlength=buckets)
            held = np.flatnonzero(sizes)
            ends = np.append(0, np.cumsum(sizes[held]) * 16).astype(np.int32)
            return row_batch(len(held), bucket=pa.array(held, pa.int32()), pack=pa.Array.from_buffers(pa.binary(), len(held), [None, pa.py_buffer(ends), pa.py_buffer(pairs)]))

        packed: list = []
        for batch in batches:
            held, size = ([], [], [], [], [], []), 0
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                for no, line in enumerate(normal_lines(text.as_py())):
                    if line:
                        digest = xxh3_128_digest(line)
                        if digest not in seen:
                            if len(seen) >= _SEEN:
                                seen.clear()
                            seen.add(digest)
                            held[3].append(len(held[0]))
                            held[4].append(line)
                            held[5].append(line.count(b" ") + 1)
                            size += held[5][-1]
                        held[0].append(key)
                        held[1].append(no)
                        held[2].append(digest)
                        if size >= _SLICE or len(held[0]) >= _SLICE:
                            yield flush(*held, packed)
                            held, size = ([], [], [], [], [], []), 0
                            if sum(map(len, packed)) >= _PACKED:
                                yield packs(packed)
                                packed.clear()
            if held[0]:
                yield flush(*held, packed)
        if sum(map(len, packed)):
            yield packs(packed)

    return run


def _members(batches):
    """(block, rep, lead, more) of all lines in blocks of two different lines at least, from the packs of one task's blocks.

    A block's lead is any of its lines, by an order of its own: the same lines meet other leads in each of the blocks
    they share. ``more``: the block has more than two lines. Takes 16 bytes a pair, and some times that in sorting.
    """
    found = [np.frombuffer(x.as_buffer(), np.int64).reshape(-1, 2) for batch in batches for x in batch.column("pack")]
    if not found:
        return
    pairs = np.concatenate(found)
    del found
    pairs = pairs[np.argsort(pairs[:, 0])]
    block = pairs[:, 0]
    same = block[1:] == block[:-1]
    pairs = pairs[np.append(False, same) | np.append(same, False)]  # most blocks have one line
    order = pairs[:, 1].view(np.uint64) ^ mix64(pairs[:, 0].view(np.uint64))
    pairs = pairs[np.lexsort((order, pairs[:, 0]))]
    pairs = pairs[np.append(True, (pairs[1:] != pairs[:-1]).any(axis=1))] if len(pairs) else pairs
    starts = np.flatnonzero(np.append(True, pairs[1:, 0] != pairs[:-1, 0])) if len(pairs) else np.empty(0, np.int64)
    sizes = np.diff(np.append(starts, len(pairs)))
    lead, size = np.repeat(pairs[starts, 1], sizes), np.repeat(sizes, sizes)
    for i in range(0, len(pairs), _SLICE):
        cut = slice(i, i + _SLICE)
        at = np.flatnonzero(size[cut] > 1) + i
        yield pa.RecordBatch.from_arrays([pa.array(pairs[at, 0]), pa.array(pairs[at, 1]), pa.array(lead[at]), pa.array(size[at] > 2)], names=["block", "rep", "lead", "more"])


def _across(similarity: float):
    """Pairs (a, b) of lines of one block but two components, whose numbers of words, parities and folded wide parities leave the similarity possible.

    Lines are compared with those of their block that have as many words or up to 1 / similarity as many. A pair that
    shares several blocks is met in the least of them. A task holds the rows of its blocks, and about a million pairs.
    """

    def run(batches):
        rows = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if rows is None or not rows.num_rows:
            return
        block, rep, comp, words, *sketch = (rows.column(c).to_numpy() for c in ("block", "rep", "comp", "words", *_SKETCH))
        order = np.lexsort((words, block))
        block, rep, comp, words, *sketch = (x[order] for x in (block, rep, comp, words.astype(np.int64), *sketch))
        folds = rows.column("fold").combine_chunks()
        has = folds.is_valid().to_numpy(zero_copy_only=False)
        fold = np.full(len(has), -1)
        fold[has] = np.arange(has.sum())
        fold, folds = fold[order], folds.flatten().to_numpy(zero_copy_only=False).reshape(-1, _FOLDED)
        every = rows.column("every").combine_chunks()
        most = 2 * np.floor((1 - similarity) * words + 1e-9).astype(np.int64)
        place = (np.cumsum(np.append(0, block[1:] != block[:-1])) << 32) + words
        ends = np.searchsorted(place, place - words + np.floor(words / similarity + 1e-6).astype(np.int64), side="right")
        counts = ends - np.arange(len(ends)) - 1
        total, lo = np.cumsum(counts), 0
        while lo < len(counts):
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + _PACKED, side="right")))
            n = counts[lo:hi]
            i = np.repeat(np.arange(lo, hi), n)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
            lo = hi
            flips = np.where(comp[i] != comp[j], words[j] - words[i], 1 << 40)
            for p in sketch:
                left = flips <= most[j]
                i, j, flips = i[left], j[left], flips[left]
                flips = flips + np.bitwise_count(p[i].view(np.uint64) ^ p[j].view(np.uint64))
            left = flips <= most[j]
            i, j = i[left], j[left]
            u, v = fold[i], fold[j]
            at = np.flatnonzero((u >= 0) & (v >= 0))
            flips = np.bitwise_count((folds[u[at]] ^ folds[v[at]]).view(np.uint64)).sum(axis=1, dtype=np.int64) + words[j[at]] - words[i[at]]
            left = np.ones(len(i), bool)
            left[at] = flips <= most[j[at]]
            i, j = i[left], j[left]
            mine, other = every.take(pa.array(order[i])).to_pylist(), every.take(pa.array(order[j])).to_pylist()
            left = np.array([min(set(x).intersection(y)) == b for x, y, b in zip(mine, other, block[i].tolist())], bool)
            a, b = rep[i[left]], rep[j[left]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return run


def _trimmed(x: list, y: list) -> tuple[list, list]:
    """Both lists less what they have in common at their ends."""
    least = min(len(x), len(y))
    i = 0
    while i < least and x[i] == y[i]:
        i += 1
    j = 0
    while j < least - i and x[-1 - j] == y[-1 - j]:
        j += 1
    return x[i : len(x) - j], y[i : len(y) - j]


def edit_distance(x: list, y: list, most: int) -> int:
    """Word edit distance if it is at most ``most``, else ``most`` + 1.

    Columns of the table of distances are kept as bit vectors of their vertical steps, in integers of any length.
    """
    x, y = _trimmed(x, y)
    if len(x) > len(y):
        x, y = y, x
    if len(y) - len(x) > most:
        return most + 1
    if not x:
        return len(y)
    # An edit leaves all but one word of the longer in common, in whatever order.
    bag = Counter(x)
    if len(y) - sum(min(c, bag[w]) for w, c in Counter(y).items() if w in bag) > most:
        return most + 1
    places: dict = {}
    for i, w in enumerate(x):
        places[w] = places.get(w, 0) | (1 << i)
    full, last = (1 << len(x)) - 1, 1 << (len(x) - 1)
    up, down, score, left = full, 0, len(x), len(y)
    for w in y:
        same = places.get(w, 0)
        diagonal = (((same & up) + up) ^ up) | same
        right, back = (down | ~(diagonal | up)) & full, up & diagonal
        if right & last:
            score += 1
        elif back & last:
            score -= 1
        left -= 1
        if score - left > most:
            return most + 1
        right, vertical = ((right << 1) | 1) & full, same | down
        up, down = ((back << 1) | ~(vertical | right)) & full, right & vertical
    return min(score, most + 1)


def _walk(x: list, y: list, most: int) -> bool:
    """Whether a walk along both lists that looks one word ahead needs ``most`` edits at most; the fewest may be less."""
    i, j, n, m, edits = 0, 0, len(x), len(y), 0
    while i < n and j < m:
        if x[i] != y[j]:
            edits += 1
            if edits > most:
                return False
            if i + 1 < n and j + 1 < m and x[i + 1] == y[j + 1]:
                pass
            elif i + 1 < n and x[i + 1] == y[j]:
                j -= 1
            elif j + 1 < m and x[i] == y[j + 1]:
                i -= 1
        i += 1
        j += 1
    return edits + n - i + m - j <= most


def within(x: list, y: list, most: int) -> bool:
    """Whether the word edit distance is at most ``most``: what an alignment takes bounds it, so it is worked out only where those at hand take more."""
    if abs(len(x) - len(y)) > most:
        return False
    return len(x) == len(y) and sum(map(ne, x, y)) <= most or _walk(x, y, most) or edit_distance(x, y, most) <= most


def _confirm(least: float):
    def run(batches):
        for pdf in batches:
            words: dict = {}
            keep = np.zeros(len(pdf), bool)
            for n, (a, b, x, y) in enumerate(zip(pdf["a"], pdf["b"], pdf["ta"], pdf["tb"])):
                for k, v in ((a, x), (b, y)):
                    if k not in words:
                        words[k] = normal_words(bytes(v))
                x, y = words[a], words[b]
                most = int((1 - least) * max(len(x), len(y)) + 1e-9)
                keep[n] = within(x, y, most)
            yield pdf.loc[keep, ["a", "b"]]

    return run


def _wanted_lines(batches):
    for pdf in batches:
        keys, found = [], []
        for text, nos, ids in zip(pdf["text"], pdf["lines"], pdf["reps"]):
            lines = _lines(text)
            for no, rep in zip(nos, ids):
                if no < len(lines):  # of rows that share a doc_id one has the line
                    keys.append(rep)
                    found.append(lines[no])
        yield pd.DataFrame({"rep": keys, "content": found})


#: Bits of the filter that documents pass before a shuffle, and of one row of it.
_FILTER, _ROW = 1 << 23, 1 << 15


def _likely(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``docs`` less most of those whose doc_id ``wanted`` lacks: by one bit an id, in a table of a megabyte at any size."""
    at = F.pmod(F.xxhash64("doc_id"), F.lit(_FILTER))
    row, bit = F.floor(at / _ROW), at % _ROW
    bits = wanted.groupBy(row.alias("_mq_row")).agg(F.bitmap_construct_agg(bit).alias("_mq_bits"))
    byte = F.conv(F.hex(F.substring("_mq_bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = docs.withColumn("_mq_row", row).join(F.broadcast(bits), "_mq_row")
    return found.filter(byte.bitwiseAND(F.pow(F.lit(2), bit % 8).cast("int")) != 0).select(docs.columns)


def repeats(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """(doc_id, line, comp) of every line of ``docs`` (doc_id, text) that isn't the first of its group.

    Joins build hash tables from the sides that have each key once (a line, a document), so that texts are not
    sorted. The lines of all blocks are shuffled in packs and sorted in memory, 16 bytes each, in as many tasks as
    spark.sql.shuffle.partitions says.

    Lines end at \\n and count from 0. Two lines are linked if their normal words are equal, or if they share a key of
    ``run_keys`` and their word edit similarity, 1 - edits / words of the longer, is at least ``similarity`` (0.8 or
    more: below, the keys miss pairs). A group is what links connect; its first occurrence is the one of the smallest
    (doc_id, line), and comp names it. Lines without a normal word never count as repeats; null and empty texts
    have none. Rows without doc_id take no part. Rows that share a doc_id should hold one text; of lines equal in
    doc_id, number and words all go or stay together. An empty table has no repeats.
    """
    if similarity < 0.8:
        raise ValueError("the block keys hold for a similarity of at least 0.8")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    buckets = min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 << 15)
    lines = stored(docs.mapInArrow(_hash_lines(buckets), _LINE_SCHEMA))
    # Blocks that hold two different lines at least, and their members, each once.
    packs = lines.filter("bucket is not null").select("bucket", "pack").repartitionById(buckets, F.col("bucket"))
    members = stored(packs.select("pack").mapInArrow(_members, "block long, rep long, lead long, more boolean"))
    lines = lines.filter("doc_id is not null")
    least = [F.min(c).alias(c) for c in ("words", *_SKETCH)]
    # One occurrence of each line, by which it is fetched: of the least doc_id, there any.
    reps = stored(lines.groupBy("h1", "h2").agg(F.min("doc_id").alias("at_doc"), F.min_by("line", "doc_id").alias("at_line"), F.count("*").alias("n"), *least))
    wides = stored(lines.filter("fold is not null").groupBy(F.col("h1").alias("rep")).agg(F.any_value("fold").alias("fold"), F.any_value("wide").alias("wide"), F.min("words").alias("words")))
    places = stored(lines.select("doc_id", "line", "h1", "h2"))
    discard(lines)

    def most(x: str, y: str):
        return F.floor((1 - similarity) * F.greatest(f"{x}words", f"{y}words") + 1e-9)

    def near(x: str, y: str):
        """Whether numbers of words and parities leave the edit similarity possible: an exact bound.

        Of two bags the larger has words that the other lacks: half of what differs and half of what it is larger by.
        """
        flips = sum((F.bit_count(F.col(f"{x}{p}").bitwiseXOR(F.col(f"{y}{p}"))) for p in _SKETCH), F.abs(F.col(f"{x}words") - F.col(f"{y}words")))
        return flips <= 2 * most(x, y)

    def near_wide(x: str, y: str):
        """The same of all wide parities, where both lines have them. Their numbers of classes are alike or one twice the other's."""
        u, v = F.col(f"{x}wide"), F.col(f"{y}wide")

        def cut(u, v):
            half = F.floor(F.size(u) / 2).cast("int")
            return F.when(F.size(u) > F.size(v), F.zip_with(F.slice(u, 1, half), F.slice(u, half + 1, half), lambda a, b: a.bitwiseXOR(b))).otherwise(u)

        flips = F.aggregate(F.zip_with(cut(u, v), cut(v, u), lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda n, k: n + k)
        return F.coalesce(flips + F.abs(F.col(f"{x}words") - F.col(f"{y}words")) <= 2 * most(x, y), F.lit(True))

    def named(table: DataFrame, key: str, name: str, prefix: str, *columns: str) -> DataFrame:
        return table.select(F.col(key).alias(name), *[F.col(c).alias(f"{prefix}{c}") for c in columns])

    def sketch_of(name: str, prefix: str) -> DataFrame:
        return named(reps, "h1", name, prefix, "words", *_SKETCH).hint("shuffle_hash")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Of stored pairs, those that reach the edit similarity; their lines are fetched from the texts."""
        ids = pairs.select(F.explode(F.array("a", "b")).alias("h1")).distinct()
        spots = reps.join(ids, "h1", "left_semi").groupBy(F.col("at_doc").alias("doc_id")).agg(F.collect_list(F.struct(F.col("at_line").alias("line"), F.col("h1").alias("rep"))).alias("s"))
        spots = stored(spots)
        content = _likely(docs, spots).join(spots.hint("shuffle_hash"), "doc_id").select("text", F.col("s.line").alias("lines"), F.col("s.rep").alias("reps")).mapInPandas(_wanted_lines, "rep long, content binary")
        content = stored(content)
        one = content.groupBy("rep").agg(F.min("content").alias("content"))
        both = pairs.join(one.select(F.col("rep").alias("b"), F.col("content").alias("tb")), "b").join(one.select(F.col("rep").alias("a"), F.col("content").alias("ta")), "a")
        out = stored(both.select("a", "b", "ta", "tb").mapInPandas(_confirm(similarity), "a long, b long"))
        discard(content)
        discard(spots)
        return out

    stars = members.filter("rep <> lead").select(F.least("lead", "rep").alias("a"), F.greatest("lead", "rep").alias("b")).distinct()
    stars = stored(stars.join(sketch_of("a", "x_"), "a").join(sketch_of("b", "y_"), "b").filter(near("x_", "y_")).select("a", "b"))
    links = confirmed(stars)
    comps = connected_components(links)
    # Blocks that hold several components yet: pairs across components.
    placed = members.filter("more").join(comps.select(F.col("node").alias("rep"), "comp"), "rep", "left").select("block", "rep", F.coalesce("comp", "rep").alias("comp"))
    apart = placed.groupBy("block").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("block")
    left = placed.join(apart, "block").groupBy("rep").agg(F.min("comp").alias("comp"), F.collect_list("block").alias("every"))
    left = stored(left.join(sketch_of("rep", ""), "rep").join(wides.select("rep", "fold").hint("shuffle_hash"), "rep", "left"))
    spread = left.select(F.explode("every").alias("block"), "rep", "comp", "every", "words", *_SKETCH, "fold")
    across = spread.repartition("block").mapInArrow(_across(similarity), "a long, b long")
    met = stored(across.join(stars, ["a", "b"], "left_anti"))
    longest = stored(wides.filter("wide is not null").select("rep", "words", "wide"))
    pairs = met.join(named(longest, "rep", "a", "x_", "words", "wide"), "a", "left").join(named(longest, "rep", "b", "y_", "words", "wide"), "b", "left")
    across = stored(pairs.filter(near_wide("x_", "y_")).select("a", "b"))
    discard(met)
    if across.limit(1).count():
        comps = connected_components(links.union(confirmed(across)))

    grouped = reps.select("h1", "h2", "n").join(comps.select(F.col("node").alias("h1"), "comp"), "h1", "left").filter("n > 1 or comp is not null")
    owned = stored(grouped.select("h1", "h2", F.coalesce("comp", "h1").alias("comp")))
    for done in (members, stars, left, across, links, reps, wides, longest):
        discard(done)
    all_of = stored(places.join(owned.hint("shuffle_hash"), ["h1", "h2"]).select("doc_id", "line", "comp"))
    discard(places)
    heads = all_of.groupBy("comp").agg(F.min(F.struct("doc_id", "line")).alias("head"))
    return all_of.join(heads, "comp").filter(F.struct("doc_id", "line") != F.col("head")).select("doc_id", "line", "comp")


def _gone(docs: DataFrame, **how) -> DataFrame:
    """(_mq_id, _mq_gone): numbers of the repeated lines of each document that has some."""
    return stored(repeats(docs, **how).groupBy(F.col("doc_id").alias("_mq_id")).agg(F.collect_set("line").alias("_mq_gone"))).hint("shuffle_hash")


def without_repeats(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with column text less its repeated lines, and _mq_lines, _mq_removed: lines before, and removed.

    Columns of any other names stay as they are. Null texts stay null, rows without doc_id are left alone.
    """
    packed = docs.select(F.col("doc_id").cast("long").alias("_mq_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_mq_row"), F.col("text").alias("_mq_text"))
    slim = packed.join(_gone(docs, **how), "_mq_id", "left")
    hit = F.col("_mq_gone").isNotNull() & F.col("_mq_text").isNotNull()
    text = F.col("_mq_text")
    n_lines = F.when(text.isNull(), 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    slim = slim.withColumn("_mq_all", F.when(hit, F.split("_mq_text", "\n", -1)))
    slim = slim.withColumn("_mq_stay", F.when(hit, F.array_except(F.sequence(F.lit(0), F.size("_mq_all") - 1), "_mq_gone")))
    kept = F.when(hit, F.array_join(F.transform("_mq_stay", lambda i: F.get("_mq_all", i)), "\n")).otherwise(text)
    out = slim.withColumn("_mq_lines", n_lines).withColumn("_mq_removed", F.when(hit, F.size("_mq_all") - F.size("_mq_stay")).otherwise(0).cast("long")).withColumn("_mq_text", kept)
    return out.select(*[(F.col("_mq_text") if c == "text" else F.col(f"_mq_row.`{c}`")).alias(c) for c in docs.columns], "_mq_lines", "_mq_removed")


def _figures(batches):
    for batch in batches:
        found = []
        for text, gone in zip(batch.column("text"), batch.column("_mq_gone").to_pylist()):
            text = text.as_py()
            n = text.count(b"\n") + 1 if text is not None else 0
            stay = n
            if gone and n:
                gone = set(gone)
                kept = [x for i, x in enumerate(text.split(b"\n")) if i not in gone]
                text, stay = b"\n".join(kept), len(kept)
            text = text or b""
            found.append((n, n - stay, len(text) if text.isascii() else len(text.decode("utf-8", "replace")), md5(text).hexdigest()))
        n, removed, chars, digests = zip(*found) if found else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, removed, chars)), pa.array(digests, pa.string())], names=["doc_id", "n_lines", "n_removed", "n_chars_kept", "text_md5"])


def report(docs: DataFrame, **how) -> DataFrame:
    """One row per document: its lines, how many of them repeat others, and what is left of its text.

    The figures are those of the texts that ``without_repeats`` gives, taken from their bytes.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("_mq_id"), "doc_id", F.col("text").cast("binary").alias("text"))
    rows = rows.join(_gone(docs, **how), "_mq_id", "left").select("doc_id", "text", "_mq_gone")
    return rows.mapInArrow(_figures, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_lines long, n_removed long, n_chars_kept long, text_md5 string")


def keep_first(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with their repeated lines gone; documents of which no word is left go too, unless they had none."""
    out = without_repeats(docs, **how)
    empty = F.btrim(F.coalesce("text", F.lit("")), F.lit(" \t\n\x0b\x0c\r")) == ""
    return out.filter(~((F.col("_mq_removed") > 0) & empty)).drop("_mq_lines", "_mq_removed")
