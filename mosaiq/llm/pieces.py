"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie, with byte fallback.

The vocabulary is the file of a public tokenizer, read from its wire format; nothing is trained. A text
gets the white-space marker for every space and one before it. No piece holds a marker after another
character, so the best segmentation of a text is that of its units (a run of markers with the word
behind it), and each distinct unit is segmented once while it is remembered: all places of a block of units
walk through the trie together, the best ways advance position by position, and all are read back together.
"""

from __future__ import annotations

import heapq
import os
import re
import struct
from dataclasses import dataclass
from functools import lru_cache
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.common import chunks_of

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
_MARK = MARK.encode()
_UNIT = re.compile(rb"(?:\xe2\x96\x81)*(?:(?!\xe2\x96\x81).)+|(?:\xe2\x96\x81)+", re.S)
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: What an unknown character costs below the least score.
UNKNOWN_PENALTY = 10.0
_LONG = 96
#: Units that advance together.
_BLOCK = 8192
#: Bytes of text encoded at once (a longer text is by itself).
_CHUNK = 1 << 21


def _fields(data: bytes):
    """(number, value) of a protocol-buffers message: ints, 4-byte strings or byte strings."""
    i, n = 0, len(data)

    def varint():
        nonlocal i
        out = shift = 0
        while True:
            c = data[i]
            i += 1
            out |= (c & 127) << shift
            if c < 128:
                return out
            shift += 7

    while i < n:
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        elif key & 7 == 2:
            size = varint()
            yield key >> 3, data[i : i + size]
            i += size
        else:
            size = 4 if key & 7 == 5 else 8
            yield key >> 3, data[i : i + size]
            i += size


@dataclass
class Vocabulary:
    pieces: list[bytes]
    scores: np.ndarray
    kinds: np.ndarray

    @classmethod
    def load(cls, data: bytes) -> Vocabulary:
        pieces, scores, kinds = [], [], []
        for number, value in _fields(data):
            if number == 1:
                f = dict(_fields(value))
                pieces.append(f.get(1, b""))
                scores.append(struct.unpack("<f", f[2])[0] if 2 in f else 0.0)
                kinds.append(f.get(3, NORMAL))
        return cls(pieces, np.array(scores, float), np.array(kinds, np.int8))


class DoubleArray:
    """Trie over bytes in two arrays: state s goes by byte c to base[s] + c if check there is s."""

    def __init__(self, keys: list[bytes], values: list[int]):
        order = sorted(range(len(keys)), key=keys.__getitem__)
        keys, values = [keys[i] for i in order], [values[i] for i in order]
        size = max(1024, 4 * sum(map(len, keys)) // 3 + 1024)
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        used = np.zeros(size, bool)
        used[0] = True
        free_from = front = 1
        heap = [(-len(keys), 0, 0, len(keys), 0)]  # large nodes first: small ones then fill the holes
        while heap:
            _, state, lo, hi, depth = heapq.heappop(heap)
            children: list[tuple[int, int, int]] = []
            i = lo
            if i < hi and len(keys[i]) == depth:
                value[state] = values[i]
                i += 1
            while i < hi:
                c, j = keys[i][depth], i
                while j < hi and keys[j][depth] == c:
                    j += 1
                children.append((c, i, j))
                i = j
            if not children:
                continue
            codes = np.array([c for c, _, _ in children])
            b = free_from - children[0][0] if len(children) == 1 else -1
            while b <= 0:
                if front + 1024 >= len(used):
                    grow = len(used)
                    base, value = np.append(base, np.zeros(grow, np.int32)), np.append(value, np.full(grow, -1, np.int32))
                    check, used = np.append(check, np.full(grow, -1, np.int32)), np.append(used, np.zeros(grow, bool))
                slots = front + np.flatnonzero(~used[front : front + 512]) - codes[0]
                slots = slots[slots > 0]
                fits = np.flatnonzero(~used[slots[:, None] + codes].any(axis=1))
                if len(fits):
                    b = int(slots[fits[0]])
                else:
                    front += 256  # what is left behind goes to nodes with one child
            base[state] = b
            used[b + codes] = True
            check[b + codes] = state
            if b + codes[0] == free_from:
                free_from += int(np.argmin(used[free_from:]))
            for c, x, y in children:
                heapq.heappush(heap, (x - y, b + c, x, y, depth + 1))
        end = int(np.flatnonzero(used)[-1]) + 257
        self.base, self.check, self.value = base[:end].copy(), check[:end].copy(), value[:end].copy()

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Next states; -1 where there is none."""
        to = self.base[state] + byte
        return np.where(self.check[to] == state, to, -1)


class Tokenizer:
    """Encodes units of bytes to piece ids by the best sum of scores; ties go to the longer last piece.

    Only normal and user-defined pieces match text. A character that no piece matches costs the least
    score less UNKNOWN_PENALTY, and is spelled in byte pieces (or as the unknown id without those).
    """

    def __init__(self, vocabulary: Vocabulary):
        v = self.vocabulary = vocabulary
        matched = [i for i, k in enumerate(v.kinds) if k in (NORMAL, USER) and v.pieces[i]]
        self.trie = DoubleArray([v.pieces[i] for i in matched], matched)
        normal = v.kinds == NORMAL
        self.unknown_score = (v.scores[normal].min() if normal.any() else 0.0) - UNKNOWN_PENALTY
        self.unknown = int(np.flatnonzero(v.kinds == UNKNOWN)[0]) if (v.kinds == UNKNOWN).any() else 0
        by_byte = {int(v.pieces[i][3:5], 16): i for i, k in enumerate(v.kinds) if k == BYTE}
        self.byte_ids = np.array([by_byte.get(b, -1) for b in range(256)]) if len(by_byte) == 256 else None
        self.longest = max((len(v.pieces[i]) for i in matched), default=1)
        self._lists = self._surfaces = None
        text = [b if k in (NORMAL, USER) else b"" for b, k in zip(v.pieces, v.kinds)]
        for b, i in by_byte.items():
            text[i] = bytes([b])
        self.surface = text

    def viterbi(self, units: list[bytes]) -> list[list[int]]:
        """Ids of each unit."""
        flat, sizes = self.segment(units)
        ends = np.cumsum(sizes).tolist()
        flat = flat.tolist()
        return [flat[x:y] for x, y in zip([0, *ends], ends)]

    def segment(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units in a row, number of ids by unit); units of up to _LONG bytes advance together, longer ones one by one."""
        length = np.fromiter(map(len, units), np.int64, len(units))
        long = length > _LONG
        few = [u for u in units if len(u) <= _LONG] if long.any() else units
        made = [self._many(few[lo : lo + _BLOCK]) for lo in range(0, len(few), _BLOCK)]
        flat, sizes = (np.concatenate([x[i] for x in made]) if made else np.empty(0, np.int64) for i in (0, 1))
        if not long.any():
            return flat, sizes
        ones = [self._one(units[i]) for i in np.flatnonzero(long).tolist()]
        every = np.empty(len(units), np.int64)
        every[~long], every[long] = sizes, [len(x) for x in ones]
        of_long = np.repeat(long, every)
        out = np.empty(len(of_long), np.int64)
        out[~of_long], out[of_long] = flat, np.fromiter((i for x in ones for i in x), np.int64)
        return out, every

    def _many(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their numbers. Places are those of the units in one row of bytes, each with an end behind it that no piece holds."""
        n = len(units)
        size = np.fromiter(map(len, units), np.int64, n)
        first = np.cumsum(size + 1) - size - 1
        end = first + size
        text = np.frombuffer(b"\0".join(units) + b"\0", np.uint8).astype(np.int16)
        text[end] = 256
        depth = np.arange(len(text)) - np.repeat(first, size + 1)
        begins = np.flatnonzero(((text & 0xC0) != 0x80) & (text < 256))
        # all pieces that match somewhere: every place walks through the trie at once
        start, state, at = begins, np.zeros(len(begins), np.int64), begins
        starts, ends, found = [], [], []
        while len(start):
            state = self.trie.step(state, text[at])
            live = np.flatnonzero(state >= 0)
            start, state, at = start[live], state[live], at[live] + 1
            ids = self.trie.value[state]
            hit = np.flatnonzero(ids >= 0)
            starts.append(start[hit])
            ends.append(at[hit])
            found.append(ids[hit])
        s, e, ids = (np.concatenate([np.empty(0, np.int64), *x]) for x in (starts, ends, found))
        # a character is unknown where no piece of its own is better anyway
        c = text[begins]
        span = np.where(c < 0x80, 1, np.where(c < 0xE0, 2, np.where(c < 0xF0, 3, 4)))
        close = np.minimum(begins + span, np.repeat(end, size + 1)[begins])
        own = np.zeros(len(text), np.int64)
        own[begins] = close
        scores = self.vocabulary.scores
        sure = s[(own[s] == e) & (scores[ids] > self.unknown_score + 1)]
        own[sure] = 0
        open_ = np.flatnonzero(own[begins])
        us, ue = begins[open_], close[open_]
        # ways in the order of their starts within the units; the unknown one goes first and loses ties
        order, u_order = np.argsort(depth[s].astype(np.uint8), kind="stable"), np.argsort(depth[us].astype(np.uint8), kind="stable")
        s, e, ids, us, ue = s[order], e[order], ids[order], us[u_order], ue[u_order]
        cost = scores[ids]
        cuts, u_cuts = (np.append(0, np.cumsum(np.bincount(depth[x], minlength=_LONG))).tolist() for x in (s, us))
        best, way = np.full(len(text), -np.inf), np.full(len(text), -1, np.int64)
        best[first] = 0
        for lo, hi, u_lo, u_hi in zip(cuts, cuts[1:], u_cuts, u_cuts[1:]):
            if u_hi > u_lo:
                reached, to = best[us[u_lo:u_hi]] + self.unknown_score, ue[u_lo:u_hi]
                better = np.flatnonzero(reached > best[to])
                to = to[better]
                best[to], way[to] = reached[better], len(s) + u_lo + better
            if hi > lo:
                reached, to = best[s[lo:hi]] + cost[lo:hi], e[lo:hi]
                better = np.flatnonzero(reached > best[to])
                to = to[better]
                best[to], way[to] = reached[better], lo + better
        # units whose end no way reaches (bytes that are no text) are unknown as a whole
        lost = np.flatnonzero((way[end] < 0) & (size > 0))
        way[end[lost]] = len(s) + len(us) + np.arange(len(lost))
        s, e = np.concatenate([s, us, first[lost]]), np.concatenate([e, ue, end[lost]])
        ids = np.concatenate([ids, np.full(len(us) + len(lost), -1)])
        # back from all ends at once
        unit = np.flatnonzero(size)
        at, taken, of, nth = end[unit], [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        while len(unit):
            w = way[at]
            taken.append(w)
            of.append(unit)
            nth.append(np.full(len(w), len(nth)))
            at = s[w]
            left = np.flatnonzero(at > first[unit])
            unit, at = unit[left], at[left]
        taken, of, nth = np.concatenate(taken), np.concatenate(of), np.concatenate(nth)
        sizes = np.bincount(of, minlength=n)
        ways = np.empty(len(taken), np.int64)
        ways[np.cumsum(sizes)[of] - nth] = taken
        out = ids[ways]
        if self.byte_ids is None:
            out[out < 0] = self.unknown
        elif (out < 0).any():
            wide = np.where(out < 0, e[ways] - s[ways], 1)
            sizes = np.bincount(np.repeat(np.arange(n), sizes), weights=wide, minlength=n).astype(np.int64)
            spelled = np.repeat(out < 0, wide)
            place = np.repeat(s[ways] - (np.cumsum(wide) - wide), wide) + np.arange(len(spelled))
            out = np.repeat(out, wide)
            out[spelled] = self.byte_ids[text[place[spelled]]]
        return out, sizes

    def _read(self, unit: bytes, back, piece) -> list[int]:
        parts, e = [], len(unit)
        while e > 0:
            s = back[e]
            parts.append((piece[e], s, e))
            e = s
        ids: list[int] = []
        for p, s, e in reversed(parts):
            if p >= 0:
                ids.append(p)
            elif self.byte_ids is None:
                ids.append(self.unknown)
            else:
                ids += self.byte_ids[np.frombuffer(unit[s:e], np.uint8)].tolist()
        return ids

    def _one(self, unit: bytes) -> list[int]:
        if self._lists is None:
            self._lists = self.trie.base.tolist(), self.trie.check.tolist(), self.trie.value.tolist(), self.vocabulary.scores.tolist()
        base, check, value, scores = self._lists
        n, low = len(unit), float("-inf")
        best, back, piece = [low] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        for s in range(n):
            c = unit[s]
            if best[s] == low or c & 0xC0 == 0x80:
                continue
            e = min(n, s + (1 if c < 0x80 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4))
            if best[s] + self.unknown_score > best[e]:
                best[e], back[e], piece[e] = best[s] + self.unknown_score, s, -1
            state = 0
            for at in range(s, min(n, s + self.longest)):
                to = base[state] + unit[at]
                if check[to] != state:
                    break
                state = to
                p = value[state]
                if p >= 0 and best[s] + scores[p] > best[at + 1]:
                    best[at + 1], back[at + 1], piece[at + 1] = best[s] + scores[p], s, p
        return self._read(unit, back, piece)

    def decode(self, ids) -> str:
        """The text of piece ids: byte pieces as bytes, markers as spaces, the first space dropped; control pieces are nothing."""
        surface = self.surface
        text = b"".join(map(surface.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text[:1] == " " else text

    def decode_rows(self, ids: np.ndarray, starts: np.ndarray) -> list[bytes]:
        """The bytes that ``decode`` makes a text of, by row; row i has the ids from starts[i] on, up to starts[i + 1]."""
        import pyarrow as pa

        if self._surfaces is None:
            self._surfaces = pa.array(self.surface, pa.large_binary())
        made = self._surfaces.take(pa.array(ids))
        _, at, data = made.buffers()
        cuts = np.frombuffer(at, np.int64)[made.offset + starts].tolist() if len(ids) else [0] * len(starts)
        data = memoryview(data or b"")
        rows = [bytes(data[x:y]).replace(_MARK, b" ") for x, y in zip(cuts, cuts[1:])]
        return [r[1:] if r[:1] == b" " else r for r in rows]


@lru_cache(2)
def tokenizer(path: str) -> Tokenizer:
    """By path, once a Python worker; the tables are fixed by the file, not by the data."""
    with open(path, "rb") as f:
        return Tokenizer(Vocabulary.load(f.read()))


def marked(text: str | bytes) -> bytes:
    """The marked form of a text. A marker that stands in the text itself reads back as a space."""
    raw = text.encode("utf-8", "replace") if isinstance(text, str) else text
    return _MARK + raw.replace(b" ", _MARK) if raw else b""


class BatchEncoder:
    """Ids of texts, with the ids of the units seen lately at hand (bounded)."""

    def __init__(self, tok: Tokenizer, limit: int = 600_000):
        self.tok, self.limit = tok, limit
        self._clear()

    def _clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.flat, self.at, self.size = np.empty(1 << 16, np.int32), np.empty(1 << 16, np.int64), np.empty(1 << 16, np.int64)
        self.n_flat = 0

    def _numbers(self, units: list[bytes]) -> np.ndarray:
        """Numbers of distinct units; those not seen yet are segmented."""
        number = np.fromiter(map(self.number.get, units, repeat(-1)), np.int64, len(units))
        missing = np.flatnonzero(number < 0)
        if not len(missing):
            return number
        if self.number and len(self.number) + len(missing) > self.limit:
            self._clear()
            missing = np.arange(len(units))
        new = [units[i] for i in missing.tolist()]
        ids, sizes = self.tok.segment(new)
        n = len(self.number)
        number[missing] = np.arange(n, n + len(new))
        self.number.update(zip(new, range(n, n + len(new))))
        self.at, self.size = _room(self.at, n, len(new)), _room(self.size, n, len(new))
        self.at[n : n + len(new)], self.size[n : n + len(new)] = self.n_flat + np.cumsum(sizes) - sizes, sizes
        self.flat = _room(self.flat, self.n_flat, len(ids))
        self.flat[self.n_flat : self.n_flat + len(ids)] = ids
        self.n_flat += len(ids)
        return number

    def __call__(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, where each text's begin and the last one's end); ``texts``: an Arrow array of binary, without nulls."""
        import pyarrow as pa
        import pyarrow.compute as pc

        odd = pc.or_(pc.or_(pc.match_substring(texts, b"  "), pc.match_substring(texts, _MARK)), pc.or_(pc.starts_with(texts, b" "), pc.equal(pc.binary_length(texts), 0)))
        odd = odd.to_numpy(zero_copy_only=False)
        # where no two spaces meet, the units are the words between spaces, each behind one marker
        plain = pc.split_pattern(texts.filter(pa.array(~odd)) if odd.any() else texts, b" ")
        words = plain.flatten().dictionary_encode()
        sizes = np.empty(len(texts), np.int64)
        sizes[~odd] = plain.value_lengths().to_numpy()
        code, units = words.indices.to_numpy(), [_MARK + w for w in words.dictionary.to_pylist()]
        if odd.any():
            found = [_UNIT.findall(marked(t)) for t in texts.filter(pa.array(odd)).to_pylist()]
            sizes[odd] = [len(f) for f in found]
            place = {u: i for i, u in enumerate(units)}
            others = np.array([place.setdefault(u, len(place)) for f in found for u in f], np.int64)
            units, of_odd, plain_code = list(place), np.repeat(odd, sizes), code
            code = np.empty(len(of_odd), np.int64)
            code[~of_odd], code[of_odd] = plain_code, others
        number = self._numbers(units)[code]
        size = self.size[number]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        where = np.repeat(self.at[number] - (ends - size), size)
        where += np.arange(total)
        return self.flat[where], np.append(0, ends)[np.append(0, np.cumsum(sizes))]


def _room(x: np.ndarray, used: int, more: int) -> np.ndarray:
    """``x`` with room for ``more`` behind the used ones, at least doubled where it is too small."""
    if used + more <= len(x):
        return x
    out = np.empty(max(2 * len(x), used + more), x.dtype)
    out[:used] = x[:used]
    return out


def _encode(path: str, extra: bool):
    def run(batches):
        import pyarrow as pa

        tok = tokenizer(path)
        enc = BatchEncoder(tok)
        is_byte = tok.vocabulary.kinds == BYTE
        for batch in batches:
            texts = batch.column("text").fill_null("").cast(pa.binary())
            for lo, hi in chunks_of(batch.column("text"), _CHUNK):
                part = texts.slice(lo, hi - lo)
                ids, at = enc(part)
                columns = {"doc_id": batch.column("doc_id").slice(lo, hi - lo), "ids": pa.ListArray.from_arrays(at.astype(np.int32), ids), "n_tokens": np.diff(at)}
                if extra:
                    columns["n_byte_tokens"] = np.diff(np.searchsorted(np.flatnonzero(is_byte[ids]), at))
                    columns["round_trip"] = [x == t.replace(_MARK, b" ") for x, t in zip(tok.decode_rows(ids, at), part.to_pylist())]
                yield pa.RecordBatch.from_pydict(columns)

    return run


def encode(docs: DataFrame, path: str = VOCABULARY, check: bool = True) -> DataFrame:
    """``docs`` (doc_id, text) as doc_id, ids array<int>, n_tokens, and with ``check`` n_byte_tokens, round_trip.

    Whole texts; null and empty texts have no ids. ``path`` names the vocabulary on every executor.
    round_trip says that decoding gives the text back (markers that stood in it as spaces).
    """
    schema = "doc_id long, ids array<int>, n_tokens long" + (", n_byte_tokens long, round_trip boolean" if check else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encode(path, check), schema)


def _typed(run):
    def typed(batches):
        for out in run(b.astype({"doc_id": "Int64"}) for b in batches):
            yield out

    return typed


def decode(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``encoded`` (doc_id, ids) as doc_id, text; null ids give an empty text."""

    def run(batches):
        tok = tokenizer(path)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": [tok.decode(x) if x is not None else "" for x in pdf["ids"]]})

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInPandas(_typed(run), "doc_id long, text string")


def available(path: str = VOCABULARY) -> bool:
    return os.path.exists(path)
