"""What the operators share: tables, storage in the shared folder, tokens, components of a link graph."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.operators.graph import groups
from mosaiq.storage import discard, new_path, shared_dir, stored

__all__ = ["discard", "new_path", "shared_dir", "stored"]

#: The six ASCII white-space characters that separate words.
SPACES = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bytes_of(text) -> bytes:
    """UTF-8 of a text; null and whatever is no string count as empty, lone surrogates are replaced."""
    return text.encode("utf-8", "replace") if isinstance(text, str) else b""


def words(text) -> list[bytes]:
    """Words of a text, A-Z lower-cased: bytes.lower and bytes.split act on exactly A-Z and the six spaces."""
    return bytes_of(text).lower().split()


def word_rows(texts):
    """(words of all texts in a row, number of words by text) as ``words`` gives them; ``texts``: an Arrow array of strings, null as empty."""
    import pyarrow.compute as pc

    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(texts.fill_null(""))))
    found, sizes = lists.flatten(), lists.value_lengths().to_numpy().astype(np.int64)
    empty = pc.equal(pc.binary_length(found), 0).to_numpy(zero_copy_only=False)  # what an empty text is split into
    if empty.any():
        sizes -= np.bincount(np.repeat(np.arange(len(sizes)), sizes)[empty], minlength=len(sizes))
        found = found.filter(pc.not_equal(pc.binary_length(found), 0))
    return found, sizes


def chunks_of(texts, size: int):
    """Ranges of rows of an Arrow array of texts whose texts begin within the same ``size`` bytes."""
    import pyarrow.compute as pc

    length = pc.binary_length(texts.fill_null("")).to_numpy().astype(np.int64)
    cuts = np.flatnonzero(np.diff((np.cumsum(length) - length) // size, prepend=-1, append=-1)).tolist()
    return zip(cuts, cuts[1:])


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64), vectorised."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x += np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Lexicon:
    """64-bit hashes of words, remembered for the words seen most recently (bounded)."""

    def __init__(self, limit: int = 400_000):
        import xxhash

        self._hash, self._seen, self._limit = xxhash.xxh3_64_intdigest, {}, limit

    def __call__(self, tokens: list[bytes]) -> np.ndarray:
        seen = self._seen
        if len(seen) > self._limit:
            seen.clear()
        try:
            return np.fromiter(map(seen.__getitem__, tokens), np.uint64, len(tokens))
        except KeyError:
            h = self._hash
            for w in set(tokens):
                if w not in seen:
                    seen[w] = h(w)
            return np.fromiter(map(seen.__getitem__, tokens), np.uint64, len(tokens))


def sample_by_hash(df: DataFrame, key: str, bound: int, salt: int = 0) -> DataFrame:
    """At most ``bound`` rows, those of the smallest hash of ``key``: the same rows in every run.

    A count gives the hash below which some more than ``bound`` rows lie (by six deviations), so that only those are sorted.
    """
    h = F.xxhash64(F.col(key), F.lit(salt))
    n = df.count()
    if n > 2 * bound:
        share = (bound + 6 * bound**0.5 + 36) / n
        df = df.filter(h < int(-(2**63) + share * 2.0**64))
    return df.orderBy(h, F.col(key)).limit(bound)


def most_frequent(counts: DataFrame, word: str, n: str, bound: int) -> DataFrame:
    """The rows of ``counts`` with the largest numbers, at most ``bound``: all from the least number on that leaves no more.

    The threshold comes from a histogram: one bin a number up to 4096, above that 64 bins a doubling.
    """
    bin_of = F.when(F.col(n) <= 4096, F.col(n)).otherwise(4096 + F.floor((F.log2(n) - 12) * 64) + 1).cast("long")
    bins = counts.groupBy(bin_of.alias("bin")).agg(F.count("*").alias("rows"), F.min(n).alias("least")).collect()
    kept, least = 0, None
    for r in sorted(bins, key=lambda r: -r["bin"]):
        if kept + r["rows"] > bound:
            break
        kept, least = kept + r["rows"], r["least"]
    return counts.filter(F.col(n) >= F.lit(least)) if least is not None else counts.limit(0)


def bucket_of(key: Column, modulus: int) -> Column:
    """CRC-32 of the decimal text of ``key`` modulo ``modulus``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % modulus


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", **how) -> DataFrame:
    """(node, comp): the smallest node that each node of an undirected edge list can reach."""
    return groups(edges.select(F.col(a).alias("a"), F.col(b).alias("b")), **how).select(F.col("id").alias("node"), F.col("first").alias("comp"))
