"""The corpus pipeline: quality rules, line dedup, near-duplicates, mixing, SentencePiece ids.

``STAGES`` lists (name, function) in order; each takes (spark, docs, sf_dir) and gives a DataFrame that
is written as Parquet and read again as the next one's docs. All but the last give the columns of
documents. Learned rules, drawn copies and token ids have no SQL, so ORACLE_SQL is None; the tests hold
each stage against what its operator gives, and the operators against brute force. Null texts hold no word: the quality
rules reject them. Repeated rows are judged alike, and one of them is left after the near-duplicates. An empty
table goes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mosaiq.llm import line_dedup, minhash, mixing, pieces, quality_rules
from mosaiq.llm.common import read, stored


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules, learned from ``labels``, don't reject."""
    return quality_rules.keep_good(docs, read(spark, sf_dir, "labels"))


def first_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less every line that repeats an earlier one; n_chars follows the text."""
    from pyspark.sql import functions as F

    out = line_dedup.keep_first(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate component (five words, similarity 0.8)."""
    return minhash.keep_one(docs, width=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for every copy that the mix takes."""
    return mixing.repeated(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, n_byte_tokens and round_trip (decoding gives the text back) of every row."""
    return pieces.encode(docs)


STAGES = [("quality rules", good_documents), ("line dedup", first_lines), ("near-duplicates", one_of_each), ("mixing", mixed), ("token ids", token_ids)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is kept in the shared folder for the next."""
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        docs = stored(out)
    return docs


QUERIES = {"pipeline": run}
