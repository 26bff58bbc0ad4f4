"""Listings and container formats of label files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.operators.outcomes import ladder


def listing(spark: SparkSession, root: str, globs: list[str], content: bool = True) -> DataFrame:
    """(path, length[, content]) of the regular files below ``root`` that match one of ``globs``, each once.

    Without ``content`` the bytes are not read: the reader prunes the column.
    """
    every = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "{" + ",".join(globs) + "}").load(root)
    return every.select("path", "length", *(["content"] if content else []))


def label_format(content: Column) -> Column:
    """``pds4``, ``pds3``, ``isis3`` or null by the first 2048 bytes, whatever the file's name says."""
    head = F.ltrim(F.decode(F.substring(content, 1, 2048), "ISO-8859-1"))
    return ladder(
        ("pds4", head.startswith("<?xml") | head.contains("Product_Observational")),
        ("pds3", head.contains("PDS_VERSION_ID")),
        ("isis3", head.rlike(r"(?i)Object\s*=\s*IsisCube")),
        otherwise=None,
    )


def without_label(data: DataFrame, labels: DataFrame, referenced: DataFrame | None = None) -> DataFrame:
    """Data files (path) that have no label of the same folder and stem and that no label names.

    Stems compare without case. Both sides are anti-joined by key; nothing is collected.
    """

    def key(df: DataFrame) -> DataFrame:
        folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
        stem = F.lower(F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", ""))
        return df.withColumn("_folder", folder).withColumn("_stem", stem)

    left = key(data).join(key(labels).select("_folder", "_stem"), ["_folder", "_stem"], "left_anti")
    if referenced is not None:
        left = left.join(referenced.select("path"), "path", "left_anti")
    return left.drop("_folder", "_stem")
