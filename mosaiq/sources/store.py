"""The guarded result store: results by pair, an index of all of them, failures, manifests.

Paths may be on any file system that Spark reaches: listing and renaming go through Hadoop's. A table is
replaced by writing it beside the old one and swapping names, so a reader never meets half a table.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class StoreError(ValueError):
    """A write that the store refuses; nothing has been written."""


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def swap_in(spark: SparkSession, new: str, path: str) -> None:
    """``new`` takes the place of ``path``; if the second rename fails the old table is put back."""
    fs, target = _fs(spark, path)
    _, fresh = _fs(spark, new)
    _, aside = _fs(spark, f"{path}.old")
    recover(spark, path)
    if fs.exists(target) and not fs.rename(target, aside):
        raise StoreError(f"{path} can't be moved aside")
    if not fs.rename(fresh, target):
        if fs.exists(aside):
            fs.rename(aside, target)
        raise StoreError(f"{new} can't take the place of {path}")
    fs.delete(aside, True)


def recover(spark: SparkSession, path: str) -> None:
    """Ends a swap that was interrupted: with the new table in place the old one goes, without it the old one returns."""
    fs, target = _fs(spark, path)
    _, aside = _fs(spark, f"{path}.old")
    if fs.exists(aside):
        if fs.exists(target):
            fs.delete(aside, True)
        else:
            fs.rename(aside, target)


def replace(df: DataFrame, path: str) -> None:
    """``df`` becomes the table at ``path``, of which it may itself be read."""
    new = f"{path}.new-{uuid.uuid4().hex}"
    df.write.parquet(new)
    swap_in(df.sparkSession, new, path)


def load(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at ``path`` with the columns of ``schema`` (null where older rows lack one), or an empty one."""
    recover(spark, path)
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``old`` whose key ``new`` hasn't, and all of ``new``; columns of either side are kept."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def save_results(results: DataFrame, root: str, key: str = "pair_id", overwrite: bool = False) -> None:
    """Adds ``results`` to ``root``/pairs and rebuilds the index from all stored pairs.

    Refused before anything is written: a null key, a key twice in the batch, and, unless ``overwrite``, a
    key already stored. With ``overwrite`` only the partitions of the batch are replaced.
    """
    spark, path = results.sparkSession, f"{root}/pairs"
    twice = [r[0] for r in results.groupBy(key).count().filter(f"`count` > 1 or {key} is null").select(key).limit(5).collect()]
    if twice:
        raise StoreError(f"null or repeated keys in the batch: {twice}")
    if not overwrite and exists(spark, path):
        clash = [r[0] for r in results.select(key).join(spark.read.parquet(path).select(key), key, "left_semi").limit(5).collect()]
        if clash:
            raise StoreError(f"already stored: {clash}")
    results.repartition(key).write.mode("overwrite" if overwrite else "append").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
    reindex(spark, root, key)


def reindex(spark: SparkSession, root: str, key: str = "pair_id", failed: int = 0, force: bool = False) -> bool:
    """Rebuilds ``root``/index from all stored pairs; arrays stay in the store.

    The old index is kept, and False returned, if ``failed`` pairs couldn't be read, fewer rows came than
    the old index has, and not ``force``.
    """
    pairs, index = spark.read.parquet(f"{root}/pairs"), f"{root}/index"
    flat = pairs.select(*[c for c, t in pairs.dtypes if not t.startswith(("array", "map", "struct"))])
    if failed and not force and exists(spark, index) and flat.count() < spark.read.parquet(index).count():
        return False
    replace(flat.orderBy(key), index)
    return True


#: Columns that come first in the failures table; others follow by name.
FAILURE_COLUMNS = ("pair_id", "status", "error")


def save_failures(failures: DataFrame, root: str) -> None:
    """Appends to ``root``/failures; later batches may bring columns of their own."""
    extra = sorted(set(failures.columns) - set(FAILURE_COLUMNS))
    first = [F.col(c) if c in failures.columns else F.lit(None).cast("string").alias(c) for c in FAILURE_COLUMNS]
    failures.select(*first, *extra).write.mode("append").parquet(f"{root}/failures")


def load_failures(spark: SparkSession, root: str) -> DataFrame:
    path = f"{root}/failures"
    if not exists(spark, path):
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in FAILURE_COLUMNS))
    return spark.read.option("mergeSchema", "true").parquet(path)


def documents_of(df: DataFrame, name: str = "document") -> DataFrame:
    """One JSON text a row; NaN becomes null, nulls are written."""
    plain = [F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    return df.select(F.to_json(F.struct(*plain), {"ignoreNullFields": "false"}).alias(name))


def violations(config: str, required: dict[str, type]) -> list[str]:
    """All that is wrong with a JSON configuration at once: absent keys and values of the wrong type."""
    try:
        found = json.loads(config)
    except ValueError as error:
        return [f"no JSON: {error}"]
    if not isinstance(found, dict):
        return ["no JSON object"]
    return [f"{k}: absent" if k not in found else f"{k}: not {t.__name__}" for k, t in required.items() if not isinstance(found.get(k), t)]
