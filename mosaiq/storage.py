"""Tables between jobs, kept in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset, a temporary one if the master is local, else an error."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="mosaiq-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found


def _file_system(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def new_path(spark: SparkSession) -> str:
    """A fresh path below the application's own folder, which goes when the application ends."""
    folder = f"{shared_dir(spark)}/mosaiq/{spark.sparkContext.applicationId}"
    fs, path = _file_system(spark, folder)
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return f"{folder}/{uuid.uuid4().hex}"


#: Spark's own setting: whether a query's shuffle files go as soon as it ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet and read again: cuts lineage and plan, survives lost executors.

    The shuffle files of the write go with its end, not at some later garbage collection of the driver.
    """
    spark = df.sparkSession
    path, before = new_path(spark), spark.conf.get(_CLEAN)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files that ``stored`` wrote for ``df``; nothing may read it afterwards."""
    spark = df.sparkSession
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        fs, path = _file_system(spark, folder)
        fs.delete(path, True)
