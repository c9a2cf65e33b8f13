"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir); a temporary one in local mode only."""
    own = spark.conf.get("spark.checkpoint.dir", None)
    if own:
        return own.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session is gone, and its scratch folder is the cluster's to clear
        pass


#: The tables that this driver wrote and hasn't removed.
_ours: dict[str, SparkSession] = {}


def cut(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: later reads survive lost executors, and the work is done once.

    The table goes when the driver ends, if drop_cut() didn't remove it before. A driver that is killed leaves its tables
    behind, under names that begin with tidemark- and its session's application.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    _ours[path] = spark
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(*tables: DataFrame) -> None:
    """Removes tables that cut() wrote and that nothing reads any more; others are left alone."""
    for df in tables:
        for f in df.inputFiles()[:1]:
            for path in [p for p in _ours if f"/{p.rpartition('/')[2]}/" in f]:
                remove(_ours.pop(path), path)


@atexit.register
def _drop_all() -> None:
    for path, spark in list(_ours.items()):
        remove(spark, path)
