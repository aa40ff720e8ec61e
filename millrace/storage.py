"""Shared work folder and materialised intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share.

    The cluster names it in ``spark.checkpoint.dir``.  Where that is unset the
    warehouse folder is used on a cluster, and a temporary folder in local mode,
    where driver and executors are one process.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.startswith("local"):
            base = "file://" + tempfile.gettempdir() + "/checkpoints"
        else:
            base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    return base.rstrip("/") + "/tables"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there.

    Unlike a local checkpoint the files outlive the executors that wrote them.  :func:`drop`
    removes them when nothing reads the table any more.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Remove the files of tables that :func:`materialise` gave; what was written from them stays."""
    for df in tables:
        spark, path = df.sparkSession, df.__dict__.pop("_written_at", None)
        if path:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
