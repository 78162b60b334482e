"""Folders that the driver and the executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below spark.checkpoint.dir, or below an own temporary folder on a local master where that is unset; it goes when the driver ends."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        top = "file://" + tempfile.mkdtemp(prefix="echotrace-")
    out = f"{top.rstrip('/')}/echotrace/{name}-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, out)
    return out


def kept(df: DataFrame, name: str) -> DataFrame:
    """The rows from a table in a shared folder, for what is read several times; the shuffle files they came from go when the write ends."""
    spark = df.sparkSession
    folder, clean = shared_folder(spark, name), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(clean)
    spark.conf.set(clean, "true")
    try:
        df.write.parquet(folder)
    finally:
        spark.conf.set(clean, before)
    return spark.read.schema(df.schema).parquet(folder)


def _drop(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the JVM may have gone first
        pass
