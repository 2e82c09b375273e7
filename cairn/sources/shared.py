"""Folders that the driver and all executors see, for tables between jobs and for stream checkpoints."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession, tag: str) -> str:
    """A fresh path below spark.checkpoint.dir, removed when the process ends. A local session without that setting gets a
    temporary folder; on a cluster it is an error, as each executor would write to its own disk."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="cairn-")
    path = f"{where.rstrip('/')}/cairn/{tag}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def kept(df: DataFrame, tag: str) -> DataFrame:
    """df written as Parquet into a fresh folder and read back: what made it is not run again."""
    path = folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filesystem(spark: SparkSession, path: str):  # noqa: ANN201
    """Hadoop's file system of a path, and the path as it wants it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


@atexit.register
def _remove() -> None:
    for spark, path in _made:
        try:
            fs, p = filesystem(spark, path)
            fs.delete(p, True)
        except Exception:  # noqa: BLE001  the session may be gone
            return
