"""Session factory: UTC, ANSI, adaptive execution, shuffle partitions by the size of the input."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "cairn", input_gb: float | None = None, **conf: str) -> SparkSession:
    """A session with the engine's settings. input_gb sizes the shuffles at about 128 MB a partition; the master and
    memory are left to the launcher."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if input_gb is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(max(8, int(input_gb * 8))))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
