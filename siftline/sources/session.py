"""Session settings."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(name: str = "siftline", master: str | None = None, **settings) -> SparkSession:
    """Session with adaptive execution, skew handling and UTC times.

    Name ``spark.checkpoint.dir`` (a folder all executors reach) and, for large tables, enough
    ``spark.sql.shuffle.partitions``; adaptive execution merges what is too many.
    """
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    for key, value in {**base, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
