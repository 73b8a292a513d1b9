"""A session with the settings the library is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "palimpsest", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution with skewed joins dealt anew; ``conf`` wins. On a cluster set spark.checkpoint.dir to a shared folder."""
    builder = SparkSession.builder.appName(name)
    builder = builder.master(master) if master else builder
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
    return builder.config(map=settings | conf).getOrCreate()
