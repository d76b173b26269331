"""A session with the settings that this library is measured with."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.ui.enabled": "false",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def session(master: str = "local[*]", partitions: int = 8, **more: str) -> SparkSession:
    b = SparkSession.builder.master(master).appName("tokenpress").config("spark.sql.shuffle.partitions", partitions)
    for k, v in (SETTINGS | {k.replace("_", "."): v for k, v in more.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()
