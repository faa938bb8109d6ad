"""Session factory with the settings that the package relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "folium", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution and Arrow; other settings stay the cluster's or conf's."""
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
        # state of streams on the executors' disks, with its changes in the checkpoint
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
    for k, v in (settings | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
