"""Session set-up shared by tests, the bench and stand-alone use."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings that the engine's results rest on; the rest is left to the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str = "local[8]", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the engine's settings."""
    builder = SparkSession.builder.master(master).appName("kinespark")
    builder = builder.config("spark.sql.shuffle.partitions", str(partitions)).config("spark.driver.memory", memory)
    builder = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
