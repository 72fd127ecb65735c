"""Session settings the engine relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: ANSI stays on; times are UTC; adaptive execution splits skewed joins and merges small partitions.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g", **more: str) -> SparkSession:
    """A single-JVM session for tests and benchmarks; a cluster brings its own."""
    os.environ.setdefault("TZ", "UTC")
    builder = SparkSession.builder.master(f"local[{cores}]").appName("panelwright")
    for key, value in {**SETTINGS, "spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.driver.memory": memory, **more}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
