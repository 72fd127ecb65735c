"""Landed news files as a stream: each file is taken once, and a batch's rows go through the batch transforms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def take_up(spark: SparkSession, folder: str, schema: StructType, transform: Callable[[DataFrame], DataFrame], out: str, state: str, files_per_batch: int = 100) -> int:
    """Takes up the Parquet files of folder that are new since the last call and appends what transform makes of them to out. A batch
    that is repeated after a failure replaces its own folder, so rows are there once. Returns the number of batches."""
    taken = []

    def batch(df: DataFrame, number: int) -> None:
        transform(df).write.mode("overwrite").parquet(f"{out}/batch={number}")
        taken.append(number)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", state).foreachBatch(batch).start().awaitTermination()
    return len(taken)
