"""Processing files as they arrive and going on after a stop."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def process_new(spark: SparkSession, source: str, schema: str, transform: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> None:
    """Apply transform to the parquet files in source that no earlier call saw, and write the results to sink.

    transform works on rows or on what a batch holds. Each batch goes to a folder of its own that a repeated try replaces, so a batch that
    was cut off by a failure is written once.
    """

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
