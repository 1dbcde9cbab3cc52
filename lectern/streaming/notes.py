"""The note transforms over arriving files, and attempts as a stream (extensions; same semantics as in batch)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def note_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Rows (doc_id, text) of Parquet files as they arrive."""
    return spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", max_files).parquet(path)


def transform_stream(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Runs a batch transform on every micro-batch and appends its rows, once per batch id."""

    def write(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def distinct_attempts(attempts: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Attempt events (workflow_id, stage, attempt, ts) without redeliveries, within a watermark."""
    return attempts.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["workflow_id", "stage", "attempt"])
