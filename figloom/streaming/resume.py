"""The resumable stage as a stream: a file source, a checkpoint, and one commit per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def run_available(spark: SparkSession, source: str, schema: str, stage: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, good: str = "error is null", files_per_batch: int = 100) -> None:
    """Process the files in ``source`` that no earlier call has, then stop.

    Each micro-batch is written under its number with overwrite, so a batch repeated after a failure replaces itself.
    Read the sink with ``spark.read.parquet(sink)``; the number is the column ``epoch``.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        stage(batch).where(good).write.mode("overwrite").parquet(f"{sink}/epoch={epoch}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
