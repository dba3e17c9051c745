"""Resumable batches: files arrive, each is worked on once, a broken run goes on where it stopped."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def run_available(spark: SparkSession, source: str, schema: str, work: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, files: int = 1) -> None:
    """Work through all files of ``source`` not yet done and append to ``sink``.

    Each batch is written under its own number, so that a batch repeated after a
    failure replaces itself: every input row counts exactly once.
    """

    def batch(df: DataFrame, number: int) -> None:
        work(df).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(sink)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def remaining(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in the sink yet."""
    return todo.join(done.select(key), key, "left_anti")
