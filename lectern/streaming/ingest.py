"""Incremental ingestion: duplicates dropped within a watermark, batches merged into a table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.merge import upsert_articles
from lectern.session import checkpoint_dir


def new_folder(spark: SparkSession, name: str) -> str:
    return os.path.join(checkpoint_dir(spark), f"{name}-{os.urandom(6).hex()}")


def without_repeats(stream: DataFrame, keys: list[str], event_time: str, delay: str) -> DataFrame:
    """Rows whose key has not been seen within the delay; state older than the watermark is dropped."""
    timed = stream.withColumn(event_time, F.col(event_time).cast("timestamp"))
    return timed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def run_available(stream: DataFrame, write: Callable[[DataFrame, int], None], mode: str, checkpoint: str) -> None:
    """Process what the source holds now and stop."""
    query = (
        stream.writeStream.foreachBatch(write)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def batch_writer(folder: str) -> Callable[[DataFrame, int], None]:
    """Each batch into its own folder, so a batch that runs again replaces what it wrote before."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(folder, f"batch={batch_id}"))

    return write


def versions(folder: str) -> Callable[[int], str]:
    return lambda number: os.path.join(folder, f"version={number:012d}")


def article_merger(
    folder: str, fetched_at: Callable[[], object], address: str = "article_url"
) -> Callable[[DataFrame, int], None]:
    """Merge of article batches: batch ``n`` reads version ``n`` and writes version ``n + 1``.

    A batch that runs again reads the same version and rewrites the same one, so the merge is applied
    once. Version 0 is the table to start from.
    """
    path = versions(folder)

    def write(batch: DataFrame, batch_id: int) -> None:
        stored = batch.sparkSession.read.parquet(path(batch_id))
        upsert_articles(stored, batch, fetched_at(), address).write.mode("overwrite").parquet(path(batch_id + 1))

    return write
