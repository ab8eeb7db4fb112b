"""Structured Streaming over ledgers: idempotent appends, latest state and windowed counts with late data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.ledger import latest


def event_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).parquet(folder)


def append_once(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """The first event of each key within the watermark; state older than ``delay`` is dropped."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, time: str, delay: str, width: str, *by: str) -> DataFrame:
    """Counts per window and group; events later than the watermark are left out."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"))


def keep_latest(stream: DataFrame, keys: list[str], order: list[str], columns: list[str], path: str, checkpoint: str):
    """A streaming query that keeps the last event of each key as Parquet versions under ``path``.

    Each batch merges with the version before it and writes the next one, named by the batch, so a
    batch that runs again after a failure overwrites its own version only.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.select(*dict.fromkeys([*keys, *order, *columns]))
        if number > 0:
            new = new.unionByName(spark.read.parquet(f"{path}/version={number - 1}"), allowMissingColumns=True)
        kept = latest(new, keys, order, list(dict.fromkeys([*order, *columns])))
        kept.drop("versions").write.mode("overwrite").parquet(f"{path}/version={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process what is there and stop."""
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
