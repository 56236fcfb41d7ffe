"""Ingestion of new files as a stream: each batch replaces the partitions it has, so a repeated batch changes nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from stemma.sources.writers import overwrite_partitions


def ingest_files(spark: SparkSession, source: str, schema: str, parse: Callable[[DataFrame], DataFrame], target: str, by: list[str], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Parse new parquet files of a folder and write them to target, one partition of by at a time."""
    stream = spark.readStream.schema(schema).parquet(source)

    def batch(df: DataFrame, _: int) -> None:
        overwrite_partitions(parse(df), target, by)

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()
