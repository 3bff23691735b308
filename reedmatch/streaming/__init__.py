"""Incremental ingestion: an extension, built on file streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import content_key
from ..operators import index


def new_passages(spark: SparkSession, folder: str, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Passages (ts, text) arriving as Parquet files; each content key reaches the sink once within a day."""
    rows = spark.readStream.schema("ts timestamp, text string").parquet(folder).withColumn("unit_key", content_key("text"))
    fresh = rows.withWatermark("ts", "1 day").dropDuplicatesWithinWatermark(["unit_key"])
    return fresh.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def indexed_items(spark: SparkSession, folder: str, index_folder: str, checkpoint: str) -> StreamingQuery:
    """Keeps an index up to date with items (idx, title, text) that arrive as Parquet files: each micro-batch is one change. A batch
    that is run again after a fault replaces its items by the same ones, so rankings don't change."""
    rows = spark.readStream.schema("idx long, title string, text string").parquet(folder)
    return rows.writeStream.foreachBatch(lambda items, _: index.change(spark, index_folder, items)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_hour(events: DataFrame) -> DataFrame:
    return events.withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))
