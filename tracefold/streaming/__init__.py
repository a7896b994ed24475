"""Incremental ingest of newly arrived pages. An extension: batch and stream share their operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def new_documents(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A stream of documents from parquet files as they arrive."""
    return spark.readStream.schema(schema).parquet(folder)


def ingest_stream(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Hands every batch of what has arrived to ``write``, then ends. A batch that is run again has the same number."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by tumbling window and type, for a stream or a table of (ts, event_type, value)."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
