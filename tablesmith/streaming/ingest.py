"""Streaming forms: new files as they arrive, windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.routing import described

BINARY = "path string, modificationTime timestamp, length bigint, content binary"


def new_files(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """A stream of described files; each content once within a day."""
    files = spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files).load(path)
    return described(files).withWatermark("modificationTime", "1 day").dropDuplicatesWithinWatermark(["content_hash"])


def event_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total) by tumbling window; works on a stream (with a watermark) and on a table."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    w = e.groupBy(F.window(F.col("ts").cast("timestamp"), width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n", "total")
