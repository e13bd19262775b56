"""Streaming forms of the batch plans (an extension; the batch results are the same)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_uploads(spark: SparkSession, folder: str) -> DataFrame:
    """New files of a folder as a stream (path, modificationTime, length, content)."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).load(folder)


def daily_actions(events: DataFrame, ts: str = "ts", kind: str = "event_type", late: str = "1 day") -> DataFrame:
    """Counts of a stream's events by UTC day and kind; events later than `late` are dropped."""
    w = events.withWatermark(ts, late).groupBy(F.window(ts, "1 day"), kind).agg(F.count("*").alias("n"))
    return w.select(F.to_date("window.start").alias("day"), kind, "n")
