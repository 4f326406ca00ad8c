"""The usage log as a stream: late lines within a watermark, repeated keys once, and sums by window, as files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "message_id string, request_id string, at timestamp, session_id string, model string, input long, output long, cache_read long, w5 long, w1 long"


def source(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(folder)


def once(rows: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each (message_id, request_id) once while its copies come within the watermark; the state of older keys is dropped."""
    return rows.withWatermark("at", late).dropDuplicatesWithinWatermark(["message_id", "request_id"])


def by_window(rows: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Token sums of each model in windows of event time."""
    timed = rows if rows.isStreaming is False else rows.withWatermark("at", late)
    sums = timed.groupBy(F.window("at", width), "model").agg(F.count("*").alias("requests"), *[F.sum(c).alias(c) for c in ("input", "output", "cache_read", "w5", "w1")])
    return sums.select(F.col("window.start").alias("start"), "model", "requests", "input", "output", "cache_read", "w5", "w1")


def sessions(rows: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of activity with no gap of so long."""
    timed = rows if rows.isStreaming is False else rows.withWatermark("at", late)
    sums = timed.groupBy(F.session_window("at", gap), "session_id").agg(F.count("*").alias("requests"), F.sum("output").alias("output"))
    return sums.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "session_id", "requests", "output")


def run(rows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write finished rows as Parquet; everything that is there is read, then the query ends."""
    return rows.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
