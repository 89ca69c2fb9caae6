"""Documents and events as streams (an extension: the method itself knows single texts only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from paraweft.config import EngineConfig
from paraweft.operators.segment import paragraph_rows, segment_enhanced


def document_stream(spark: SparkSession, path: str, schema, format: str = "parquet", files_per_trigger: int = 16) -> DataFrame:
    """New files of a folder as a stream of documents."""
    return spark.readStream.schema(schema).format(format).option("maxFilesPerTrigger", files_per_trigger).load(path)


def segment_stream(docs: DataFrame, out: str, checkpoint: str, config: EngineConfig | None = None, once: bool = False) -> StreamingQuery:
    """Paragraphs of each batch of documents to Parquet.

    The method is one projection a document, so it runs on the stream itself and
    the file sink's log makes every document's paragraphs appear exactly once.
    """
    rows = paragraph_rows(segment_enhanced(docs, config))
    writer = rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Events and their values by type in tumbling windows; events later than the watermark are dropped in streams. Works on tables as well."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = rows.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return grouped.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user: runs of events no further apart than the gap."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return grouped.select("user_id", F.col("w.start").alias("session_start"), "n")
