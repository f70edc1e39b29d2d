"""The statistics over a stream of message files: the same aggregation, kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tallyloom.operators.aggregate import channel_month_stats, finish
from tallyloom.sources.schema import MESSAGES


def stream_messages(spark: SparkSession, folder: str, files_each: int | None = None) -> DataFrame:
    """Messages of the CSV files that arrive in a folder."""
    reader = spark.readStream.schema(MESSAGES).option("header", True).option("quote", "").option("mode", "FAILFAST")
    return (reader.option("maxFilesPerTrigger", files_each) if files_each else reader).csv(folder)


def start_stats(messages: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Keep the statistics in a memory table. State is a row for each channel and month: late messages of
    any month count, as the batch form counts them, so no watermark drops state."""
    return finish(channel_month_stats(messages)).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).start()
