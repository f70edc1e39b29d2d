"""Exact statistics of messages by channel and UTC month.

Every aggregate is a partial one before its shuffle, so what moves is a row for each group and task. Groups
are those of the channel name itself and an integer month; text is made after the last aggregation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import scalar as S

KEYS = ["channel_path", "month"]
#: Owners of a channel where rows are dealt out before they are aggregated.
SALTS = 16


def channel_month_stats(messages: DataFrame) -> DataFrame:
    """min_length, total_length, max_length, message_count, total_stamp_count of each channel and month index."""
    return messages.groupBy("channel_path", S.month_index(F.col("unix_timestamp")).alias("month")).agg(
        F.min("message_length").alias("min_length"),
        F.sum("message_length").alias("total_length"),
        F.max("message_length").alias("max_length"),
        F.count(F.lit(1)).alias("message_count"),
        F.sum("stamp_count").alias("total_stamp_count"),
    )


def _combine(stats: DataFrame, keys: list[str]) -> DataFrame:
    return stats.groupBy(*keys).agg(
        F.min("min_length").alias("min_length"),
        F.sum("total_length").alias("total_length"),
        F.max("max_length").alias("max_length"),
        F.sum("message_count").alias("message_count"),
        F.sum("total_stamp_count").alias("total_stamp_count"),
    )


def merge_partials(*parts: DataFrame) -> DataFrame:
    """Statistics of all messages from those of disjoint parts of them."""
    return _combine(reduce(DataFrame.unionByName, parts), KEYS)


def channel_totals(stats: DataFrame) -> DataFrame:
    """A channel's statistics over all months, from its months'."""
    return _combine(stats, ["channel_path"])


def repartition_then_agg(messages: DataFrame) -> DataFrame:
    """The same statistics with messages dealt to the owners of their channels first.

    All rows move: kept to compare with channel_month_stats only. A channel has SALTS owners, so that a hot one
    is no hot task, and what they find is merged."""
    salt = F.pmod(F.xxhash64("unix_timestamp", "message_length", "stamp_count"), F.lit(SALTS))
    return channel_month_stats(messages.repartition("channel_path", salt))


def finish(stats: DataFrame) -> DataFrame:
    """year_month and the correctly rounded average in place of month and total_length."""
    return stats.select(
        "channel_path",
        S.format_month(F.col("month")).alias("year_month"),
        "min_length",
        S.avg_printf2(F.col("total_length"), F.col("message_count")).alias("average_length"),
        "max_length",
        "message_count",
        "total_stamp_count",
    )


def lines(stats: DataFrame) -> DataFrame:
    """value: one text line for each group."""
    f = finish(stats)
    return f.select(S.format_record(*[F.col(c) for c in f.columns]).alias("value"))
