"""Schemas of the files and tables that the engine reads."""

from __future__ import annotations

from pyspark.sql import types as T

MESSAGES = T.StructType(
    [
        T.StructField("unix_timestamp", T.LongType()),
        T.StructField("channel_path", T.StringType()),
        T.StructField("message_length", T.LongType()),
        T.StructField("stamp_count", T.LongType()),
    ]
)

BENCH_LOG = T.StructType(
    [
        T.StructField("time", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("times", T.ArrayType(T.DoubleType())),
        T.StructField("median", T.DoubleType()),
        T.StructField("input_bytes", T.LongType()),
        T.StructField("git", T.StringType()),
    ]
)

_ENTRY = T.StructType(
    [
        T.StructField("rank", T.IntegerType()),
        T.StructField("rankChange", T.IntegerType()),
        T.StructField("username", T.StringType()),
        T.StructField("submissionId", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("scoreNs", T.StringType()),
        T.StructField("verdict", T.StringType()),
        T.StructField("submittedAt", T.StringType()),
        T.StructField("sourceAvailable", T.BooleanType()),
    ]
)

LEADERBOARD = T.StructType(
    [
        T.StructField("board", T.StringType()),
        T.StructField("privatePublished", T.BooleanType()),
        T.StructField("ranked", T.ArrayType(_ENTRY)),
        T.StructField("disqualified", T.ArrayType(_ENTRY)),
    ]
)

STATUS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("sourceFilename", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("public", T.StructType([T.StructField("verdict", T.StringType()), T.StructField("scoreNs", T.StringType()), T.StructField("error", T.StringType())])),
        T.StructField("infrastructureError", T.StringType()),
        T.StructField("disqualifiedReason", T.StringType()),
        T.StructField("uploadStartedAt", T.StringType()),
        T.StructField("submissionNumber", T.IntegerType()),
    ]
)
