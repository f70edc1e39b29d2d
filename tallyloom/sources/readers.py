"""Sources: message CSV, text lines, JSON documents and logs, and adapters from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.sources.schema import BENCH_LOG, LEADERBOARD, MESSAGES, STATUS


def read_messages(spark: SparkSession, path: str, strict_header: bool = False) -> DataFrame:
    """Message CSV with one header line. A malformed row ends the query, once its columns are read.

    Files are split at line ends by Spark. strict_header: the header has to name the four columns.
    LF and CRLF, blank lines and a missing final line end are accepted."""
    return spark.read.csv(path, schema=MESSAGES, header=True, quote="", mode="FAILFAST", enforceSchema=not strict_header)


def parse_fields(lines: DataFrame) -> DataFrame:
    """Messages from text lines(value): exactly four comma-separated fields, the header and blank lines left out.

    Integers that don't parse, or another number of fields, end the query."""
    fields = F.split("value", ",", -1)
    line = lines.select(F.rtrim(F.col("value"), F.lit("\r")).alias("value")).where(F.length("value") > 0).where(~F.col("value").startswith("unix_timestamp,"))
    whole = F.when(F.size(fields) == 4, fields).otherwise(F.raise_error(F.concat(F.lit("not four fields: "), F.col("value"))))
    return line.select(whole.alias("f")).select(F.col("f")[0].cast("bigint").alias("unix_timestamp"), F.col("f")[1].alias("channel_path"), F.col("f")[2].cast("bigint").alias("message_length"), F.col("f")[3].cast("bigint").alias("stamp_count"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines without a final CR, as value."""
    return spark.read.text(path).select(F.rtrim(F.col("value"), F.lit("\r")).alias("value")).where(F.length("value") > 0)


def read_bench_log(spark: SparkSession, path: str) -> DataFrame:
    """One row a measurement."""
    return spark.read.schema(BENCH_LOG).json(path)


def read_leaderboard(spark: SparkSession, path: str) -> DataFrame:
    """One row an entry, ranked ones first in the schema; unknown fields are ignored."""
    boards = spark.read.schema(LEADERBOARD).json(path, multiLine=True)
    entries = [boards.select("board", F.lit(kind).alias("kind"), F.explode(kind).alias("e")).select("board", "kind", "e.*") for kind in ("ranked", "disqualified")]
    seconds = (F.col("scoreNs").cast("bigint") / 1_000_000_000).alias("seconds")
    return entries[0].unionByName(entries[1]).select("*", seconds)


def read_status(spark: SparkSession, path: str) -> DataFrame:
    """Submission status documents; optional parts are null. outcome: the first thing that is known."""
    outcome = F.coalesce(F.concat(F.lit("disqualified: "), "disqualifiedReason"), F.concat(F.lit("infrastructure: "), "infrastructureError"), F.col("public.verdict"), F.col("status"))
    return spark.read.schema(STATUS).json(path, multiLine=True).withColumn("outcome", outcome)


def messages_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event is a message of the channel event_type/u<user>; its value in hundredths is the length."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    epoch = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")
    return e.select(
        epoch.cast("bigint").alias("unix_timestamp"),
        F.concat("event_type", F.lit("/u"), F.col("user_id").cast("string")).alias("channel_path"),
        F.greatest(F.lit(1).cast("bigint"), F.floor(F.col("value") * 100).cast("bigint")).alias("message_length"),
        F.get_json_object("props", "$.k").cast("bigint").alias("stamp_count"),
    )


def messages_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line is a message of the channel flag/status/s<supplier> at its ship date; months of several years."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    epoch = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', cast(l_shipdate as timestamp_ntz))")
    return li.select(
        epoch.cast("bigint").alias("unix_timestamp"),
        F.concat_ws("/", "l_returnflag", "l_linestatus", F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))).alias("channel_path"),
        F.col("l_quantity").cast("bigint").alias("message_length"),
        F.col("l_linenumber").cast("bigint").alias("stamp_count"),
    )
