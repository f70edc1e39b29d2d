"""Results compared as multisets of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def normalise(lines: DataFrame) -> DataFrame:
    """value without a final CR; blank lines go."""
    return lines.select(F.rtrim(F.col("value"), F.lit("\r")).alias("value")).where(F.length("value") > 0)


def diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """side, value, n: lines that one side has n times more often; empty if the results agree.

    One aggregation of both sides: equal lines meet in partial sums before anything moves."""
    both = normalise(expected).select("value", F.lit(1).alias("d")).unionByName(normalise(actual).select("value", F.lit(-1).alias("d")))
    odd = both.groupBy("value").agg(F.sum("d").alias("d")).where("d <> 0")
    return odd.select(F.when(F.col("d") > 0, "expected").otherwise("actual").alias("side"), "value", F.abs("d").alias("n"))


def equal(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """One row: whether the results agree and how many lines differ."""
    return diff(expected, actual).agg((F.count(F.lit(1)) == 0).alias("equal"), F.coalesce(F.sum("n"), F.lit(0)).alias("differing"))


def first_diffs(expected: DataFrame, actual: DataFrame, most: int = 10) -> DataFrame:
    """The first few differing lines, for a report."""
    return diff(expected, actual).orderBy("value", "side").limit(most)


def subset(keys: DataFrame, known: DataFrame) -> DataFrame:
    """One row: whether every distinct value of keys' one column is in known's, and how many are not."""
    (a,), (b,) = keys.columns, known.columns
    missing = keys.distinct().join(known, keys[a] == known[b], "left_anti")
    return missing.agg((F.count(F.lit(1)) == 0).alias("subset"), F.count(F.lit(1)).alias("missing"))
