"""Profiles of channels: frequencies, coverage, histograms, collisions, balance, boards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import scalar as S


def channel_frequency(messages: DataFrame) -> DataFrame:
    """channel_path, n."""
    return messages.groupBy("channel_path").agg(F.count(F.lit(1)).alias("n"))


def topk_coverage(messages: DataFrame, marks: tuple[int, ...] = (16, 64, 256, 1024, 4096)) -> DataFrame:
    """How many messages the commonest channels have: top, rows, share at each mark that there are channels for.

    The running sum is over the max(marks) commonest alone, which TakeOrdered finds without a full sort."""
    counts = channel_frequency(messages)
    total = counts.agg(F.sum("n").alias("total"))
    order = Window.orderBy(F.desc("n"), "channel_path")
    best = counts.orderBy(F.desc("n"), "channel_path").limit(max(marks))
    ranked = best.select(F.row_number().over(order).alias("top"), F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("rows"))
    return ranked.where(F.col("top").isin(*marks)).join(F.broadcast(total)).select("top", "rows", (F.col("rows") / F.col("total")).alias("share"))


def ranked(rows: DataFrame, key: Column, rank: str, parts: int = 255) -> DataFrame:
    """rows with their place, from 1, by rising key (a struct that no two rows share).

    Bounds from a sample of parts keys, by hash, cut the rows into ranges; a range's rows are numbered by
    themselves, behind the sizes of the ranges before it. So no task sees all rows, and as a range is a
    function of the key alone, it is the same whenever it is computed."""
    keyed = rows.select("*", key.alias("_key"))
    bounds = keyed.select("_key").orderBy(F.xxhash64("_key"), "_key").limit(parts).agg(F.sort_array(F.collect_list("_key")).alias("_bounds"))
    placed = keyed.join(F.broadcast(bounds)).withColumn("_range", F.size(F.filter("_bounds", lambda b: b < F.col("_key")))).drop("_bounds")
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.select("_range", (F.sum("_size").over(Window.orderBy("_range")) - F.col("_size")).alias("_before"))  # a row for each range
    own = F.row_number().over(Window.partitionBy("_range").orderBy("_key"))
    return placed.withColumn("_own", own).join(F.broadcast(before), "_range").select(*rows.columns, (F.col("_before") + F.col("_own")).alias(rank))


def frequency_rank(messages: DataFrame, ties_ascending: bool = True) -> DataFrame:
    """channel_path, n, rank by falling n; ties by the name, in rising or falling order.

    Falling names are the rising order from its end."""
    counts = channel_frequency(messages)
    if ties_ascending:
        return ranked(counts, F.struct(-F.col("n"), "channel_path"), "rank")
    total = counts.agg(F.count(F.lit(1)).alias("_channels"))
    return ranked(counts, F.struct("n", "channel_path"), "rank").join(F.broadcast(total)).select("channel_path", "n", (F.col("_channels") + 1 - F.col("rank")).alias("rank"))


def sampled_frequency(messages: DataFrame, sixteenths: int = 1) -> DataFrame:
    """channel_path, sampled, estimate: counts in a sample of so many sixteenths of all messages, which a digest
    of the whole message picks, and what they let expect for all. Sampling is what this operator is for."""
    digit = F.conv(F.substring(F.md5(F.concat_ws(",", "unix_timestamp", "channel_path", "message_length", "stamp_count")), 1, 1), 16, 10).cast("int")
    counts = messages.where(digit < sixteenths).groupBy("channel_path").agg(F.count(F.lit(1)).alias("sampled"))
    return counts.withColumn("estimate", F.col("sampled") * 16 / F.lit(sixteenths))


def histogram(messages: DataFrame, value: Column, name: str, distinct_channels: bool = True) -> DataFrame:
    """How many channels (or messages) have each value."""
    rows = messages.select("channel_path").distinct() if distinct_channels else messages
    return rows.groupBy(value.alias(name)).agg(F.count(F.lit(1)).alias("n"))


def name_length_hist(messages: DataFrame) -> DataFrame:
    return histogram(messages, F.octet_length("channel_path"), "name_length")


def segment_count_hist(messages: DataFrame) -> DataFrame:
    return histogram(messages, S.segment_count(F.col("channel_path")), "segments")


def digit_hist(messages: DataFrame) -> DataFrame:
    """Messages by the decimal digits of their length and of their stamp count."""
    digits = [F.struct(F.lit(name).alias("field"), F.length(F.col(name).cast("string")).alias("digits")) for name in ("message_length", "stamp_count")]
    return messages.select(F.explode(F.array(*digits)).alias("d")).groupBy("d.field", "d.digits").agg(F.count(F.lit(1)).alias("n"))


def distinct_channels(messages: DataFrame) -> DataFrame:
    return messages.agg(F.countDistinct("channel_path").alias("channels"))


def discover_keys(messages: DataFrame, most: int = 10_000) -> DataFrame:
    """The first most channels by name, which is what the operator is for."""
    return messages.select("channel_path").distinct().orderBy("channel_path").limit(most)


def hash_collisions(messages: DataFrame, digits: int = 3) -> DataFrame:
    """Hashes (the first hexadecimal digits of MD5) that two or more channels share: key, channels."""
    names = messages.select("channel_path").distinct()
    return names.groupBy(F.substring(F.md5("channel_path"), 1, digits).alias("key")).agg(F.count(F.lit(1)).alias("channels")).where("channels >= 2")


def prefix_collisions(messages: DataFrame) -> DataFrame:
    """Distinct first and last 8 bytes of names, and channels whose pair of them another channel has too."""
    names = messages.select("channel_path").distinct().select(F.substring("channel_path", 1, 8).alias("a"), F.right("channel_path", F.lit(8)).alias("z"))
    pairs = names.groupBy("a", "z").agg(F.count(F.lit(1)).alias("n"))
    return pairs.agg(F.countDistinct("a").alias("first8"), F.countDistinct("z").alias("last8"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("colliding"))


def missing_parents(messages: DataFrame) -> DataFrame:
    """Parents of channels, at any level, that are no channels themselves: parent, children."""
    names = messages.select("channel_path").distinct()
    parents = names.select(F.explode(S.parent_prefixes(F.col("channel_path"))).alias("parent")).groupBy("parent").agg(F.count(F.lit(1)).alias("children"))
    return parents.join(names, F.col("parent") == F.col("channel_path"), "left_anti")


def range_balance(messages: DataFrame, position: Column) -> DataFrame:
    """Rows, bytes of names and distinct channels of each range, and the spread of rows, (max - min) / max."""
    parts = messages.groupBy(position.alias("range")).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("channel_path")).alias("name_bytes"), F.countDistinct("channel_path").alias("channels"))
    spread = parts.agg(((F.max("rows") - F.min("rows")) / F.max("rows")).alias("spread"))
    return parts.join(F.broadcast(spread))


def rank_change(public: DataFrame, private: DataFrame) -> DataFrame:
    """Boards(name, score) joined: ranks by falling score and public rank - private rank."""
    place = lambda board, rank: ranked(board, F.struct(-F.col("score"), "name"), rank).select("name", F.col(rank).cast("int").alias(rank))
    both = place(public, "public_rank").join(place(private, "private_rank"), "name")
    return both.withColumn("rank_change", F.col("public_rank") - F.col("private_rank"))


def medians(rows: DataFrame, label: Column, value: Column) -> DataFrame:
    """label, median, n of the values that aren't null; of an even number, the mean of the two middle ones.

    Equal values are counted first and the counts added up in order, so a label's rows are in no one buffer:
    what a task holds is a label's distinct values, one after the other."""
    counts = rows.select(label.alias("label"), value.alias("v")).where("v is not null").groupBy("label", "v").agg(F.count(F.lit(1)).alias("m"))
    totals = counts.groupBy("label").agg(F.sum("m").alias("n"))
    upto = F.sum("m").over(Window.partitionBy("label").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    at = counts.withColumn("upto", upto).join(totals.withColumnRenamed("label", "_label"), F.col("label").eqNullSafe(F.col("_label")))
    holds = lambda place: (F.col("upto") >= F.expr(place)) & (F.col("upto") - F.col("m") < F.expr(place))
    middle = at.where(holds("(n + 1) div 2") | holds("n div 2 + 1"))
    return middle.groupBy("label").agg(((F.min("v") + F.max("v")) / 2.0).alias("median"), F.first("n").alias("n"))


def median_by(rows: DataFrame, label: Column, value: Column) -> DataFrame:
    """The exact median of each label's values: label, median, runs."""
    return medians(rows, label, value).select("label", "median", F.col("n").alias("runs"))


def throughput(rows: DataFrame, label: Column, seconds: Column, size: Column) -> DataFrame:
    """label, median seconds, runs, and 10^9 bytes a second: a label's largest input by its median time."""
    sizes = rows.groupBy(label.alias("label")).agg(F.max(size).alias("bytes"))
    return median_by(rows, label, seconds).join(sizes, "label").select("label", "median", "runs", (F.col("bytes") / F.col("median") / 1e9).alias("gb_per_second"))


def ab_delta(rows: DataFrame, label: Column, side: Column, value: Column) -> DataFrame:
    """Medians of sides a and b of each label and the change from b to a in per cent."""
    found = medians(rows, F.struct(label.alias("label"), side.alias("side")), value)
    both = found.groupBy(F.col("label.label").alias("label")).agg(*[F.max(F.when(F.col("label.side") == x, F.col("median"))).alias(x) for x in ("a", "b")])
    return both.withColumn("delta_percent", (F.col("a") / F.col("b") - 1) * 100)


def count_over(messages: DataFrame, threshold: int) -> DataFrame:
    return messages.agg(F.count_if(F.col("message_length") > threshold).alias("over"), F.max("message_length").alias("largest"), F.count(F.lit(1)).alias("total"))


def invalid_reason(year_start: int = S.YEAR_START, year_end: int = S.YEAR_END) -> Column:
    """Why a message breaks the contract, first reason first; null if it doesn't."""
    ts, name, size, stamps = (F.col(c) for c in ("unix_timestamp", "channel_path", "message_length", "stamp_count"))
    return (
        F.when(ts.isNull() | name.isNull() | size.isNull() | stamps.isNull(), "missing field")
        .when((ts < year_start) | (ts > year_end), "time out of range")
        .when(~name.rlike(S.CHANNEL), "bad channel name")
        .when(size < 1, "length below 1")
        .when(stamps < 0, "negative stamps")
    )


def require_valid(messages: DataFrame, year_start: int = S.YEAR_START, year_end: int = S.YEAR_END) -> DataFrame:
    """messages; the first one that breaks the contract ends the query."""
    reason = invalid_reason(year_start, year_end)
    checked = F.when(reason.isNull(), F.col("unix_timestamp")).otherwise(F.raise_error(F.concat(F.lit("invalid message: "), reason)))
    return messages.withColumn("unix_timestamp", checked)
