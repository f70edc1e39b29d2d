"""Exact dedup: counting quotient filters of each partition, merged, then byte verification."""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import quotient
from tallyloom.llm.common import cut, drop_rows, lean, prefilter, read, text_hash

#: The filters are cut into 2**BLOCK_BITS ranges of fingerprints that are merged apart from each other.
BLOCK_BITS = 12


def repeated_fingerprints(fingerprints: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """Of the one long column, the values that occur more than once: fp, count.

    Each partition builds one filter and ships it in blocks; a block of all partitions' filters is
    merged by its sorted remainders. A value takes one entry of each partition's filter however often
    it occurs there, so a hot value is no hot key. Nulls are skipped.
    """
    (name,) = fingerprints.columns
    bits = 64 - block_bits

    def build(batches):
        values = [b.column(0).drop_null().to_numpy(zero_copy_only=False).view(np.uint64) for b in batches]
        values, counts = np.unique(np.concatenate(values), return_counts=True) if values else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        block = (values >> np.uint64(bits)).astype(np.int64)
        starts = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else np.zeros(0, np.int64)
        rows = [(int(block[s]), quotient.encode(values[s:e] & np.uint64((1 << bits) - 1), counts[s:e], bits)) for s, e in zip(starts, np.append(starts, len(block))[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.binary())], ["block", "filter"])

    def combine(batches):
        rows = (row for b in batches for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        for block, own in groupby(rows, key=lambda x: x[0]):
            values, counts = quotient.merge([x[1] for x in own])
            more = counts > 1
            fps = (values[more] | (np.uint64(block) << np.uint64(bits))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(fps), pa.array(counts[more].astype(np.int64))], ["fp", "count"])

    filters = fingerprints.select(name).mapInArrow(lean(build), "block bigint, filter binary")
    return filters.repartition("block").sortWithinPartitions("block").mapInArrow(lean(combine), "fp bigint, count bigint")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """Every row of docs(doc_id, text, ...) with its class of identical texts.

    Returns doc_id, keep_id, group_size, kept, text_sha256. Null and empty texts are equal. The row of
    the largest doc_id stays; null ids are smaller than all others; of rows that repeat this id, one
    stays. Other columns are ignored; an empty table gives an empty result.

    Fingerprints that the merged filter counts once settle their rows. Texts of the rest alone are
    shuffled, after copies have been combined in each partition, and compared byte by byte. A third of
    all rows in one group is one text a partition here, and a skewed join that AQE splits at the end.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), text_hash().alias("_fp")).withColumn("_row", F.monotonically_increasing_id())
    # what everything after is decided on: one reading of the rows' numbers, fingerprints and digests
    thin = cut(rows.select("doc_id", "_row", "_fp", F.unhex(F.sha2("text", 256)).alias("_sha")))
    repeated = repeated_fingerprints(thin.select("_fp"))
    groups = cut(
        prefilter(rows, "_fp", repeated.select("fp"))
        .groupBy("_fp", "text")  # the verification: only whole equal texts meet
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
        .select("_fp", F.unhex(F.sha2("text", 256)).alias("_sha"), "keep_id", "group_size")
    )
    # of a group's rows with the largest id, that of the smallest number; the id in the key spreads a hot group
    own, best = thin.alias("own"), groups.alias("best")
    same = (F.col("own._fp") == F.col("best._fp")) & (F.col("own._sha") == F.col("best._sha")) & F.col("own.doc_id").eqNullSafe(F.col("best.keep_id"))
    first = own.join(best, same).groupBy("best._fp", "best._sha").agg(F.min("own._row").alias("_keep"))
    settled = cut(groups.join(first, ["_fp", "_sha"]))
    one = F.col("group_size").isNull()
    return thin.join(settled, ["_fp", "_sha"], "left").select(
        "doc_id",
        F.when(one, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        (one | (F.col("_row") == F.col("_keep"))).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
        "_row",
        F.col("_fp").alias("text_hash"),
    )


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """docs without the rows whose text another row keeps; all columns stay as they are. docs must give the
    same rows in the same partitions each time it is read; if it does not, the run ends with an error."""
    return drop_rows(docs, exact_duplicates(docs).where("not kept").select("_row", "text_hash"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, size, survivor and digest of every document."""
    return exact_duplicates(read(spark, sf_dir, "documents", "doc_id", "text")).drop("_row", "text_hash")


ORACLE_OP5 = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""
