"""Helpers shared by the operators: reading, cutting lineage, size-bounded prefilters."""

from __future__ import annotations

import ctypes
import os
import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.session import ROOT, scratch

#: Bits of a prefilter's bitmap for each wanted key; log2 of the least and the most bits, 2^22 broadcast rows
#: of 16 bytes. From 2^25 wanted keys on, more and more rows that are not wanted pass; an exact join follows.
BITS_A_KEY, LEAST_BITS_LOG2, MOST_BITS_LOG2 = 32, 16, 28


def _release() -> None:
    """Give memory that a task no longer needs back to the machine; workers live on for other tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it keeps what it likes
        pass


#: What modules remember in a worker between its tasks, and how to forget it.
_remembered: dict[str, Callable[[], None]] = {}


def remembers(module: str, forget: Callable[[], None]) -> None:
    """Have forget called when a worker begins a task of another module."""
    _remembered[module] = forget


def _begin(module: str) -> None:
    """Workers live on for the tasks of later stages, which have no use for what earlier ones remember."""
    for other, forget in _remembered.items():
        if other != module:
            forget()
    _release()


def lean(run):
    """A function over Arrow batches that releases memory when its partition is done."""

    def kept(batches):
        _begin(run.__module__)
        try:
            yield from run(batches)
        finally:
            _release()

    return kept


def lean_pair(run):
    """The same for a function of two cogrouped tables."""

    def kept(left, right):
        try:
            return run(left, right)
        finally:
            _release()

    return kept


def share_path(spark: SparkSession) -> SparkSession:
    """Let Python workers that start from now on import this package from where the driver has it.

    For sessions that somebody else made, in another folder. On a cluster the package is installed, or
    shipped with --py-files, as usual. Rows are whole texts, so Arrow batches of 10,000 rows, the default,
    are large outside the heap on both sides; unless the session asks for another number, it gets 2,000."""
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(batch) == "10000":
        spark.conf.set(batch, "2000")
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, known]))
    return spark


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """The named columns of one Parquet table; Spark alone touches the path, so any file system works."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage: write df in the folder that the cluster names in spark.checkpoint.dir and read it again.

    Only on one machine (local[n]: tests, a laptop) is a folder made where the setting is missing. Unlike checkpoint(), the
    table has sizes as they are: estimates of joins, multiplied round after round of a loop, would grow to
    numbers that take the planner minutes. The table goes when the driver ends."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(scratch(spark))
    where = f"{sc.getCheckpointDir()}/{uuid.uuid4().hex}"
    df.write.parquet(where)
    path = sc._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(where)


def _marked(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """df with _hit: whether key may be among wanted's (one column); never false for one that is.

    wanted is folded into a bitmap, whose size follows the number of wanted keys up to a fixed bound: so it
    can always be broadcast, and df is not shuffled. Null keys miss."""
    (name,) = wanted.columns
    wanted = cut(wanted.where(F.col(name).isNotNull()).distinct())
    bits = min(MOST_BITS_LOG2, max(LEAST_BITS_LOG2, (BITS_A_KEY * wanted.count()).bit_length()))
    spot = lambda c: F.shiftrightunsigned(F.xxhash64(c), 64 - bits)
    words = (
        wanted.select(spot(F.col(name)).alias("_spot"))
        .groupBy(F.shiftright("_spot", 6).alias("_word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(_spot & 63 as int))")).alias("_bits"))
    )
    bit = F.expr("(shiftrightunsigned(_bits, cast(_spot & 63 as int)) & 1L) = 1L")
    placed = df.withColumn("_spot", spot(F.col(key))).withColumn("_word", F.shiftright("_spot", 6))
    return placed.join(F.broadcast(words), "_word", "left").withColumn("_hit", F.coalesce(bit & F.col(key).isNotNull(), F.lit(False))).select(*df.columns, "_hit")


def prefilter(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Drop most rows of df whose key is not among wanted's (one column), without shuffling df.

    All rows with wanted keys stay; others may stay as well, so an exact join has to follow. Null keys
    are dropped.
    """
    return _marked(df, key, wanted).where("_hit").drop("_hit")


def text_hash(text: str = "text") -> Column:
    """Hash of a text; null counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def drop_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows that are in gone: their monotonically_increasing_id and text_hash(). All
    columns stay, whatever their names.

    Rows that the bitmap clears stay where they are; only the others are joined with gone. A row whose
    number is there with another hash shows that docs was read in other partitions before: an error."""
    row, told = gone.columns
    gone = cut(gone)
    numbered = docs.select(F.struct("*").alias("row"), text_hash().alias("_own")).withColumn("_at", F.monotonically_increasing_id())
    marked = _marked(numbered, "_at", gone.select(row))
    unsure = marked.where("_hit").join(gone.select(F.col(row).alias("_gone"), F.col(told).alias("_told")), F.col("_at") == F.col("_gone"), "left")
    moved = F.raise_error(F.lit("documents were read in other partitions the second time; give a table or a checkpoint")).cast("boolean")
    kept = unsure.where(F.when(F.col("_gone").isNull(), True).when(F.col("_told") == F.col("_own"), False).otherwise(moved))
    return marked.where("not _hit").select("row.*").unionByName(kept.select("row.*"))


def pieces(batches: Iterator[pa.RecordBatch], text: str, most_chars: int = 4_000_000, most_rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a piece has about most_chars bytes of text; one longer text is a piece alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, size in enumerate(sizes.tolist()):
            if i > start and (total + size > most_chars or i - start >= most_rows):
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        if batch.num_rows > start:
            yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def pack_strings(items: list[bytes]) -> bytes:
    """Number, lengths, then contents, compressed."""
    return zstandard.compress(struct.pack("<I", len(items)) + np.array([len(x) for x in items], "<u4").tobytes() + b"".join(items), 3)


def unpack_strings(data: bytes) -> list[bytes]:
    data = zstandard.decompress(data)
    (n,) = struct.unpack_from("<I", data)
    ends = np.cumsum(np.frombuffer(data, "<u4", n, 4), dtype=np.int64) + 4 + 4 * n
    starts = [4 + 4 * n, *ends[:-1].tolist()] if n else []
    return [data[a:b] for a, b in zip(starts, ends.tolist(), strict=True)]
