"""Sinks: many text files, exactly one text file, a JSON-lines log."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def write_lines(lines: DataFrame, path: str) -> None:
    """One part file for each partition, written side by side."""
    lines.select("value").write.mode("overwrite").text(path)


def write_single_text(lines: DataFrame, path: str) -> None:
    """lines(value) as exactly one file on any file system that Spark writes to, for results with a row for
    each group.

    Parts are written in parallel to a folder beside it, then joined by the file system's own client, in
    their order; the file appears whole or not at all."""
    sc = lines.sparkSession.sparkContext
    hadoop, conf = sc._jvm.org.apache.hadoop, sc._jsc.hadoopConfiguration()
    target = hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    folder = hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    try:
        write_lines(lines, f"{folder}/parts")
        parts = sorted(str(x.getPath()) for x in fs.listStatus(hadoop.fs.Path(f"{folder}/parts")) if x.getPath().getName().startswith("part-"))
        fs.setWriteChecksum(False)
        whole = hadoop.fs.Path(f"{folder}/whole")
        out = fs.create(whole, True)
        try:
            for part in parts:
                source = fs.open(hadoop.fs.Path(part))
                try:
                    hadoop.io.IOUtils.copyBytes(source, out, 1 << 20, False)
                finally:
                    source.close()
        finally:
            out.close()
        fs.delete(target, False)
        if not fs.rename(whole, target):
            raise OSError(f"{path}: cannot be written")
    finally:
        fs.setWriteChecksum(True)
        fs.delete(folder, True)


def append_log(records: DataFrame, path: str) -> None:
    """JSON lines, beside those that are there already."""
    records.write.mode("append").json(path)
