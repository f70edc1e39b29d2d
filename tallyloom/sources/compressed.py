"""Compressed inputs. Spark reads .gz and, where the native library is there, .zst by itself."""

from __future__ import annotations

import os
import shutil

import zstandard


def unpack_zstd(source: str, target: str) -> int:
    """Decompress a local .zst file in one pass of bounded memory; the bytes written. The file appears whole
    or not at all. A .zst stream can't be split, so unpacked input is read by many tasks, packed by one."""
    with open(source, "rb") as packed, open(f"{target}.part", "wb") as out:
        with zstandard.ZstdDecompressor().stream_reader(packed, read_across_frames=True) as stream:
            shutil.copyfileobj(stream, out, 1 << 20)
        size = out.tell()
    os.replace(f"{target}.part", target)
    return size
