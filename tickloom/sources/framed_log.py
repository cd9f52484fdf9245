"""Logs of length-prefixed records: four bytes of length, little-endian, then the payload."""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a log that one task decodes, about.
SPLIT = 64 << 20
#: Records and payload bytes of one batch, about.
BATCH, BATCH_BYTES = 10_000, 16 << 20


def frames(data: bytes, start: int = 0) -> Iterator[tuple[int, int, bytes]]:
    """(offset, next offset, payload) of the records from a record's offset on; a short tail ends the log."""
    return framed(io.BytesIO(data), len(data), start)


def framed(f, size: int, start: int = 0, stop: int | None = None) -> Iterator[tuple[int, int, bytes]]:
    """frames() of a seekable file of `size` bytes, for the records that begin before `stop`."""
    at, stop = start, size if stop is None else stop
    f.seek(min(at, size))
    while at < stop and at + 4 <= size:
        (n,) = struct.unpack("<I", f.read(4))
        if at + 4 + n > size:
            return
        yield at, at + 4 + n, f.read(n)
        at += 4 + n


def opened(path: str):
    """(buffered file, size) of a path in any file system that Arrow knows."""
    system, at = fs.FileSystem.from_uri(path)
    f = system.open_input_file(at)
    return io.BufferedReader(f, 1 << 20), f.size()


def read_log(spark: SparkSession, path: str, start: int = 0, split: int = SPLIT) -> DataFrame:
    """path, offset, next_offset, payload of the records of all files below `path`, from offset `start` of each on.

    Only lengths are read first, a task a file, and tell where records begin about every `split` bytes; these stretches
    are decoded in tasks of their own, record by record, so that neither a file nor a stretch is held whole.
    """

    def stretches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, size in zip(b["path"], b["length"]):
                at = [start]
                if size - start > split:
                    f, size = opened(name)
                    with f:
                        at += _begins(f, size, start, split)
                yield pd.DataFrame({"path": name, "a": at, "b": [*at[1:], size]})

    def decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, first, last in zip(b["path"], b["a"], b["b"]):
                f, size = opened(name)
                with f:
                    rows, held = [], 0
                    for r in framed(f, size, first, last):
                        rows.append((name, *r))
                        held += len(r[2])
                        if len(rows) >= BATCH or held >= BATCH_BYTES:
                            yield pd.DataFrame(rows, columns=columns)
                            rows, held = [], 0
                    yield pd.DataFrame(rows, columns=columns)

    columns = ["path", "offset", "next_offset", "payload"]
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    parts = files.mapInPandas(stretches, "path string, a long, b long").where("a < b")
    # a stretch each task: repartition by a key would put several into one
    return parts.repartition(spark.sparkContext.defaultParallelism).mapInPandas(decoded, "path string, offset long, next_offset long, payload binary")


def _begins(f, size: int, start: int, split: int) -> list[int]:
    """Offsets of records, one after each `split` bytes from `start` on."""
    at, due, found = start, start + split, []
    f.seek(at)
    while at + 4 <= size:
        (n,) = struct.unpack("<I", f.read(4))
        at += 4 + n
        if at >= size:
            break
        f.seek(n, io.SEEK_CUR)
        if at >= due:
            found.append(at)
            due = at + split
    return found


def expired(files: DataFrame, before: int) -> DataFrame:
    """Of rotated parts (path ends in .<epoch seconds>) those older than `before`: path, epoch."""
    rows = files.select("path", F.regexp_extract("path", r"\.(\d+)$", 1).alias("epoch"))
    return rows.where("epoch <> ''").withColumn("epoch", F.col("epoch").cast("long")).where(F.col("epoch") < before)


def rotate(path: str, epoch: int) -> list[str]:
    """Renames the active logs (*.log) below `path` to name.<epoch>, so that the next write begins new ones; the new names. Moves names only."""
    system, at = fs.FileSystem.from_uri(path)
    active = [f.path for f in system.get_file_info(fs.FileSelector(at, recursive=True)) if f.is_file and f.extension == "log"]
    for name in active:
        system.move(name, f"{name}.{epoch}")
    return [f"{name}.{epoch}" for name in active]


def remove_expired(spark: SparkSession, path: str, before: int) -> list[str]:
    """Deletes the rotated parts below `path` that are older than `before`; their names."""
    old = [r.path for r in expired(spark.read.format("binaryFile").load(path), before).collect()]
    for name in old:
        system, at = fs.FileSystem.from_uri(name)
        system.delete_file(at)
    return old
