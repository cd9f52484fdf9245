"""Sources and sinks by users, on Spark's Python data source interface."""

from __future__ import annotations

import io
import json
import struct
import uuid
from collections.abc import Callable, Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .framed_log import framed, opened


#: Bytes of a log that one batch of a stream takes, about.
TAIL_BYTES = 256 << 20


class FramedLogSource(DataSource):
    """format("framed_log"): reads the records of log files below a path, a partition for each file, follows them as a stream, and appends a file for each task.

    read_log() also splits large files. A write commits as a whole: what a retried or failed task wrote isn't seen.
    """

    @classmethod
    def name(cls) -> str:
        return "framed_log"

    def schema(self) -> str:
        return "path string, offset long, next_offset long, payload binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _LogReader(self.options["path"], int(self.options.get("start", "0")))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return _LogTail(self.options["path"], int(self.options.get("maxBytesPerTrigger", TAIL_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _LogWriter(self.options["path"])


class _LogReader(DataSourceReader):
    def __init__(self, path: str, start: int):
        self.path, self.start = path, start

    def partitions(self) -> list[InputPartition]:
        system, at = fs.FileSystem.from_uri(self.path)
        found = system.get_file_info(fs.FileSelector(at, recursive=True))
        return [InputPartition(f.path) for f in found if f.is_file and not f.base_name.startswith(("_", "."))] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is None:
            return
        system, _ = fs.FileSystem.from_uri(self.path)
        with system.open_input_file(partition.value) as raw:
            for at, to, payload in framed(io.BufferedReader(raw, 1 << 20), raw.size(), self.start):
                yield partition.value, at, to, payload


class _LogTail(DataSourceStreamReader):
    """Offsets are {path: where its next record begins}. Only whole records count, so a half-written one waits for its rest.

    A log `x.log` that was renamed to `x.log.<epoch>` keeps its offset, and a new `x.log` begins at 0.
    """

    def __init__(self, path: str, most: int):
        self.path, self.most, self.at = path, most, {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        system, at = fs.FileSystem.from_uri(self.path)
        found = system.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True))
        size = {f.path: f.size for f in found if f.is_file and not f.base_name.startswith(("_", "."))}
        begin, out = _begins_at(self.at, sorted(size)), {}
        for name, end in size.items():
            out[name] = begin[name]
            if end - begin[name] >= 4:
                with system.open_input_file(name) as raw:
                    f = io.BufferedReader(raw, 1 << 16)
                    f.seek(begin[name])
                    while out[name] + 4 <= end and out[name] - begin[name] < self.most:
                        (n,) = struct.unpack("<I", f.read(4))
                        if out[name] + 4 + n > end:
                            break
                        f.seek(n, io.SEEK_CUR)
                        out[name] += 4 + n
        self.at = out
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.at = self.at or end
        begin = _begins_at(start, sorted(end))
        return [InputPartition((name, begin[name], to)) for name, to in end.items() if to > begin[name]] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is None:
            return
        name, first, last = partition.value
        system, _ = fs.FileSystem.from_uri(self.path)
        with system.open_input_file(name) as raw:
            for at, to, payload in framed(io.BufferedReader(raw, 1 << 20), last, first):
                yield name, at, to, payload


def _begins_at(known: dict, names: list[str]) -> dict:
    """Where to go on in each of `names`, of offsets `known` before some logs were rotated."""
    out: dict[str, int] = {}
    fresh: set[str] = set()
    for name in names:
        base, _, epoch = name.rpartition(".")
        if name not in known and epoch.isdigit() and base in known and base not in fresh:
            out[name], out[base] = known[base], 0  # the first new part of a log is what it was
            fresh.add(base)
        elif name not in out:
            out[name] = known.get(name, 0)
    return out


class JsonLinesSink(DataSource):
    """format("json_lines_sink"): appends a file of JSON lines for each task below a path."""

    @classmethod
    def name(cls) -> str:
        return "json_lines_sink"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _LinesWriter(self.options["path"])


class _Part(WriterCommitMessage):
    def __init__(self, name: str):
        self.name = name


class _PartWriter(DataSourceWriter):
    """Files under hidden names, one a task, which the commit gives their own."""

    ending = ""

    def __init__(self, path: str):
        self.path = path

    def encoded(self, row) -> bytes:
        raise NotImplementedError

    def write(self, rows: Iterator) -> WriterCommitMessage:
        system, at = fs.FileSystem.from_uri(self.path)
        system.create_dir(at, recursive=True)
        name = f"_part-{uuid.uuid4().hex}{self.ending}"
        with system.open_output_stream(f"{at}/{name}") as f:
            for r in rows:
                f.write(self.encoded(r))
        return _Part(name)

    def commit(self, messages: list) -> None:
        system, at = fs.FileSystem.from_uri(self.path)
        for m in messages:
            if m is not None:
                system.move(f"{at}/{m.name}", f"{at}/{m.name[1:]}")

    def abort(self, messages: list) -> None:
        system, at = fs.FileSystem.from_uri(self.path)
        for m in messages:
            if m is not None:
                system.delete_file(f"{at}/{m.name}")


class _LinesWriter(_PartWriter):
    ending = ".json"

    def encoded(self, row) -> bytes:
        return (json.dumps(row.asDict(recursive=True), default=str) + "\n").encode()


class _LogWriter(_PartWriter):
    ending = ".log"

    def encoded(self, row) -> bytes:
        payload = bytes(row[0])
        return struct.pack("<I", len(payload)) + payload


def write_log(rows: DataFrame, path: str, column: str = "payload") -> None:
    """Appends a log file for each partition of `rows` below `path`; null payloads are left out."""
    register(rows.sparkSession)
    rows.select(F.col(column).cast("binary").alias("payload")).where("payload is not null").write.format("framed_log").mode("append").option("path", path).save()


#: Transforms by name, for pipelines put together from configuration.
TRANSFORMS: dict[str, Callable[..., Callable[[DataFrame], DataFrame]]] = {}


def transform(name: str):
    """Decorator that registers a factory of transforms for DataFrame.transform()."""

    def add(f):
        TRANSFORMS[name] = f
        return f

    return add


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FramedLogSource)
    spark.dataSource.register(JsonLinesSink)


__all__ = ["FramedLogSource", "JsonLinesSink", "TRANSFORMS", "register", "transform", "write_log"]
