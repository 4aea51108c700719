"""JSONL files by byte ranges, at rest and as they grow.

A range [begin, end) of a file owns the lines whose newline lies in it; a reader looks back from `begin` to where its first line starts. So
files are cut anywhere without being read first, the driver plans with sizes alone, and a line that isn't finished waits for its newline.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Bytes of a range at most, and bytes read at once.
RANGE, CHUNK = 64 << 20, 4 << 20
SCHEMA = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("value", pa.string())])


@dataclass
class Range(InputPartition):
    file: str
    begin: int
    end: int
    last: bool = False  # what follows the last newline is a line too


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """Any file system that pyarrow knows: a plain path, or a URI of file, hdfs, s3, gs and others."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def sizes(folder: str) -> dict[str, int]:
    """Bytes of each *.jsonl file below a folder, whatever the case of the ending; a folder that isn't there has none."""
    system, path = _open(folder)
    found = system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
    return {f.path: f.size for f in found if f.type == fs.FileType.File and f.path.lower().endswith(".jsonl")}


def cut(file: str, begin: int, end: int, most: int) -> list[Range]:
    return [Range(file, at, min(at + most, end)) for at in range(begin, end, most)]


def _line_start(source: pa.NativeFile, at: int) -> int:
    """Where the line begins that the byte at `at` belongs to."""
    while at > 0:
        low = max(0, at - (64 << 10))
        source.seek(low)
        newline = source.read(at - low).rfind(b"\n")
        if newline >= 0:
            return low + newline + 1
        at = low
    return 0


def lines_of(system: fs.FileSystem, part: Range) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of complete lines of a range, each with the offset of its first line; a file that has become shorter has no lines beyond its end."""
    with system.open_input_file(part.file) as source:
        end = min(part.end, source.size())
        if part.begin >= end:
            return
        start = _line_start(source, part.begin)
        source.seek(start)
        held, at = b"", start
        while at + len(held) < end:
            data = source.read(min(CHUNK, end - at - len(held)))
            if not data:
                break
            held += data
            done = held.rfind(b"\n") + 1
            if done:
                yield at, held[:done].split(b"\n")[:-1]
                at, held = at + done, held[done:]
        if held and part.last:
            yield at, [held]


def _batches(folder: str, part: Range) -> Iterator[pa.RecordBatch]:
    system, _ = _open(folder)
    try:
        for start, lines in lines_of(system, part):
            offsets, at = [], start
            for line in lines:
                offsets.append(at)
                at += len(line) + 1
            yield pa.RecordBatch.from_arrays([pa.array([part.file] * len(lines), pa.string()), pa.array(offsets, pa.int64()), pa.array([line.decode("utf-8", "replace") for line in lines], pa.string())], schema=SCHEMA)
    except FileNotFoundError:
        return  # the file went after the ranges were planned


class AppendJsonl(DataSource):
    """format("append_jsonl").load(folder), by spark.read or spark.readStream: file, offset (bytes before the line), value of each line; a stream waits for a line's newline.

    Options: rangeBytes (bytes a task at most), maxBytesPerTrigger (0: no bound), progress (the streaming query's checkpoint folder, from which a
    restarted query knows how far it had come; without it the first trigger after a restart has no bound).
    """

    @classmethod
    def name(cls) -> str:
        return "append_jsonl"

    def schema(self) -> str:
        return "file string, offset bigint, value string"

    def _range(self) -> int:
        return max(1, int(self.options.get("rangeBytes", RANGE)))

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self._range())

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _StreamReader(self.options["path"], self._range(), int(self.options.get("maxBytesPerTrigger", 0)), self.options.get("progress"))


class _Reader(DataSourceReader):
    def __init__(self, folder: str, most: int):
        self.folder, self.most = folder, most

    def partitions(self) -> Sequence[InputPartition]:
        out: list[InputPartition] = []
        for file, size in sorted(sizes(self.folder).items()):
            ranges = cut(file, 0, size, self.most)
            out += [*ranges[:-1], *(Range(r.file, r.begin, r.end, True) for r in ranges[-1:])]
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _batches(self.folder, partition) if partition.file else iter(())


class _StreamReader(DataSourceStreamReader):
    """Offsets are bytes by file. A file that has become shorter is read again from its start."""

    def __init__(self, folder: str, range_bytes: int, trigger_bytes: int, progress: str | None):
        self.folder, self.range_bytes, self.trigger_bytes, self.progress = folder, range_bytes, trigger_bytes, progress
        self.planned: dict[str, int] | None = None

    def initialOffset(self) -> dict:  # noqa: N802
        self.planned = {}
        return {}

    def _restarted_at(self) -> dict[str, int] | None:
        """The newest offset in the checkpoint's log; None if there's none to be seen."""
        if not self.progress:
            return None
        system, path = _open(self.progress)
        logs = [f for f in system.get_file_info(fs.FileSelector(f"{path}/offsets", allow_not_found=True)) if f.base_name.isdigit()]
        if not logs:
            return None
        with system.open_input_stream(max(logs, key=lambda f: int(f.base_name)).path) as log:
            return json.loads(log.read().decode().split("\n")[2])

    def latestOffset(self) -> dict:  # noqa: N802
        there = sizes(self.folder)
        before = self.planned if self.planned is not None else self._restarted_at()
        if not self.trigger_bytes or before is None:
            end = there if before is None else before | there
        else:
            end, left = dict(before), self.trigger_bytes
            begins = {file: before.get(file, 0) if before.get(file, 0) <= size else 0 for file, size in there.items()}
            waiting = sorted(there, key=lambda file: (there[file] - begins[file], file))
            for k, file in enumerate(waiting):  # the same share each; what a file doesn't need goes to those with more
                end[file] = begins[file] + min(there[file] - begins[file], -(-left // (len(waiting) - k)))
                left -= end[file] - begins[file]
        self.planned = dict(sorted(end.items()))
        return self.planned

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        out = []
        for file, stop in sorted(end.items()):
            begin = int(start.get(file, 0))
            out += cut(file, begin if begin <= stop else 0, stop, self.range_bytes)
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _batches(self.folder, partition)

    def commit(self, end: dict) -> None:
        pass


def register(spark: SparkSession) -> None:
    spark.dataSource.register(AppendJsonl)


def read(spark: SparkSession, folder: str, range_bytes: int = RANGE) -> DataFrame:
    register(spark)
    return spark.read.format("append_jsonl").option("rangeBytes", str(range_bytes)).load(folder)


def follow(spark: SparkSession, folder: str, checkpoint: str, trigger_bytes: int = 0, range_bytes: int = RANGE) -> DataFrame:
    """A stream of the folder's lines for a query with this checkpoint folder and no other source."""
    register(spark)
    options = {"rangeBytes": str(range_bytes), "maxBytesPerTrigger": str(trigger_bytes), "progress": checkpoint}
    return spark.readStream.format("append_jsonl").options(**options).load(folder)
