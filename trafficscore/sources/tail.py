"""Growing log files as a stream of lines (Python data source ``log_tail``).

Spark's file sources read a file once, when it appears.  A capture log grows: this
source's offset is (file, byte), so lines appended between two batches come once,
also over restarts.

* A new query starts at the end of the files that are there (``start`` = ``end``; or
  ``start`` = ``begin``).  Files that appear later are read from their first line.
* A batch ends at a line end; an unfinished line comes when it is finished.
* A file is known by its first lines' checksums.  Where they change, or where the file
  is shorter than what was read of it, it was replaced, and is read from its first line.
  Lines of the replaced file that no batch had reached are gone, as with any tail by name.
* A batch of many bytes is read by several tasks, each taking the lines that start in its
  range; the driver reads only the last bytes and the first lines of each file.

Files are opened by ``pyarrow.fs`` (local or shared paths, HDFS, object stores), never by
path names of one machine only; ``path`` is a file or a folder (not searched below).  For
many files that don't grow, use Spark's own text source.

Columns: ``value`` (line without its end; bytes that aren't UTF-8 are replaced), ``file``,
``at`` (the line's first byte).  A batch that runs again after its file was replaced
can't be read again: it fails, or with ``failOnDataLoss`` = ``false`` leaves those lines out.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

BLOCK = 1 << 16              # bytes read at a time when looking for line ends
SPLIT = 32 << 20             # bytes of one task
KNOWN_BY = 4                 # first lines that tell a file from its replacement
BATCH_BYTES = 4 << 20        # text of one Arrow batch
_ARROW = pa.schema([("value", pa.string()), ("file", pa.string()), ("at", pa.int64())])


@dataclass
class Span(InputPartition):
    """Bytes ``low`` .. ``high`` of a file; both are line starts or inside a line."""
    file: str
    low: int
    high: int
    first: int               # where the batch starts in the file, a line start
    lines: str               # checksums of the file's first lines


def open_filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """(file system, path in it) of a path or URI."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[len("file:"):]
    return pafs.FileSystem.from_uri(path)


def last_line_end(source, size: int) -> int:
    """Where the last finished line ends: blocks are read from the end on."""
    high = size
    while high > 0:
        low = max(0, high - BLOCK)
        at = source.read_at(high - low, low).rfind(b"\n")
        if at >= 0:
            return low + at + 1
        high = low
    return 0


def first_lines(source, end: int) -> str:
    """Checksums of the first lines before ``end``, ``KNOWN_BY`` at most; of a line longer than a block, its start."""
    head = source.read_at(min(end, BLOCK), 0)
    lines = head.split(b"\n")[:KNOWN_BY]
    # what stands behind the last line end isn't known whole, but for a block without any
    whole = lines[:head.count(b"\n")] or ([head] if len(head) == BLOCK else [])
    return " ".join(f"{zlib.crc32(x):08x}" for x in whole)


def same_file(was: dict, now: dict) -> bool:
    """Whether ``now`` is the file ``was``, grown or as it was."""
    old, new = was["lines"].split(), now["lines"].split()
    return now["end"] >= was["end"] and new[:len(old)] == old


class LogTailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.start = options.get("start", "end")
        if self.start not in ("end", "begin"):
            raise ValueError("start is 'end' or 'begin'")
        self.split = int(options.get("splitBytes", SPLIT))
        self.fail = str(options.get("failOnDataLoss", "true")).lower() == "true"

    def _files(self, system: pafs.FileSystem, path: str) -> list[pafs.FileInfo]:
        info = system.get_file_info(path)
        if info.type == pafs.FileType.Directory:
            found = system.get_file_info(pafs.FileSelector(path))
        else:
            found = [info]
        return sorted((f for f in found if f.type == pafs.FileType.File and f.base_name[:1] not in "._"),
                      key=lambda f: f.path)

    def initialOffset(self) -> dict:
        return self.latestOffset() if self.start == "end" else {}

    def latestOffset(self) -> dict:
        system, path = open_filesystem(self.path)
        out = {}
        for info in self._files(system, path):
            try:
                with system.open_input_file(info.path) as source:
                    end = last_line_end(source, source.size())
                    out[info.path] = {"end": end, "lines": first_lines(source, end)}
            except FileNotFoundError:
                continue            # replaced at this moment; the next trigger sees it
        return out

    def partitions(self, start: dict, end: dict) -> list[Span]:
        out = []
        for file, now in end.items():
            was = start.get(file)
            first = was["end"] if was and same_file(was, now) else 0
            out += [Span(file, low, min(low + self.split, now["end"]), first, now["lines"])
                    for low in range(first, now["end"], self.split)]
        # the engine asks for at least one partition
        return out or [Span("", 0, 0, 0, "")]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        if partition.low >= partition.high:
            return
        system, _ = open_filesystem(self.path)
        try:
            source = system.open_input_file(partition.file)
        except FileNotFoundError:
            self._lost(partition)
            return
        with source:
            known = first_lines(source, source.size()).split()[:len(partition.lines.split())]
            if source.size() < partition.high or known != partition.lines.split():
                self._lost(partition)
                return
            yield from self._lines(source, partition)

    def _lost(self, partition: Span) -> None:
        if self.fail:
            raise RuntimeError(f"{partition.file} was replaced before bytes {partition.low} to {partition.high} were read")

    def _lines(self, source, span: Span) -> Iterator[pa.RecordBatch]:
        at = span.low
        source = io.BufferedReader(source, BLOCK)
        source.seek(at)
        if at > span.first:         # the line that lies over the range's start is the previous task's
            source.seek(at - 1)
            at += len(source.readline()) - 1
        values, places, held = [], [], 0
        while at < span.high:
            line = source.readline()
            if not line:
                break
            values.append(line.removesuffix(b"\n").removesuffix(b"\r").decode("utf-8", "replace"))
            places.append(at)
            at += len(line)
            held += len(line)
            if held >= BATCH_BYTES:
                yield self._batch(values, places, span.file)
                values, places, held = [], [], 0
        if values:
            yield self._batch(values, places, span.file)

    @staticmethod
    def _batch(values: list[str], places: list[int], file: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(values, pa.string()), pa.array([file] * len(values), pa.string()),
                                           pa.array(places, pa.int64())], schema=_ARROW)


class LogTail(DataSource):
    """The data source ``log_tail``; options ``path``, ``start``, ``splitBytes``, ``failOnDataLoss``."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return "value string, file string, at long"

    def streamReader(self, schema) -> LogTailReader:
        return LogTailReader(self.options)


def tail_lines(spark: SparkSession, path: str, start: str = "end", **options) -> DataFrame:
    """Lines appended to the file ``path``, or to the files of the folder ``path``, as a stream."""
    spark.dataSource.register(LogTail)
    return spark.readStream.format(LogTail.name()).options(path=path, start=start, **options).load()
