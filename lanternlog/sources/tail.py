"""The growing log as a streaming source: each micro-batch reads only the bytes that were written since the one before.

`spark.dataSource.register(LogTail)`, then `spark.readStream.format("log_tail").option("path", folder).load()` gives a row for
every whole line (path, offset, next, line, reset), next being the byte after it. A file's place is its identity, the SHA-256 of up to its first 512 bytes, and
the byte after its last line feed; both are the stream's offset, so that a restart goes on where the checkpoint ends. A line
that is still being written waits. A file that has become shorter, or another one under its name, starts afresh: its first row
then has `reset` and no line, which tells that what was derived from the path no longer holds.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..workers import reach

SCHEMA = "path string, offset long, next long, line string, reset boolean"
IDENTITY_BYTES = 512
#: Bytes of a task's range, of a read inside it, and of a row batch that it hands over.
SPLIT, READ = 32 << 20, 1 << 20


@dataclass
class LogRange(InputPartition):
    """Lines of a file that begin in [start, stop); first and end bound what the micro-batch reads of the file."""

    path: str
    start: int
    stop: int
    first: int
    end: int
    reset: bool


def store_of(path: str):
    """(file system, path in it): any store that Arrow knows, by the address's scheme."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def log_files(path: str) -> dict[str, int]:
    """Sizes of the files of a folder, or of the one file, by path; none if nothing is there yet. Hidden files are left out."""
    from pyarrow import fs

    store, at = store_of(path)
    info = store.get_file_info(at)
    found = store.get_file_info(fs.FileSelector(at)) if info.type == fs.FileType.Directory else [info]
    return {f.path: f.size for f in found if f.type == fs.FileType.File and f.base_name[:1] not in "._"}


def identity(file, n: int) -> str:
    """SHA-256 of a file's first n bytes."""
    file.seek(0)
    return hashlib.sha256(file.read(n)).hexdigest()


def last_line_end(file, size: int) -> int:
    """The byte after the last line feed before size, 0 if there is none; only the last part of the file is read."""
    end = size
    while end > 0:
        start = max(0, end - READ)
        file.seek(start)
        at = file.read(end - start).rfind(b"\n")
        if at >= 0:
            return start + at + 1
        end = start
    return 0


def lines_of(file, part: LogRange) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of the lines that begin in a range. A range inside a file skips the line that an earlier one holds, and a
    line that goes on beyond the range is read to its end. No byte outside [first, end) is read."""
    at = part.start - (part.start > part.first)  # whether a line begins here shows the byte before
    file.seek(at)
    held, skip = b"", at < part.start
    while at < part.end:
        chunk = file.read(min(READ, part.end - at - len(held)))
        if not chunk:
            return
        *lines, held = (held + chunk).split(b"\n")
        for line in lines:
            if not skip:
                if at >= part.stop:
                    return
                yield at, line
            skip = False
            at += len(line) + 1


def batches_of(part: LogRange, path: str) -> Iterator:
    """The rows of a range as Arrow batches."""
    import pyarrow as pa

    kinds = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("next", pa.int64()), ("line", pa.string()), ("reset", pa.bool_())])
    offsets, ends, lines, size = [], [], [], 0

    def batch():
        return pa.record_batch([[part.path] * len(lines), offsets, ends, lines, [part.reset] * len(lines)], schema=kinds)

    if part.reset:
        offsets, ends, lines = [0], [0], [None]
        yield batch()
        return
    store, _ = store_of(path)
    with store.open_input_file(part.path) as f:
        for at, line in lines_of(f, part):
            offsets.append(at)
            ends.append(at + len(line) + 1)
            lines.append(line.removesuffix(b"\r").decode("utf-8", "replace"))
            size += len(line)
            if size >= READ or len(lines) >= 10_000:
                yield batch()
                offsets, ends, lines, size = [], [], [], 0
    if lines:
        yield batch()


def ranges(path: str, first: int, end: int, split: int) -> list[LogRange]:
    return [LogRange(path, a, min(a + split, end), first, end, False) for a in range(first, end, split)]


class LogTailReader(DataSourceStreamReader):
    """Offsets are {path: "identity bytes end"}: the identity covers that many bytes, so that a file which was short when it was
    first seen is known again once it has grown. A file that is away for a while keeps its place."""

    def __init__(self, path: str, split: int):
        self.path, self.split, self.last = path, split, {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        store, _ = store_of(self.path)
        for path, size in sorted(log_files(self.path).items()):
            n = min(size, IDENTITY_BYTES)
            with store.open_input_file(path) as f:
                self.last[path] = f"{identity(f, n)} {n} {last_line_end(f, size)}"
        return dict(self.last)

    def goes_on(self, path: str, old: str, end: int) -> bool:
        """Whether the file is the one that a former offset tells of, and no shorter."""
        known, n, at = old.split()
        if int(at) > end:
            return False
        store, _ = store_of(self.path)
        with store.open_input_file(path) as f:
            return identity(f, int(n)) == known

    def partitions(self, start: dict, end: dict) -> list[LogRange]:
        self.last = {**start, **self.last}
        out = []
        for path, now in end.items():
            old, stop, first = start.get(path), int(now.split()[2]), 0
            if old == now:
                continue
            if old and self.goes_on(path, old, stop):
                first = int(old.split()[2])
            elif old:
                out.append(LogRange(path, 0, 0, 0, 0, True))
            out += ranges(path, first, stop, self.split)
        return out

    def read(self, partition: LogRange) -> Iterator:
        return batches_of(partition, self.path)


class LogBatchReader(DataSourceReader):
    """What stands in the files now, or below the given bytes of some of them."""

    def __init__(self, path: str, split: int, below: dict[str, int] | None):
        self.path, self.split, self.below = path, split, below

    def partitions(self) -> list[LogRange]:
        store, _ = store_of(self.path)
        out = []
        for path, size in sorted(log_files(self.path).items()):
            if self.below is None:
                with store.open_input_file(path) as f:
                    out += ranges(path, 0, last_line_end(f, size), self.split)
            else:
                out += ranges(path, 0, min(size, self.below.get(path, 0)), self.split)
        return out

    def read(self, partition: LogRange) -> Iterator:
        return batches_of(partition, self.path)


class LogTail(DataSource):
    """Options: path (a file or a folder of logs; any address that Arrow's file systems know), split (bytes of a task) and, for
    a batch, below ({path: byte} as JSON: only these files, up to there)."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> LogTailReader:
        return LogTailReader(self.options["path"], int(self.options.get("split", SPLIT)))

    def reader(self, schema) -> LogBatchReader:
        below = self.options.get("below")
        return LogBatchReader(self.options["path"], int(self.options.get("split", SPLIT)), json.loads(below) if below else None)


def tail(spark, path: str, split: int = SPLIT):
    """The stream of a log file or folder."""
    reach(spark).dataSource.register(LogTail)
    return spark.readStream.format("log_tail").option("path", path).option("split", split).load()


def landed(spark, path: str, below: dict[str, int] | None = None, split: int = SPLIT):
    """The same rows of what stands in the files now; below: only those before the given byte of each file named."""
    reach(spark).dataSource.register(LogTail)
    reader = spark.read.format("log_tail").option("path", path).option("split", split)
    return (reader if below is None else reader.option("below", json.dumps(below))).load()
