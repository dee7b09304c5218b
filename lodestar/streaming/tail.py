"""A streaming source that follows the newest log of a folder, as it grows and when a newer one takes its place.

    spark.dataSource.register(LogTail)
    spark.readStream.format("log_tail").option("folder", folder).option("lines", "20").load()

An offset is a file and a byte in it, so a query that starts again from its checkpoint gives each
line once. It begins with the last `lines` lines of the newest file. When a newer file appears, the
rest of the old one is read first, then the newer ones in the order of their times. Only whole lines
are given out; a line without an end waits for it. The folder has to be mounted on driver and
executors alike.
"""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "path string, at bigint, line string"
CHUNK = 1 << 16
#: Bytes of one file that one task reads.
TASK_BYTES = 64 << 20


def logs(folder: str, glob: str) -> list[str]:
    """The folder's files that match, oldest first (of equal times by name)."""
    found = []
    for entry in os.scandir(folder):
        if entry.is_file() and fnmatch.fnmatch(entry.name, glob):
            found.append((entry.stat().st_mtime_ns, entry.path))
    return [path for _, path in sorted(found)]


def whole(path: str) -> int:
    """Where the last whole line of a file ends."""
    with open(path, "rb") as f:
        at = f.seek(0, os.SEEK_END)
        while at:
            start = max(0, at - CHUNK)
            f.seek(start)
            cut = f.read(at - start).rfind(b"\n")
            if cut >= 0:
                return start + cut + 1
            at = start
    return 0


def backlog(path: str, lines: int) -> int:
    """Where the last `lines` whole lines of a file begin."""
    end = at = whole(path)
    with open(path, "rb") as f:
        left = lines + 1  # the end before the first of them
        while at:
            start = max(0, at - CHUNK)
            f.seek(start)
            block = f.read(at - start)
            while (cut := block.rfind(b"\n")) >= 0:
                left -= 1
                if not left:
                    return min(end, start + cut + 1)
                block = block[:cut]
            at = start
    return 0


class Range(InputPartition):
    """Bytes [start, end) of a file; `last` as what follows begins a line, so does `start`."""

    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def ranges(path: str, start: int, end: int) -> list[Range]:
    """A stretch of a file in pieces of about TASK_BYTES that begin and end with lines."""
    out = []
    with open(path, "rb") as f:
        while start < end:
            stop = min(end, start + TASK_BYTES)
            if stop < end:
                f.seek(stop)
                rest = f.readline(end - stop)
                stop += len(rest)
            out.append(Range(path, start, stop))
            start = stop
    return out


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder, self.glob, self.lines = options["folder"], options.get("glob", "*.log"), int(options.get("lines", "20"))

    def initialOffset(self) -> dict:
        found = logs(self.folder, self.glob)
        return {"file": found[-1], "at": backlog(found[-1], self.lines)} if found else {"file": "", "at": 0}

    def latestOffset(self) -> dict:
        found = logs(self.folder, self.glob)
        return {"file": found[-1], "at": whole(found[-1])} if found else {"file": "", "at": 0}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        if start["file"] == end["file"]:
            return ranges(end["file"], start["at"], end["at"]) if end["file"] else []
        found = logs(self.folder, self.glob)
        first = found.index(start["file"]) if start["file"] in found else -1  # a log that is gone has nothing more to give
        last = found.index(end["file"]) if end["file"] in found else len(found)
        out = ranges(start["file"], start["at"], whole(start["file"])) if first >= 0 else []
        for path in found[first + 1 : last]:
            out += ranges(path, 0, whole(path))
        return out + (ranges(end["file"], 0, end["at"]) if last < len(found) else [])

    def read(self, partition: Range) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            at = f.seek(partition.start)
            while at < partition.end:
                line = f.readline(partition.end - at)
                yield partition.path, at, line.decode("utf-8", errors="replace").rstrip("\r\n")
                at += len(line)

    def commit(self, end: dict) -> None:
        pass


class LogTail(DataSource):
    """path, at (where the line begins), line of the newest log."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)
