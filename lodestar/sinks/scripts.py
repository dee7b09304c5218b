"""Rewritten scripts back to their files, in the encoding they came in, with a backup of what was there."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame

WRITTEN = "path string, status string, bytes long"


def write_back(scripts: DataFrame, suffix: str = ".orig") -> DataFrame:
    """path, status, bytes: writes scripts (path, encoding, text, applied) to their paths; runs when the result is read.

    Only scripts with applied edits are written. What was there is kept under the path with `suffix`,
    unless such a file is there already (of an earlier pass: the first original counts). The new text is
    written beside the file and then moved over it, so a reader sees the old file or the new one whole,
    and a task that runs again does no harm. A text that its encoding can't express is not written:
    status `unencodable`. Other statuses: written, unchanged, missing. Paths are those of a file system
    that pyarrow can open, mounted for all executors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [_write(*row, suffix) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for s, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names=["path", "status", "bytes"])

    return scripts.select("path", "encoding", "text", "applied").mapInArrow(run, WRITTEN)


def _write(path: str, encoding: str, text: str | None, applied: int, suffix: str) -> tuple[str, int]:
    if not applied:
        return "unchanged", 0
    try:
        content = (text or "").encode(encoding)
    except UnicodeEncodeError:
        return "unencodable", 0
    store, place = fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")
    if store.get_file_info(place).type == fs.FileType.NotFound:
        return "missing", 0
    with store.open_input_stream(place) as f:
        if f.read() == content:
            return "written", len(content)  # by an earlier try
    if store.get_file_info(place + suffix).type == fs.FileType.NotFound:
        store.copy_file(place, place + suffix)
    with store.open_output_stream(place + ".new") as f:
        f.write(content)
    store.move(place + ".new", place)
    return "written", len(content)
