"""What a run leaves behind: its documents, a file a run, and overlays of the files that win."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATUS = "path string, status string, bytes long"


def documents(rows: DataFrame, run: str, name: str) -> DataFrame:
    """path (run/name), document: the other columns of each row as a JSON document; null ones are left out.

    A run's document is one row: of several for one run the first in order of its text counts.
    """
    others = [c for c in rows.columns if c != run]
    made = rows.select(F.concat(F.col(run).cast("string"), F.lit(f"/{name}")).alias("path"), F.to_json(F.struct(*others)).alias("document"))
    return made.filter("path IS NOT NULL").groupBy("path").agg(F.min("document").alias("document"))


def _store(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root if "://" in root else f"file://{root.removeprefix('file:')}")


def _replace(store: fs.FileSystem, place: str, content: bytes) -> None:
    """Write beside the file and move over it: a reader sees the old one or the new one whole, and a task that runs again does no harm."""
    store.create_dir(place.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(place + ".new") as f:
        f.write(content)
    store.move(place + ".new", place)


def _per_row(rows: DataFrame, work) -> DataFrame:
    """path, status, bytes of `work` on each row's values; runs when the result is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [work(*row) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for s, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names=["path", "status", "bytes"])

    return rows.mapInArrow(run, STATUS)


def write_documents(made: DataFrame, root: str) -> DataFrame:
    """path, status, bytes: documents (path, document) below a folder that all executors share; each replaces what was there as a whole."""

    def work(path: str, document: str) -> tuple[str, int]:
        store, base = _store(root)
        content = document.encode()
        _replace(store, f"{base}/{path}", content)
        return "written", len(content)

    return _per_row(made.select("path", "document"), work)


def overlay(winners: DataFrame, target: str) -> DataFrame:
    """path, status, bytes: copies the winning files (rel, source) to the paths `rel` of a new tree; missing sources are told.

    The tree's manifest is the winners themselves: write them with `write_manifest`.
    """

    def work(rel: str, source: str) -> tuple[str, int]:
        store, base = _store(target)
        own, place = _store(source)
        if own.get_file_info(place).type == fs.FileType.NotFound:
            return "missing", 0
        with own.open_input_stream(place) as f:
            content = f.read()
        _replace(store, f"{base}/{rel}", content)
        return "copied", len(content)

    return _per_row(winners.select("rel", "source"), work)


def write_manifest(winners: DataFrame, path: str) -> None:
    """The overlay's manifest as JSON lines in order of the path: which mod each file came from."""
    winners.repartitionByRange("rel").sortWithinPartitions("rel").write.mode("overwrite").json(path)


def added_only(before: DataFrame, after: DataFrame) -> DataFrame:
    """rel, change: how a tree (rel, sha256) differs from an earlier one: added, removed or changed; an overlay that only adds has the first kind alone."""
    a, b = before.select("rel", F.col("sha256").alias("old")), after.select("rel", F.col("sha256").alias("new"))
    both = a.join(b, "rel", "full").filter(~F.col("old").eqNullSafe(F.col("new")))
    return both.select("rel", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed").alias("change"))
