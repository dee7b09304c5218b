"""Whole text files as rows, decoded, and their lines."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .mods import encoding_of

def decode(content: bytes) -> tuple[str, str]:
    """(encoding, text) by the rule for scripts (`mods.encoding_of`): cp1251 only where it gives Cyrillic letters."""
    encoding = encoding_of(content)
    return encoding, content.decode(encoding)


def decoded(files: DataFrame) -> DataFrame:
    """path, encoding, text of files (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [decode(c or b"") for c in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([e for e, _ in got], pa.string()), pa.array([t for _, t in got], pa.string())], names=["path", "encoding", "text"])

    return files.select("path", "content").mapInArrow(run, "path string, encoding string, text string")


def read_texts(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path, encoding, text of all files below a folder whose names match."""
    return decoded(spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root))


def newest(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path and time of the file that was changed last; of equals the last path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return files.agg(F.max(F.struct("modificationTime", "path")).alias("x")).select("x.path", "x.modificationTime")


def lines(texts: DataFrame) -> DataFrame:
    """path, line_no (from 0), raw: the lines of texts (path, text), without an empty one after the last end."""
    split = F.split(F.regexp_replace("text", r"(\r\n|[\n\x0b\f\r\x1c-\x1e\x85\u2028\u2029])\z", ""), r"\r\n|[\n\x0b\f\r\x1c-\x1e\x85\u2028\u2029]")
    return texts.select("path", F.posexplode(split).alias("line_no", "raw"))
