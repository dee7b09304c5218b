"""Best-fit-decreasing packing of tokenized documents into sequences of a fixed length.

Pieces are numbered within their length, so the packing depends only on how many pieces there are
of each length: at most `capacity` counts, whatever the corpus. Best fit decreasing runs over those
counts on the driver, with a segment tree over the remaining capacities that finds the tightest
open sequences in logarithmic time; equal pieces are placed in equal sequences as one run. The
plan is a list of runs (length, first rank, count, first sequence, places); tasks look their
pieces up in it. Numbering needs no shuffle of the pieces: each task counts the pieces of each
length that it writes, and only those counts meet.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .tokens import TokenEncoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


class CapacityTree:
    """Maximum over remaining capacities that have open sequences; finds the smallest one that fits."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.open = np.zeros(2 * self.leaves, dtype=bool)

    def set(self, capacity: int, open_: bool) -> None:
        i = capacity + self.leaves
        self.open[i] = open_
        while i > 1:
            i >>= 1
            self.open[i] = self.open[2 * i] or self.open[2 * i + 1]

    def tightest(self, length: int) -> int:
        """The smallest open capacity of at least `length`, or -1."""
        i = length + self.leaves
        if self.open[i]:
            return length
        while i > 1:
            if not i & 1 and self.open[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return -1


def best_fit_plan(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Runs (length, rank, n, sequence, offset, each) and the number of sequences.

    A run places the pieces of `length` with ranks [rank, rank + n) into sequences from `sequence`
    on, `each` pieces to a sequence, the first at `offset`.
    """
    tree, stock, runs, sequences = CapacityTree(capacity), {}, [], 0

    def put(remaining: int, first: int, n: int) -> None:
        if n and remaining:
            stock.setdefault(remaining, []).append((first, n))
            tree.set(remaining, True)

    for length in sorted((k for k, n in counts.items() if n), reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room < 0:
                room, each = capacity, capacity // length
                first, n = sequences, max(1, left // each)
                sequences += n
            else:
                each = room // length
                first, n = stock[room].pop()
                if not stock[room]:
                    tree.set(room, False)
            each = min(each, left)
            use = min(n, left // each)
            runs.append((length, rank, use * each, first, capacity - room, each))
            put(room - each * length, first, use)
            if room < capacity:
                put(room, first + use, n - use)
            rank += use * each
            left -= use * each
    return np.array(runs, dtype=np.int64).reshape(-1, 6), sequences


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first may be shorter than the capacity."""
    first = (n - 1) % capacity + 1
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def tokenized_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TokenEncoder.shared(tokenizer)
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        end = int(end_id).to_bytes(4, "little")
        for batch in batches:
            out: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1)), strict=True):
                ids += end
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    out.append((doc, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), part, seen[length]))
                    seen[length] += 1
            columns = list(zip(*out, strict=True)) or [[]] * 7
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return docs.mapInArrow(encode, PIECES)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null or empty text is one piece with the end token alone; repeated rows are packed each for
    itself; ids may be null; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    pieces = materialize(tokenized_pieces(chosen, tokenizer, end_id, capacity))
    by_part = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = by_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    counts = {r.length: r.n for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    plan, _ = best_fit_plan(counts, capacity)
    shared = spark.sparkContext.broadcast(plan)  # bounded by the capacity, not by the corpus
    ranked = pieces.join(firsts, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("nth")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = shared.value
        runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
        base = np.int64(1) << 40
        starts = runs[:, 0] * base + runs[:, 1]
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            run = runs[np.searchsorted(starts, length * base + rank, side="right") - 1] if len(rank) else np.zeros((0, 6), np.int64)
            nth = rank - run[:, 1]
            each = np.maximum(run[:, 5], 1)
            sequence, offset = run[:, 3] + nth // each, run[:, 4] + nth % each * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
