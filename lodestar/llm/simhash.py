"""Near-duplicate documents by SimHash: an inverted index on byte positions with count filtering.

A fingerprint of 64 bits is eight positional bytes. Two fingerprints that differ in at most three
bits share at least five of them, so at least four of the first seven. The lists of the index are
those of four positions with their bytes (35 a fingerprint), the meeting of four lists of single
bytes: a list of one position would hold a 256th of the corpus. Pairs of a list are tallied for
the bytes they share, kept at five or more, and verified by the bits that differ.

A list of more than `wide` fingerprints is not expanded into pairs. Its members are compared with
the fingerprint of the most documents; where they still have several components, the four bytes
they don't share are taken as eight units of half the width, and the same index is built on these:
four bits wide, then two. What shares a list of the last index differs in eight bits at most, so
there a list has at most 256 members, whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialize
from .components import components
from .hashing import mixed, texts_of

UNITS, APART = 8, 3
SHARED = UNITS - APART
#: Four of the first seven units: of five shared ones at most one is the eighth.
TUPLES = list(combinations(range(UNITS - 1), SHARED - 1))
SALTS = 1024


def fingerprint(text: bytes, words: int = 3) -> int:
    """SimHash over the XXH64 (seed 42) of each shingle, repeats included; with fewer words, of all of them as one; 0 without words."""
    found = text.lower().split()  # of bytes: A-Z, and white space as in [\x20\x09-\x0D]
    if not found:
        return 0
    line = b" ".join(found)
    width = min(words, len(found))
    ends = np.cumsum(np.fromiter((len(w) + 1 for w in found), dtype=np.int64, count=len(found))) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    first, last = starts[: len(found) - width + 1].tolist(), ends[width - 1 :].tolist()
    set_bits = np.zeros(64, dtype=np.int64)
    for at in range(0, len(first), 1 << 16):
        part = zip(first[at : at + (1 << 16)], last[at : at + (1 << 16)], strict=True)
        hashes = np.array([xxhash.xxh64_intdigest(line[a:b], 42) for a, b in part], dtype=">u8")
        set_bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > len(first)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(doc_id, fp): the fingerprint of each whole text as a signed 64-bit number."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(t, words) for t in texts_of(batch.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(each, "doc_id long, fp long")


def postings(rows: DataFrame, width: int) -> DataFrame:
    """One row for each list of a fingerprint: key (the list), last (the last of its positions), fp, docs, value, rest (the units that the list doesn't fix)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.uint64((1 << width) - 1)
        for batch in batches:
            if not batch.num_rows:
                continue
            key, value = (batch.column(i).to_numpy().view(np.uint64) for i in (0, 3))
            units = [(value >> np.uint64(width * p)) & mask for p in range(UNITS)]
            keys, rests = [], []
            for k, places in enumerate(TUPLES):
                listed, rest = mixed(key * np.uint64(len(TUPLES)) + np.uint64(k + 1)), np.zeros_like(value)
                for p in places:
                    listed = mixed(listed + units[p] + np.uint64(1))
                for p in (p for p in range(UNITS) if p not in places):
                    rest = (rest << np.uint64(width)) | units[p]
                keys.append(listed.view(np.int64))
                rests.append(rest.view(np.int64))
            last = np.repeat(np.array([t[-1] for t in TUPLES], dtype=np.int32), batch.num_rows)
            carried = [pa.array(np.tile(batch.column(i).to_numpy(), len(TUPLES))) for i in (1, 2, 3, 4)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(last), *carried, pa.array(np.concatenate(rests))], names=["key", "last", "fp", "docs", "value", "root", "rest"])

    return rows.select("key", "fp", "docs", "value", "root").mapInArrow(each, "key long, last int, fp long, docs long, value long, root long, rest long")


def _shares(a: str, b: str, width: int) -> list[Column]:
    """Per unit: 1 where both have it alike."""
    x = F.col(f"{a}.value").bitwiseXOR(F.col(f"{b}.value"))
    return [(F.shiftrightunsigned(x, width * p).bitwiseAND((1 << width) - 1) == 0).cast("int") for p in range(UNITS)]


def _near(a: str, b: str, apart: int) -> Column:
    return F.bit_count(F.col(f"{a}.fp").bitwiseXOR(F.col(f"{b}.fp"))) <= apart


def short_list_links(lists: DataFrame, width: int, apart: int) -> DataFrame:
    """Links (u, v) between members of a list with different roots: tallied, at five shared units or more, verified.

    A pair is taken in the first list that it shares only: that with its first four shared positions.
    """
    a, b = lists.alias("a"), lists.alias("b")
    same = _shares("a", "b", width)
    tally = sum(same[1:], same[0])
    upto = sum((F.when(F.col("a.last") >= p, s).otherwise(0) for p, s in enumerate(same[1:], 1)), same[0])
    met = (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")) & (F.col("a.root") != F.col("b.root"))
    kept = a.join(b, met & (tally >= SHARED) & (upto == SHARED - 1) & _near("a", "b", apart))
    return kept.select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))


def long_list_links(lists: DataFrame, apart: int) -> DataFrame:
    """Links (u, v) of the members of a list with its pivot, the fingerprint of the most documents."""
    pivots = lists.groupBy("key").agg(F.max(F.struct("docs", "fp", "root")).alias("p")).select("key", "p.fp", "p.root")
    a, b = lists.alias("a"), pivots.alias("b")
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.root") != F.col("b.root")) & _near("a", "b", apart))
    return met.select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))


def linked(fps: DataFrame, apart: int = APART, wide: int = 64) -> DataFrame:
    """(u, root) of the distinct fingerprints (fp, docs) that are linked with a smaller one of their component."""
    rows = fps.select(F.lit(0).cast("long").alias("key"), "fp", "docs", F.col("fp").alias("value"), F.col("fp").alias("root"))
    roots, width = None, 8
    while True:
        posted = materialize(postings(rows, width), "lz4")
        several = posted.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo != hi")
        lists = materialize(posted.join(several.select("key", "size"), "key"), "lz4")
        drop_table(posted)
        most = wide if width > 2 else 1 << 8
        links = short_list_links(lists.filter(F.col("size") <= most), width, apart).union(long_list_links(lists.filter(F.col("size") > most), apart))
        if roots is not None:  # the stars found so far stand for all their links
            links = links.union(roots.select("u", F.col("root").alias("v")))
        roots = components(links)
        left = lists.filter(F.col("size") > most)
        if width == 2 or left.isEmpty():
            return roots
        now = left.drop("root").join(roots.withColumnRenamed("u", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        open_ = now.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo != hi").select("key")
        rows = materialize(now.join(open_, "key").select("key", "fp", "docs", F.col("rest").alias("value"), "root"), "lz4")
        drop_table(lists)
        width //= 2


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, apart: int = APART, wide: int = 64) -> DataFrame:
    """One row a document: doc_id, fingerprint (16 hex digits), component_id, kept.

    Fingerprints link at `apart` (at most 3) or fewer differing bits; component_id is the smallest
    id reachable, null after all others; `kept` marks documents with that id. Texts that are null,
    empty or without words have the fingerprint zero and are linked like any other. Repeated rows
    are documents of their own with one fingerprint; an empty table gives no rows; other columns are
    not read.
    """
    if not 0 <= apart <= APART:
        raise ValueError(f"apart must be 0 to {APART}: the index is built for that")
    signed = materialize(fingerprints(docs, id_col, text_col, words), "lz4").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    # A fingerprint of many documents is dealt to salts; only a row a salt meets.
    salted = materialize(signed.groupBy("fp", "salt").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("docs")), "lz4")
    roots = linked(salted.groupBy("fp").agg(F.sum("docs").alias("docs")), apart, wide)
    placed = salted.join(roots.withColumnRenamed("u", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    known = placed.select("fp", "salt", "root").join(least, "root").select("fp", "salt", "component_id")
    found = signed.join(known, ["fp", "salt"])
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
