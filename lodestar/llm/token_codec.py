"""Token ids in a compact binary store: static range asymmetric numeral systems (rANS).

A store is a folder with two Parquet tables:
- `table`: (token, frequency), the frequencies of all tokens scaled to a sum of 2**SCALE;
- `blocks`: a row a block of up to BLOCK tokens, coded by LANES interleaved states of 64 bits that
  emit words of 32 bits. Each row is a checkpoint: segment, number, place of its first token, final
  states, words, crc32 of its ids, and the documents that begin in it, so any block is decoded by
  itself and in parallel with all others.

Documents are in ascending order of their ids over the segments, as many segments as the range
sort makes. A document may run over any number of blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_table, materialize, scratch_dir
from .tokens import TokenEncoder

SCALE, LANES, BLOCK, AT_ONCE = 20, 128, 1 << 15, 32
LOW = np.uint64(1 << 31)

RAW = "segment int, block int, first long, n_tokens int, ids binary, head int, head_start long, doc_ids array<long>, doc_lengths array<long>"
CODED = "segment int, block int, first long, n_tokens int, states binary, words binary, crc32 long, head int, head_start long, doc_ids array<long>, doc_lengths array<long>"


def scaled(tokens: np.ndarray, counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Frequencies of at least 1 that sum to 2**scale."""
    total = 1 << scale
    if len(tokens) > total // 2:
        raise ValueError("more distinct tokens than the table has room for")
    f = np.maximum(1, (counts.astype(np.float64) * total / max(1, counts.sum())).astype(np.int64))
    while (off := total - int(f.sum())) and len(f):
        order = np.argsort(-f, kind="stable")
        step = max(1, abs(off) // len(f))
        for i in order:
            if not off:
                break
            change = min(step, off) if off > 0 else -min(step, -off, int(f[i]) - 1)
            f[i] += change
            off -= change
    return f


class Table:
    """Coding and decoding tables; of the vocabulary's size."""

    def __init__(self, tokens: np.ndarray, frequencies: np.ndarray):
        size = int(tokens.max()) + 1 if len(tokens) else 1
        self.f = np.zeros(size, dtype=np.uint64)
        self.f[tokens] = frequencies
        self.c = np.concatenate([[0], np.cumsum(self.f)[:-1]]).astype(np.uint64)
        self.at = np.repeat(np.arange(size, dtype=np.uint32), self.f.astype(np.int64))
        self.pad = int(np.argmax(self.f))

    def encode(self, ids: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """ids: blocks x tokens, tokens a multiple of LANES. Final states and each block's words."""
        blocks, n = ids.shape
        steps = n // LANES
        lanes = ids.reshape(blocks, steps, LANES)
        x = np.full((blocks, LANES), LOW, dtype=np.uint64)
        out, put = np.empty((steps, blocks, LANES), dtype=np.uint32), np.empty((steps, blocks, LANES), dtype=bool)
        most, scale, word = np.uint64(63 - SCALE), np.uint64(SCALE), np.uint64(32)
        for t in range(steps - 1, -1, -1):
            f, c = self.f[lanes[:, t]], self.c[lanes[:, t]]
            full = x >= (f << most)
            put[t], out[t] = full, x
            x = np.where(full, x >> word, x)
            q = x // f
            x = (q << scale) + (x - q * f) + c
        return x, [out[:, b][put[:, b]] for b in range(blocks)]

    def decode(self, states: np.ndarray, words: list[np.ndarray], steps: int) -> np.ndarray:
        blocks = len(words)
        starts = np.concatenate([[0], np.cumsum([len(w) for w in words])])
        stream = np.concatenate([*words, np.zeros(1, np.uint32)]).astype(np.uint64)
        at, end = starts[:-1].copy(), starts[1:]
        x = states.copy()
        ids = np.empty((blocks, steps, LANES), dtype=np.uint32)
        mask, scale, word = np.uint64((1 << SCALE) - 1), np.uint64(SCALE), np.uint64(32)
        for t in range(steps):
            slot = x & mask
            s = self.at[slot]
            ids[:, t] = s
            x = self.f[s] * (x >> scale) + slot - self.c[s]
            low = x < LOW
            taken = np.cumsum(low, axis=1)
            place = np.minimum(at[:, None] + taken - 1, len(stream) - 1)
            x = np.where(low, (x << word) | stream[place], x)
            at += taken[:, -1]
        if (at != end).any() or (x != LOW).any():
            raise ValueError("a token block is damaged")
        return ids.reshape(blocks, steps * LANES)


def _padded(n: int) -> int:
    return -(-n // LANES) * LANES


def raw_blocks(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Blocks of plain ids; each partition of `docs` (doc_id, text; in order) is a segment."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, segment, end = TokenEncoder.shared(tokenizer), TaskContext.get().partitionId(), int(end_id).to_bytes(4, "little")
        waiting, block, first, doc_ids, lengths = bytearray(), 0, 0, [], []
        head, head_start, total = 0, 0, 0

        def row(ids: bytes) -> dict:
            flat = np.frombuffer(bytes(ids), dtype="<u4")
            narrow = flat.astype("<u2").tobytes() if flat.max() < 1 << 16 else flat.tobytes()
            return {"segment": segment, "block": block, "first": first, "n_tokens": len(flat), "ids": narrow, "head": head, "head_start": head_start, "doc_ids": doc_ids, "doc_lengths": lengths}

        for batch in batches:
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1)), strict=True):
                ids += end
                n = len(ids) // 4
                doc_ids.append(doc)
                lengths.append(n)
                waiting += ids
                while len(waiting) >= 4 * BLOCK:
                    rows.append(row(waiting[: 4 * BLOCK]))
                    del waiting[: 4 * BLOCK]
                    block, first, doc_ids, lengths = block + 1, first + BLOCK, [], []
                    head_start, head = total, min(total + n - first, BLOCK)
                total += n
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_schema(RAW))
        if waiting:
            yield pa.RecordBatch.from_pylist([row(waiting)], schema=_schema(RAW))

    return docs.mapInArrow(cut, RAW)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(n, kinds[k]) for n, k in (x.split(" ") for x in ddl.split(", "))])


def _flat(ids: bytes, n_tokens: int) -> np.ndarray:
    """The ids of a raw block, which holds them in two bytes each where they fit."""
    return np.frombuffer(ids, dtype="<u2" if len(ids) == 2 * n_tokens else "<u4")


def token_counts(blocks: DataFrame) -> DataFrame:
    """(token, n) over all blocks; each task sends one row a distinct token."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for ids, n in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                found = np.bincount(_flat(ids.as_buffer(), n))
                if len(found) > len(total):
                    found[: len(total)] += total
                    total = found
                else:
                    total[: len(found)] += found
        tokens = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int32()), pa.array(total[tokens], pa.int64())], names=["token", "n"])

    return blocks.select("ids", "n_tokens").mapInArrow(count, "token int, n long").groupBy("token").agg(F.sum("n").alias("n"))


def encode_blocks(blocks: DataFrame, shared) -> DataFrame:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(*shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                rows = batch.slice(at, AT_ONCE).to_pylist()
                for size in {_padded(r["n_tokens"]) for r in rows}:
                    same = [r for r in rows if _padded(r["n_tokens"]) == size]
                    ids = np.full((len(same), size), table.pad, dtype=np.uint32)
                    for i, r in enumerate(same):
                        ids[i, : r["n_tokens"]] = _flat(r["ids"], r["n_tokens"])
                    states, words = table.encode(ids)
                    out = [{k: v for k, v in r.items() if k != "ids"} | {"states": s.astype("<u8").tobytes(), "words": w.astype("<u4").tobytes(), "crc32": zlib.crc32(_flat(r["ids"], r["n_tokens"]).astype("<u4").tobytes())} for r, s, w in zip(same, states, words, strict=True)]
                    yield pa.RecordBatch.from_pylist(out, schema=_schema(CODED))

    return blocks.mapInArrow(encode, CODED)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Tokenize documents (null text: empty), in ascending id order (null last), into a store at `path`."""
    spark = docs.sparkSession
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    raw = materialize(raw_blocks(chosen.repartitionByRange(*order).sortWithinPartitions(*order), tokenizer, end_id), "lz4")
    counts = token_counts(raw).collect()  # a row a token of the vocabulary at most
    tokens, n = np.array([r.token for r in counts], dtype=np.int64), np.array([r.n for r in counts], dtype=np.int64)
    order_ = np.argsort(tokens)
    tokens, frequencies = tokens[order_], scaled(tokens[order_], n[order_])
    spark.createDataFrame([(int(t), int(f)) for t, f in zip(tokens, frequencies, strict=True)], "token int, frequency long").coalesce(1).write.parquet(f"{path}/table")
    shared = spark.sparkContext.broadcast((tokens, frequencies))
    encode_blocks(raw, shared).write.option("compression", "none").parquet(f"{path}/blocks")
    drop_table(raw)


def _table(spark: SparkSession, path: str):
    rows = spark.read.schema("token int, frequency long").parquet(f"{path}/table").collect()  # of the vocabulary's size
    rows.sort()
    return spark.sparkContext.broadcast((np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=np.int64)))


def decoded(batch: pa.RecordBatch, table: Table) -> Iterator[tuple[dict, np.ndarray]]:
    """Each block's row and its ids; raises if a checksum doesn't hold."""
    for at in range(0, batch.num_rows, AT_ONCE):
        rows = batch.slice(at, AT_ONCE).to_pylist()
        for size in sorted({_padded(r["n_tokens"]) for r in rows}):
            same = [r for r in rows if _padded(r["n_tokens"]) == size]
            states = np.stack([np.frombuffer(r["states"], dtype="<u8") for r in same])
            ids = table.decode(states, [np.frombuffer(r["words"], dtype="<u4") for r in same], size // LANES)
            for r, own in zip(same, ids, strict=True):
                own = own[: r["n_tokens"]].astype("<u4")
                if zlib.crc32(own.tobytes()) != r["crc32"]:
                    raise ValueError(f"checksum of block {r['block']} in segment {r['segment']} doesn't hold")
                yield r, own


PIECE = "segment int, begins long, block int, doc_id long, n_tokens long, length long, crc32 long, ids binary"


def read_pieces(spark: SparkSession, path: str, with_ids: bool) -> DataFrame:
    """The part of each document in each block."""
    shared = _table(spark, path)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(*shared.value)
        for batch in batches:
            out = []
            for r, ids in decoded(batch, table):
                at = r["head"]
                parts = [(r["head_start"], None, None, 0, at)] * bool(at)
                for doc, n in zip(r["doc_ids"], r["doc_lengths"], strict=True):
                    parts.append((r["first"] + at, doc, n, at, min(at + n, r["n_tokens"])))
                    at += n
                for begins, doc, n, lo, hi in parts:
                    raw = ids[lo:hi].tobytes()
                    out.append((r["segment"], begins, r["block"], doc, n, hi - lo, zlib.crc32(raw), raw if with_ids else None))
            columns = list(zip(*out, strict=True)) or [[]] * 8
            schema = _schema(PIECE)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    stored = spark.read.schema(CODED).parquet(f"{path}/blocks").select(*[x.split(" ")[0] for x in CODED.split(", ")])
    return stored.mapInArrow(read, PIECE)


def crc32_concat(a: int, b: int, n: int) -> int:
    """crc32 of a text from those of its two parts, the second of `n` bytes."""
    if n <= 0:
        return a

    def times(matrix: list[int], v: int) -> int:
        out, i = 0, 0
        while v:
            if v & 1:
                out ^= matrix[i]
            v >>= 1
            i += 1
        return out

    square = lambda m: [times(m, row) for row in m]
    shift = [0xEDB88320, *(1 << i for i in range(31))]  # one zero bit
    shift = square(square(square(shift)))  # one zero byte
    while n:
        if n & 1:
            a = times(shift, a)
        n >>= 1
        shift = square(shift) if n else shift
    return a ^ b


def read_documents(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row a document of a store: doc_id, start, n_tokens, ids_crc32 (and ids, little-endian).

    `start` counts the ids of all documents before it. Only documents that run over a block's end
    are shuffled.
    """
    pieces = read_pieces(spark, path, with_ids)
    whole = F.col("doc_id").isNotNull() & (F.col("n_tokens") == F.col("length")) | F.col("doc_id").isNull() & F.col("n_tokens").isNotNull() & (F.col("n_tokens") == F.col("length"))
    part = F.struct("block", "length", "crc32", "ids")
    marked = materialize(pieces.withColumn("whole", F.coalesce(whole, F.lit(False))), "lz4")
    split = marked.filter(~F.col("whole")).groupBy("segment", "begins").agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.sort_array(F.collect_list(part)).alias("parts"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                crc, n = 0, 0
                for p in r["parts"]:
                    crc, n = crc32_concat(crc, p["crc32"], 4 * p["length"]) if n else p["crc32"], n + p["length"]
                if n != r["n_tokens"]:
                    raise ValueError("a document's blocks are not all there")
                out.append((r["segment"], r["begins"], r["doc_id"], n, crc, b"".join(p["ids"] for p in r["parts"]) if with_ids else None))
            schema = _schema(JOINED)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out, strict=True)) or [[]] * 6, schema, strict=True)], schema=schema)

    JOINED = "segment int, begins long, doc_id long, n_tokens long, ids_crc32 long, ids binary"
    one = marked.filter("whole").select("segment", "begins", "doc_id", "n_tokens", F.col("crc32").alias("ids_crc32"), "ids")
    documents = one.unionByName(split.mapInArrow(join, JOINED))
    sizes = spark.read.schema(CODED).parquet(f"{path}/blocks").groupBy("segment").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)  # a row a segment
    offsets = sizes.select("segment", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    out = documents.join(offsets, "segment").select("doc_id", (F.col("offset") + F.col("begins")).alias("start"), "n_tokens", "ids_crc32", "ids")
    return out if with_ids else out.drop("ids")


def encode_and_read(docs: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Write a store (in the shared folder unless `path` is given) and read its documents back.

    Null or empty text is the end id alone; null ids come last; repeated rows are kept; an empty
    table makes a store without blocks.
    """
    path = path or scratch_dir(docs.sparkSession)
    write_tokens(docs, path, tokenizer, end_id)
    return read_documents(docs.sparkSession, path)
