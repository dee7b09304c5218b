"""Interpolated modified Kneser-Ney n-gram model of any order from 2, counted in Spark and memory-mapped by workers.

Training makes a folder of sorted arrays (numpy files) in the shared folder:
- words: 64-bit hashes in order, and counts; a word's id is its place in that order;
- for each length m from 2 to the order, m-grams dealt to shards by their last word but one (by their last
  two words where that one is frequent): keys in order, and counts. A key is the id of the first m - 1 words, then
  the word's id (m = 2) or the place of the last m - 1 words in the same shard; an m-gram's id is its
  place over all shards. Below the order, counts are those of distinct words before, or of
  occurrences for what begins a text;
- contexts of each shard that two words or more follow, with the total and the types seen once, twice
  and more often (a context with one word is read off the keys); contexts that end in a frequent
  word are summed over the shards and lie by their id;
- continuations: for each word id, how many contexts it follows.
Workers map the files into memory and look up sorted queries, so what a worker reads is
shared by all workers of a machine and never held in Python. Arrays grow with the corpus; no count
is pruned. All sums are exact, and tasks write their files atomically, so a task that runs again
after an executor is lost writes the same file.

The folder has to be a path that driver and executors all mount (file:// or without a scheme).
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_table, free, materialize, scratch_dir
from .hashing import mixed, some_texts, texts_of, word_hashes

END, START = np.uint64(0xE0F5E0F5E0F5E0F5), np.uint64(0x57A2757A2757A275)
FLUSH = 4_000_000
_U = np.uint64


def mounted(path: str) -> str:
    """The plain path of a folder that workers can map files of."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"{path}: the model's files are memory-mapped, so its folder has to be mounted at one path on the driver and all executors")
    return path


def _save(path: str, array: np.ndarray) -> None:
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        np.save(f, array)
    os.replace(part, path)


def sequences(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens (words, then the end) of texts one after the other, the token before each, and where texts begin (and the end)."""
    h, at = word_hashes(texts)
    n = len(texts)
    begins = at + np.arange(n + 1)
    tokens = np.empty(len(h) + n, dtype=np.uint64)
    ends = begins[1:] - 1
    is_word = np.ones(len(tokens), dtype=bool)
    is_word[ends] = False
    tokens[is_word], tokens[ends] = h, END
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[begins[:-1]] = START
    return tokens, before, begins


def _counted(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.ones(len(keys), dtype=bool)
    first[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(first)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


def _pairs(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], names=["k", "c"])


def _packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys as differences, and counts, by planes of bytes."""
    steps = np.diff(keys, prepend=_U(0))
    planes = [np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T) for x in (steps, counts)]
    return len(keys).to_bytes(8, "little") + pa.compress(b"".join(planes), codec="zstd", asbytes=True)


def _length(blob: bytes) -> int:
    return int.from_bytes(blob[:8], "little")


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = _length(blob)
    planes = np.frombuffer(pa.decompress(blob[8:], decompressed_size=16 * n, codec="zstd", asbytes=True), dtype=np.uint8).reshape(2, 8, n)
    steps, counts = [np.ascontiguousarray(x.T).view("<u8").ravel() for x in planes]
    return np.cumsum(steps, dtype=np.uint64), counts.astype(np.int64)


def _tally(batches: Iterator[pa.RecordBatch], keys_of) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct keys and counts of all texts, given out whenever they are many."""
    held, n = [], 0
    for batch in batches:
        for _, texts in some_texts(texts_of(batch.column(0))):
            keys = keys_of(*sequences(texts)[:2])
            held.append(np.unique(keys, return_counts=True))
            n += len(held[-1][0])
            if n >= FLUSH:
                yield _counted(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
                held, n = [], 0
    if held:
        yield _counted(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))


def _dealt(batches: Iterator[pa.RecordBatch], places_of) -> Iterator[pa.RecordBatch]:
    """Rows (shard, packed keys and counts) of all texts, a row a shard whenever keys are many."""
    held, n = [], 0

    def rows() -> pa.RecordBatch:
        of: dict[int, list] = {}
        for parts in held:
            for s, k, c in parts:
                of.setdefault(s, []).append((k, c))
        merged = {s: _counted(*[np.concatenate(x) for x in zip(*parts, strict=True)]) for s, parts in of.items()}
        return pa.RecordBatch.from_arrays([pa.array(list(merged), pa.int32()), pa.array([_packed(*kc) for kc in merged.values()], pa.binary())], names=["shard", "blob"])

    for batch in batches:
        for _, texts in some_texts(texts_of(batch.column(0)), 1 << 22):
            shard, keys = places_of(*sequences(texts)[:2])
            order = np.argsort(shard, kind="stable")
            keys = keys[order]
            edges = np.concatenate([[0], np.cumsum(np.bincount(shard))])
            held.append([(s, *np.unique(keys[lo:hi], return_counts=True)) for s, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if hi > lo])
            n += sum(len(k) for _, k, _ in held[-1])
            if n >= FLUSH:
                yield rows()
                held, n = [], 0
    if held:
        yield rows()


class Words:
    """The words' arrays: hashes in order, counts, and how many contexts each follows."""

    def __init__(self, path: str, info: dict):
        self.parts = [(np.load(f"{path}/words-{s}.npy", mmap_mode="r"), np.load(f"{path}/counts-{s}.npy", mmap_mode="r")) if n else None for s, n in enumerate(info["words"])]
        self.first = np.concatenate([[0], np.cumsum(info["words"])])
        self.bits = _U(64 - (len(info["words"]).bit_length() - 1))
        self.size = int(self.first[-1])

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Id (-1: unknown) and count of each hash."""
        asked, back = np.unique(hashes, return_inverse=True)
        ids, counts = np.full(len(asked), -1, dtype=np.int64), np.zeros(len(asked), dtype=np.int64)
        edges = np.searchsorted(asked >> self.bits, np.arange(len(self.parts) + 1, dtype=np.uint64))
        for s, part in enumerate(self.parts):
            lo, hi = edges[s], edges[s + 1]
            if part is not None and hi > lo:
                at = np.minimum(np.searchsorted(part[0], asked[lo:hi]), len(part[0]) - 1)
                found = part[0][at] == asked[lo:hi]
                ids[lo:hi] = np.where(found, at + self.first[s], -1)
                counts[lo:hi] = np.where(found, part[1][at], 0)
        return ids[back], counts[back]


def _map(path: str, name: str, m: int, s: int) -> np.ndarray:
    return np.load(f"{path}/{name}-{m}-{s}.npy", mmap_mode="r")


def _shifted(ids: np.ndarray, starts: np.ndarray, at_start: int) -> np.ndarray:
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[starts] = at_start
    return before


def _by_place(shard: np.ndarray, keys: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each shard, the places of its keys in the keys' order."""
    order = np.argsort(keys)
    order = order[np.argsort(shard[order].astype(np.uint16 if shards < 1 << 16 else np.int64), kind="stable")]
    edges = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in np.flatnonzero(edges[1:] > edges[:-1]):
        yield int(s), order[edges[s] : edges[s + 1]]


class Level:
    """The m-grams of one length; `below` are those one word shorter (None: words)."""

    def __init__(self, path: str, info: dict, m: int, below: Level | None, finished: bool = True):
        own = info["levels"][m - 2]
        self.path, self.m, self.below, self.shards, self.bits = path, m, below, len(own["sizes"]), _U(own["bits"])
        self.first = np.concatenate([[0], np.cumsum(own["sizes"])])
        self.keys = [_map(path, "keys", m, s) if n else None for s, n in enumerate(own["sizes"])]
        self.hot_ids = np.array(info["hot_ids"], dtype=np.int64)
        if finished:
            self.counts = [(_map(path, "counts", m, s), _map(path, "large", m, s)) if n else None for s, n in enumerate(own["sizes"])]
            self.cold = [(_map(path, "contexts", m, s), _map(path, "stats", m, s)) if n else None for s, n in enumerate(own["sizes"])]
            self.hot = [(_map(path, "hot-contexts", m, s), _map(path, "hot-stats", m, s)) if n else None for s, n in enumerate(own["hot"])]

    def places(self, before: np.ndarray, here: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shard and key of the m-grams that consist of two overlapping, known ones one word shorter."""
        if self.below is None:
            shard = shard_of(before, here, np.isin(before, self.hot_ids), self.shards)
        else:
            shard = np.searchsorted(self.below.first, here, "right") - 1
            here = here - self.below.first[shard]
        return shard, (before.astype(np.uint64) << self.bits) | here.astype(np.uint64)

    def find(self, before: np.ndarray, here: np.ndarray, counted: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Id (-1: not seen) and count of each."""
        ids, counts = np.full(len(here), -1, dtype=np.int64), np.zeros(len(here))
        known = np.flatnonzero((before >= 0) & (here >= 0))
        shard, keys = self.places(before[known], here[known])
        for s, mine in _by_place(shard, keys, self.shards):
            if self.keys[s] is None:
                continue
            at = np.minimum(np.searchsorted(self.keys[s], keys[mine]), len(self.keys[s]) - 1)
            found = self.keys[s][at] == keys[mine]
            at, mine = at[found], known[mine[found]]
            ids[mine] = at + self.first[s]
            if counted:
                counts[mine] = self.count(s, at)
        return ids, counts

    def count(self, s: int, at: np.ndarray) -> np.ndarray:
        small, large = self.counts[s]
        out = small[at].astype(np.int64)
        many = np.flatnonzero(out == 255)
        if len(many):
            out[many] = large[1][np.searchsorted(large[0], at[many])]
        return out

    def stats(self, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Total and types seen once, twice, more often after each context (-1: none); `words` are the contexts' last."""
        out = np.zeros((len(contexts), 4))
        known = np.flatnonzero((contexts >= 0) & (words >= 0))
        asked, hot = contexts[known], np.isin(words[known], self.hot_ids)
        for of, tables, is_hot in ((known[~hot], self.cold, False), (known[hot], self.hot, True)):
            asked = contexts[of]
            shard = asked % self.shards if is_hot else shard_of(words[of], words[of], np.zeros(len(of), bool), self.shards)
            for s, mine in _by_place(shard, asked, self.shards):
                if tables[s] is None:
                    continue
                listed, stats = tables[s]
                left, mine = asked[mine], of[mine]
                if len(listed):
                    at = np.minimum(np.searchsorted(listed, left.astype(listed.dtype)), len(listed) - 1)
                    found = listed[at] == left
                    out[mine[found]] = stats[at[found]]
                    left, mine = left[~found], mine[~found]
                if not is_hot and len(left):
                    keys = self.keys[s]
                    at = np.minimum(np.searchsorted(keys, left.astype(np.uint64) << self.bits), len(keys) - 1)
                    one = (keys[at] >> self.bits).astype(np.int64) == left
                    c, mine = self.count(s, at[one]), mine[one]
                    out[mine] = np.stack([c, c == 1, c == 2, c >= 3], axis=1)
        return out


class Model:
    _open: dict[str, Model] = {}

    def __init__(self, path: str):
        with open(f"{path}/model.json") as f:
            self.info = info = json.load(f)
        self.path, self.words = path, Words(path, info)
        self.levels = _levels(path, info, info["order"])
        self.follows = [np.load(f"{path}/follows-{s}.npy", mmap_mode="r") if n else np.zeros(0, np.uint32) for s, n in enumerate(info["words"])]

    @classmethod
    def opened(cls, path: str) -> Model:
        if path not in cls._open:
            cls._open.clear()
            cls._open[path] = cls(path)
        return cls._open[path]

    def log10_probabilities(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Of each token after those before it in its text; `starts`: whether a text begins there."""
        info, size = self.info, self.words.size
        follows = np.zeros(len(ids), dtype=np.float64)
        for s, part in enumerate(self.follows):
            mine = (ids >= self.words.first[s]) & (ids < self.words.first[s + 1])
            if mine.any():
                follows[mine] = part[ids[mine] - self.words.first[s]]
        d = np.array(info["low_discounts"])
        total = max(1, info["types"])
        spare = float((d * np.array(info["low_types"])).sum()) if info["types"] else 1.0
        p = (np.maximum(follows - d[_level(follows)] * (follows > 0), 0) + spare / (size + 1)) / total
        words, here = _shifted(ids, starts, size), ids
        for level, own in zip(self.levels, info["levels"], strict=True):
            before = _shifted(here, starts, size if level.m == 2 else -1)
            here, seen = level.find(before, here)
            stats, d = level.stats(before, words), np.array(own["discounts"])
            known = stats[:, 0] > 0
            stats, seen = stats[known], seen[known]
            p[known] = (np.maximum(seen - d[_level(seen)], 0) + (stats[:, 1:] * d[1:]).sum(axis=1) * p[known]) / stats[:, 0]
        return np.log10(p)


def _levels(path: str, info: dict, most: int, finished: bool = True) -> list[Level]:
    out: list[Level] = []
    for m in range(2, most + 1):
        out.append(Level(path, info, m, out[-1] if out else None, finished))
    return out


def _level(counts: np.ndarray) -> np.ndarray:
    return np.minimum(counts, 3).astype(np.int64)


def shard_of(before: np.ndarray, here: np.ndarray, hot: np.ndarray, shards: int) -> np.ndarray:
    keys = before.astype(np.uint64)
    return (mixed(np.where(hot, (keys << _U(32)) | here.astype(np.uint64) & _U(0xFFFFFFFF), keys)) % _U(shards)).astype(np.int64)


def discounts(n: list[int]) -> list[float]:
    """D0 .. D3+ of Chen and Goodman from the numbers of types seen once to four times."""
    if not n[0] or not n[1]:
        return [0.0, 0.5, 0.75, 0.75]
    y = n[0] / (n[0] + 2 * n[1])
    out = [0.0, *(k + 1 - (k + 2) * y * n[k + 1] / n[k] if n[k] else 0.5 for k in range(3))]
    return [min(max(d, 0.05), float(k)) if k else 0.0 for k, d in enumerate(out)]


def train(docs: DataFrame, chosen: Column, path: str, text_col: str = "text", word_shards: int = 16, bigrams_per_shard: int = 2_000_000, order: int = 2) -> str:
    """Count the texts of the rows where `chosen` holds (null text: no words) and write the model to `path`."""
    if order < 2:
        raise ValueError("the order has to be 2 at least")
    spark, folder = docs.sparkSession, mounted(path)
    os.makedirs(folder, exist_ok=True)
    texts = docs.filter(chosen).select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, counts in _tally(batches, lambda tokens, before: tokens):
            yield _pairs(keys, counts)

    top = word_shards.bit_length() - 1
    words = texts.mapInArrow(word_counts, "k long, c long").groupBy("k").agg(F.sum("c").alias("c"))

    def write_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, (k, c) in _by_shard(batches).items():
            order = np.argsort(k)
            _save(f"{folder}/words-{s}.npy", k[order])
            _save(f"{folder}/counts-{s}.npy", c[order])
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([len(k)], pa.int64()), pa.array([c.sum()], pa.int64())], names=["shard", "n", "total"])

    sharded = words.select(F.shiftrightunsigned("k", 64 - top).cast("int").alias("shard"), "k", "c").repartition(word_shards, "shard")
    rows = sharded.mapInArrow(write_words, "shard int, n long, total long").collect()  # a row a shard
    info: dict = {"order": order, "words": [0] * word_shards, "hot_ids": [], "levels": []}
    for r in rows:
        info["words"][r.shard] = r.n
    total, size = sum(r.total for r in rows), sum(info["words"])
    if size >= 1 << 32:
        raise ValueError("more than 2**32 distinct words")
    n_shards = max(16, -(-total // bigrams_per_shard))
    frequent = max(1000, total // (8 * n_shards))  # at most 8 * n_shards contexts are


    def frequent_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = np.concatenate([[0], np.cumsum(info["words"])])
        for batch in batches:
            for s in batch.column(0).to_pylist():
                if info["words"][s]:
                    ids = np.flatnonzero(np.load(f"{folder}/counts-{s}.npy", mmap_mode="r") >= frequent) + first[s]
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64())], names=["a"])

    found = spark.range(word_shards).mapInArrow(frequent_words, "a long").collect()  # at most 8 * n_shards
    info["hot_ids"] = sorted({size, *(r.a for r in found)})  # the start of texts is a frequent context
    del words, sharded
    free(spark)
    schema = "kind int, a long, b long, c long, d long, e long"
    every_shard = spark.range(n_shards).select(F.col("id").cast("int").alias("shard"), F.lit(_packed(np.zeros(0, _U), np.zeros(0, _U))).alias("blob"))

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        held: dict[int, list] = {}
        for batch in batches:
            for s, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(s, []).append(blob)
        for s in list(held):
            blobs = held.pop(s)
            keys = np.empty(sum(_length(x) for x in blobs), dtype=np.uint64)
            counts, at = np.empty(len(keys), dtype=np.int64), 0
            while blobs:  # no second copy of the parts
                k, c = _unpacked(blobs.pop())
                keys[at : at + len(k)], counts[at : at + len(k)] = k, c
                at += len(k)
            yield s, *_counted(keys, counts)

    def hot_flags(m: int, s: int, keys: np.ndarray, bits: int) -> np.ndarray:
        """Whether the last word but one is frequent."""
        if m == 2:
            return np.isin((keys >> _U(bits)).astype(np.int64), np.array(info["hot_ids"], dtype=np.int64))
        shorter = _map(folder, "keys", m - 1, s) if info["levels"][m - 3]["sizes"][s] else np.zeros(0, np.uint64)
        flags = hot_flags(m - 1, s, shorter, info["levels"][m - 3]["bits"])
        return flags[(keys & _U((1 << bits) - 1)).astype(np.int64)]

    def finish(m: int, s: int, keys: np.ndarray, c: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
        """Write counts and contexts of a shard's m-grams; rows of kind 10 m + 1 are what contexts that end in a frequent word have here."""
        if not len(keys):
            return
        large = np.flatnonzero(c >= 255)
        _save(f"{folder}/counts-{m}-{s}.npy", np.minimum(c, 255).astype(np.uint8))
        _save(f"{folder}/large-{m}-{s}.npy", np.stack([large, c[large]]))
        context = (keys >> _U(bits)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
        hot = hot_flags(m, s, keys, bits)[first]
        many = np.diff(first, append=len(keys)) > 1
        stats = np.stack([np.add.reduceat(x.astype(np.int64), first) for x in (c, c == 1, c == 2, c >= 3)], axis=1)
        context, kept = context[first], many & ~hot
        _save(f"{folder}/contexts-{m}-{s}.npy", _narrow(context[kept]))
        _save(f"{folder}/stats-{m}-{s}.npy", _narrow(stats[kept]))
        yield _row(10 * m + 1, context[hot], *stats[hot].T)
        yield _row(10 * m, *[np.array([x]) for x in (s, *((c == i).sum() for i in (1, 2, 3, 4)))])

    def settle(m: int, made: DataFrame) -> None:
        """Discounts of the m-grams, and their contexts that end in a frequent word, summed over the shards."""
        own = info["levels"][m - 2]
        counts = made.filter(F.col("kind") == 10 * m).collect()  # a row a shard
        own["discounts"] = discounts([sum(r[x] for r in counts) for x in "bcde"])

        def write_hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(batches, schema=pa.schema([("shard", pa.int32()), *[(x, pa.int64()) for x in "abcde"]]))
            columns = [c.to_numpy() for c in rows.columns]
            for s in np.unique(columns[0]).tolist():
                mine = np.flatnonzero(columns[0] == s)
                mine = mine[np.argsort(columns[1][mine])]
                _save(f"{folder}/hot-contexts-{m}-{s}.npy", _narrow(columns[1][mine]))
                _save(f"{folder}/hot-stats-{m}-{s}.npy", _narrow(np.stack([c[mine] for c in columns[2:]], axis=1)))
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32())], names=["shard"])

        summed = made.filter(F.col("kind") == 10 * m + 1).groupBy("a").agg(*[F.sum(x).alias(x) for x in "bcde"])
        written = summed.select((F.col("a") % n_shards).cast("int").alias("shard"), *"abcde").repartition(n_shards, "shard").mapInArrow(write_hot, "shard int").collect()  # a row a shard
        own["hot"] = [0] * n_shards
        for r in written:
            own["hot"][r.shard] = 1

    def count_level(m: int) -> DataFrame:
        """Count m-grams; the counts of those one word shorter are then those of distinct words before."""
        below = info["levels"][-1]["sizes"] if m > 2 else [size]
        bits = max(below).bit_length()
        if (sum(below) + 1).bit_length() + bits > 64:
            raise ValueError(f"too many {m - 1}-grams for 64-bit keys; use more shards")
        own = {"bits": bits, "sizes": [0] * n_shards}

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = Words(folder, info)
            levels = _levels(folder, dict(info, levels=[*info["levels"], own]), m, finished=False)

            def places(tokens: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                starts = before == START
                here, _ = known.find(tokens)
                for level in levels[:-1]:
                    here, _ = level.find(_shifted(here, starts, size if level.m == 2 else -1), here, False)
                before = _shifted(here, starts, size if m == 2 else -1)
                whole = (before >= 0) & (here >= 0)
                return levels[-1].places(before[whole], here[whole])

            yield from _dealt(batches, places)

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for s, k, c in gathered(batches):
                low = (k & _U((1 << bits) - 1)).astype(np.int64)
                if m == 2:
                    word, n = np.unique(low, return_counts=True)
                    none = np.zeros(len(word), np.int64)
                    yield _row(1, word, n, none, none, none)
                elif below[s]:
                    raw = _map(folder, "raw", m - 1, s)
                    n = np.bincount(low, minlength=len(raw))
                    yield from finish(m - 1, s, _map(folder, "keys", m - 1, s), np.where(n > 0, n, raw), info["levels"][m - 3]["bits"])
                if len(k):
                    _save(f"{folder}/keys-{m}-{s}.npy", k)
                    if m < order:
                        _save(f"{folder}/raw-{m}-{s}.npy", _narrow(c))
                    else:
                        yield from finish(m, s, k, c, bits)
                yield _row(0, *[np.array([x]) for x in (s, len(k), 0, 0, 0)])

        dealt = texts.mapInArrow(deal, "shard int, blob binary").unionByName(every_shard).repartition(n_shards, "shard")
        made = materialize(dealt.mapInArrow(write, schema), "lz4")
        del dealt
        for r in made.filter("kind = 0").collect():  # a row a shard
            own["sizes"][r.a] = r.b
        info["levels"].append(own)
        if m > 2:
            settle(m - 1, made)
            for s in np.flatnonzero(below):
                os.remove(f"{folder}/raw-{m - 1}-{s}.npy")
        if m == order:
            settle(m, made)
        free(spark)
        return made

    made = count_level(2)
    follows = made.filter("kind = 1").groupBy("a").agg(F.sum("b").alias("n"))
    edges = np.concatenate([[0], np.cumsum(info["words"])]).tolist()
    part = F.lit(0)
    for edge in edges[1:-1]:
        part = part + (F.col("a") >= edge).cast("int")

    def write_follows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, (a, n) in _by_shard(batches).items():
            dense = np.zeros(info["words"][s], dtype=np.uint32 if size < 1 << 32 else np.uint64)
            dense[a.astype(np.int64) - edges[s]] = n
            _save(f"{folder}/follows-{s}.npy", dense)
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (n.sum(), *((n == i).sum() for i in (1, 2, 3, 4)), (n >= 3).sum())], names=list("abcdef"))

    low = follows.select(part.alias("shard"), "a", "n").repartition(word_shards, "shard").mapInArrow(write_follows, "a long, b long, c long, d long, e long, f long").collect()  # a row a shard
    sums = [sum(r[i] for r in low) for i in range(6)]
    info |= {"types": sums[0], "low_discounts": discounts(sums[1:5]), "low_types": [0, sums[1], sums[2], sums[5]], "total": total}
    drop_table(made)
    del follows, made
    for m in range(3, order + 1):
        free(spark)
        drop_table(count_level(m))
    with open(f"{folder}/model.json.part", "w") as f:
        json.dump(info, f)
    os.replace(f"{folder}/model.json.part", f"{folder}/model.json")
    return folder


def _narrow(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint32) if not values.size or values.max() < 1 << 32 else values


def _row(kind: int, *columns: np.ndarray) -> pa.RecordBatch:
    arrays = [pa.array(np.full(len(columns[0]), kind), pa.int32()), *[pa.array(np.ascontiguousarray(c), pa.int64()) for c in columns]]
    return pa.RecordBatch.from_arrays(arrays, names=["kind", *"abcde"])


def _by_shard(batches: Iterator[pa.RecordBatch]) -> dict[int, tuple[np.ndarray, ...]]:
    """The arrays of each shard in this task."""
    held: dict[int, list] = {}
    for batch in batches:
        shard = batch.column(0).to_numpy()
        k, c = batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy()
        for s in np.unique(shard):
            mine = shard == s
            held.setdefault(int(s), []).append([x[mine] for x in (k, c)])
    return {s: tuple(np.concatenate(x) for x in zip(*parts, strict=True)) for s, parts in held.items()}


def score(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score (log10), perplexity: a row a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.opened(folder)
        total, size = model.info["total"], model.words.size
        for batch in batches:
            for first, texts in some_texts(texts_of(batch.column(1)), 1 << 22):
                tokens, before, begins = sequences(texts)
                ids, counts = model.words.find(tokens)
                at, n = begins[:-1], np.diff(begins)
                base = np.add.reduceat(np.log10((counts + 1) / (total + size + 1)), at)
                logs = np.add.reduceat(model.log10_probabilities(ids, before == START), at)
                known = np.add.reduceat((counts > 0).astype(np.int64), at)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(n), total, np.int64)), pa.array(base), pa.array(logs), pa.array(10.0 ** np.minimum(300, -logs / n))], names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def held_out(id_col: str = "doc_id", folds: int = 7, fold: int = 2) -> Column:
    """Whether crc32 of the id as text falls in the fold; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == fold


def train_and_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 2) -> DataFrame:
    """Scores of all documents by a model of that order of those not held out, with `held_out`.

    Null or empty text is the end token alone; repeated rows count each; without training rows
    every token has probability 1 / (0 + 1).
    """
    folder = train(docs, ~held_out(id_col), scratch_dir(docs.sparkSession), text_col, order=order)
    return score(docs, folder, id_col, text_col).withColumn("held_out", held_out("doc_id"))
