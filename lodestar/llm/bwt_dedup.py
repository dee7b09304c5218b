"""Removal of byte strings that repeat anywhere, by merging Burrows-Wheeler transforms.

A window is a string of `length` bytes. Each has an anchor: the gram of `gram` bytes in it with the
least hash (the last of equals). Equal windows have equal anchors at equal places, so only
windows in one class (the anchor's gram) can be equal. Windows next to each other mostly share their
anchor; such a run is a piece, the bytes that its windows cover.

1. Pieces are counted. A piece that occurs twice is repeated in all its windows; a class that holds
   one piece only is settled by that.
2. A window holds half of its other bytes on the left of its anchor, or else on the right. Of the
   distinct pieces in all other classes only the windows are kept whose half occurs in another piece.
   These are dealt to tasks by class. A task builds the
   Burrows-Wheeler transform of shards of them, and merges these by iterative interleave refinement:
   the merged order is a vector of shard numbers, refined from the transforms alone until it is
   stable, without sorting suffixes again. The refinement takes `STEP` bytes at a time: the
   transform's symbols are the grams of so many bytes before a suffix. The blocks that are left when `length`
   bytes have been compared are the repeated intervals: suffixes with a common prefix that long.
3. Classes of more than `MOST` distinct pieces (a passage with as many surroundings) are not given to
   one task: their windows are counted one by one, by two hashes of their bytes.

Bytes covered by repeated windows are removed, all occurrences alike, judged on the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialize, with_rows
from .hashing import _BYTE, _tables, mixed, some_texts, texts_of

LENGTH, GRAM, STEP = 200, 32, 40
#: Distinct pieces of a class that one task takes, and bytes that it works on at a time (so few that symbols fit in 16 bits and sort by radix).
MOST, AT_ONCE = 4096, 30 << 10
#: Longer texts are cut with an overlap of a window less a byte, so that a place fits in 20 bits.
CUT = 1 << 19
_U = np.uint64


def _window_minima(values: np.ndarray, w: int) -> np.ndarray:
    """Least of each run of `w` values, by minima of blocks from both sides."""
    n = len(values)
    full = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    full[:n] = values
    blocks = full.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def _prefix_sums(data: np.ndarray, salt: int = 0) -> np.ndarray:
    up, _ = _tables(len(data) + 1)
    table = _BYTE if not salt else mixed(_BYTE + _U(salt))
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(table[data] * up[: len(data)], out=out[1:])
    return out


def _hash_of(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = _tables(len(sums))
    return mixed((sums[ends] - sums[starts]) * down[starts])


def cut_long(texts: list[bytes], length: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Texts in parts of at most CUT bytes that share length - 1 bytes; the text and the place of each."""
    parts, of, at = [], [], []
    for i, t in enumerate(texts):
        for a in range(0, max(1, len(t) - length + 1), CUT - length + 1):
            parts.append(t[a : a + CUT])
            of.append(i)
            at.append(a)
    return parts, np.array(of, dtype=np.int64), np.array(at, dtype=np.int64)


def pieces_of(texts: list[bytes], length: int, gram: int) -> dict[str, np.ndarray]:
    """Of each run of windows with one anchor: text, place, windows, place of the anchor in it, its gram's hash, the piece's hash.

    Also the hashes of the half a window on either side of the anchor, and whether the piece holds so many bytes there.
    """
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    w = length - gram + 1
    none = {k: np.zeros(0, np.int64) for k in ("text", "at", "n", "rel", "gram", "piece", "left", "right", "has_left", "has_right")}
    if len(data) < length:
        return none
    sums = _prefix_sums(data)
    places = np.arange(len(data) - gram + 1)
    hashes = _hash_of(sums, places, places + gram)
    low = _U((1 << 20) - 1)
    anchor = (low - (_window_minima((hashes & ~low) | (low - places.astype(np.uint64)), w) & low)).astype(np.int64)
    # Windows inside one text.
    windows = np.maximum(0, sizes - length + 1)
    text = np.repeat(np.arange(len(texts)), windows)
    if not len(text):
        return none
    starts = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows) + begins[text]
    a = anchor[starts]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (text[1:] != text[:-1])]))
    n = np.diff(np.concatenate([first, [len(text)]]))
    p = starts[first]
    half, middle, end = (length - gram) // 2, a[first], p + n + length - 1
    has_left, has_right = middle - p >= half, middle + gram + half <= end
    left = _hash_of(sums, np.maximum(middle - half, 0), middle)
    right = _hash_of(sums, middle + gram, np.minimum(middle + gram + half, len(data)))
    sides = {"left": (left >> _U(32)).astype(np.uint32).view(np.int32), "right": (right >> _U(32)).astype(np.uint32).view(np.int32), "has_left": has_left, "has_right": has_right}
    return sides | {"text": text[first], "at": p - begins[text[first]], "n": n, "rel": a[first] - p, "gram": hashes[a[first]].view(np.int64), "piece": _hash_of(sums, p, p + n + length - 1).view(np.int64)}


OCCURRENCE = "gram long, piece long, shape long, row long, at long, left int, right int"


def occurrences(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """gram, piece, shape (windows and anchor's place), row, at, left, right: a row a piece of a text."""
    if length >= 1024:
        raise ValueError("windows of 1024 bytes or more are not supported: a piece's shape holds its anchor's place in 10 bits")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            parts, of, at = cut_long(texts_of(batch.column(1)), length)
            for first, texts in some_texts(parts, CUT):
                got = pieces_of(texts, length, gram)
                text = got["text"] + first
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (got["gram"], got["piece"], got["n"] * 1024 + got["rel"], ids[of[text]], got["at"] + at[text])] + [pa.array(got[k].astype(np.int32), mask=~got[f"has_{k}"].astype(bool)) for k in ("left", "right")], names=["gram", "piece", "shape", "row", "at", "left", "right"])

    return rows.select("row", "text").mapInArrow(find, OCCURRENCE)


class Collection:
    """Strings one after the other, each with an end that is less than all bytes, ends in their order.

    `symbol`: the rank of the `step` bytes from a place on; `next`: the place after them, at most the end.
    """

    def __init__(self, strings: list[bytes], step: int):
        self.step = step
        sizes = np.array([len(s) + 1 for s in strings], dtype=np.int64)
        self.ends = np.cumsum(sizes) - 1
        padded = np.frombuffer(b"\0".join([*strings, b"\0" * 8]), dtype=np.uint8).astype(np.uint64)
        n, width = int(sizes.sum()), min(8, step)
        end_of, places = np.repeat(self.ends, sizes), np.arange(n)
        left = end_of - places
        symbol = np.zeros(n, dtype=np.uint64)
        for k in range(width):
            symbol |= np.where(left > k, padded[k : n + k], 0) << _U(56 - 8 * k)
        # What an end cuts short is less than the same bytes and zeros; ends alone have symbol 0.
        rank = _rank(_rank(symbol) * 16 + np.minimum(left, width))
        while width < step:
            more = min(width, step - width)
            rank = _rank(rank * (n + 1) + rank[np.minimum(places + more, end_of)])
            width += more
        self.next = np.minimum(places + step, end_of)
        self.text = np.repeat(np.arange(len(strings)), sizes)
        self.symbol = rank.astype(np.uint16) if rank.max(initial=0) < 1 << 16 else rank


def _rank(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


def shard_order(c: Collection, places: np.ndarray) -> np.ndarray:
    """The suffixes at `places` (all of some strings) in order, by doubling the compared length."""
    rank_of = np.zeros(len(c.symbol), dtype=np.int64)
    is_end = c.next[places] == places
    # The ends are all different, in the order of the strings, and before all else.
    rank = c.symbol[places].astype(np.int64) + len(places)
    rank[is_end] = np.arange(int(is_end.sum()))
    rank_of[places] = rank
    jump = c.next.copy()
    while True:
        key = rank_of[places] * (2 * len(c.symbol) + len(places) + 2) + np.where(is_end, 0, rank_of[jump[places]])
        order = np.argsort(key, kind="stable")
        fresh = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank_of[places[order]] = fresh
        if fresh[-1] == len(places) - 1:
            return places[order]
        jump[places] = jump[jump[places]]


class Transform:
    """A sorted shard: suffixes in order and, for each in turn, the symbols before it (its transform over grams)."""

    def __init__(self, c: Collection, order: np.ndarray):
        self.order = order
        rank = np.empty(len(c.symbol), dtype=np.int64)
        rank[order] = np.arange(len(order))
        places = np.sort(order)
        nxt = rank[c.next[places]]
        by_next = np.lexsort((c.symbol[places], nxt))
        self.before = c.symbol[places[by_next]]
        self.many = np.bincount(nxt, minlength=len(order))


def merge(c: Collection, a: Transform, b: Transform, depth: int, last: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The merged order of two transforms, and for each place in it the block of suffixes that share `depth` bytes.

    The last merge ends at `depth`: its blocks are known by then, and no merge needs the order below it.
    """
    z = np.zeros(len(a.order) + len(b.order), dtype=bool)
    ends_a, ends_b = (int((c.next[t.order] == t.order).sum()) for t in (a, b))
    # At first nothing is compared and all is one block; only the ends are in place, in the order of their strings.
    ends = np.concatenate([a.order[:ends_a], b.order[:ends_b]])
    z[: len(ends)] = np.concatenate([np.zeros(ends_a, bool), np.ones(ends_b, bool)])[np.argsort(ends)]
    z[len(ends) + len(a.order) - ends_a :] = True
    block = np.zeros(len(z), dtype=np.int64)
    many, symbols, deep = np.empty(len(z), np.int64), np.empty(len(z), a.before.dtype), None
    step = 0
    while True:
        step += 1
        many[~z], many[z] = a.many, b.many
        z_of, block_of = np.repeat(z, many), np.repeat(block, many)
        symbols[~z_of], symbols[z_of] = a.before, b.before
        order = np.argsort(symbols, kind="stable")
        new_z, sorted_symbols, sorted_block = z_of[order], symbols[order], block_of[order]
        new_block = np.zeros(len(z), dtype=np.int64)
        np.cumsum((sorted_symbols[1:] != sorted_symbols[:-1]) | (sorted_block[1:] != sorted_block[:-1]), out=new_block[1:])
        if step * c.step >= depth and deep is None:
            deep_z, deep = new_z, new_block
            if last:
                break
        # The blocks only ever split, so this ends: at the latest when every suffix is a block of its own.
        if new_block[-1] == block[-1] and (new_z == z).all():
            deep_z, deep = (new_z, new_block) if deep is None else (deep_z, deep)
            z = new_z
            break
        z, block = new_z, new_block
    at = np.empty(len(z), dtype=np.int64)
    at[~deep_z], at[deep_z] = a.order, b.order
    if last:
        return at, deep
    merged, of = np.empty(len(z), dtype=np.int64), np.empty(len(c.symbol), dtype=np.int64)
    merged[~z], merged[z] = a.order, b.order
    of[at] = deep
    return merged, of[merged]


def repeated_windows(strings: list[bytes], length: int = LENGTH, shards: int = 2) -> list[np.ndarray]:
    """For each string, whether each of its windows is another window too, in it or elsewhere."""
    c = Collection(strings, max(d for d in range(1, STEP + 1) if length % d == 0))
    every = np.arange(len(c.symbol))
    parts = [every[(c.text >= lo) & (c.text < hi)] for lo, hi in ((len(strings) * s // shards, len(strings) * (s + 1) // shards) for s in range(shards))]
    level = [Transform(c, shard_order(c, p)) for p in parts if len(p)]
    if len(level) == 1:
        level.append(Transform(c, np.zeros(0, np.int64)))
    while True:
        merged = [merge(c, *level[i : i + 2], length, len(level) == 2) for i in range(0, len(level) - 1, 2)]
        if len(level) == 2:
            break
        level = [Transform(c, m[0]) for m in merged] + level[len(level) & ~1 :]
    order, block = merged[0]
    often = np.bincount(block)[block] > 1
    flag = np.zeros(len(c.symbol), dtype=bool)
    flag[order] = often
    flag &= c.ends[c.text] - np.arange(len(flag)) >= length
    return [flag[e - len(s) : e - length + 1] if len(s) >= length else np.zeros(0, bool) for s, e in zip(strings, c.ends, strict=True)]


SPAN = "row long, lo long, hi long"


def _spans(rows: np.ndarray, ats: np.ndarray, flags: list[np.ndarray], length: int) -> pa.RecordBatch:
    """(row, lo, hi) of the bytes under runs of repeated windows."""
    out: list[tuple] = []
    for row, at, f in zip(rows, ats, flags, strict=True):
        if f.all():
            out.append((row, at, at + len(f) - 1 + length))
        elif f.any():
            edge = np.flatnonzero(np.diff(np.concatenate([[0], f.astype(np.int8), [0]])))
            out += [(row, at + a, at + b - 1 + length) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else [[]] * 3)], names=["row", "lo", "hi"])


def merged_spans(pieces: DataFrame, length: int) -> DataFrame:
    """Spans of the pieces (gram, mult, row, at, bytes) that lie in repeated windows; classes are whole in a partition, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None

        def settle() -> pa.RecordBatch:
            flags = repeated_windows([h[3] for h in held], length)
            once = [i for i, h in enumerate(held) if h[0] == 1]
            return _spans(np.array([held[i][1] for i in once]), np.array([held[i][2] for i in once]), [flags[i] for i in once], length)

        for batch in batches:
            for gram, *rest in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if gram != last and size >= AT_ONCE:
                    yield settle()
                    held, size = [], 0
                last = gram
                held.append(rest)
                size += len(rest[3])
        if held:
            yield settle()

    return pieces.select("gram", "mult", "row", "at", "bytes").mapInArrow(run, SPAN)


def counted_spans(pieces: DataFrame, length: int) -> DataFrame:
    """The same for pieces of any class, by counting the hashes of their windows."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gram, mult, row, at, texts = (batch.column(i).to_pylist() for i in range(5))
            for i, t in enumerate(texts):
                data = np.frombuffer(t, dtype=np.uint8)
                starts = np.arange(len(data) - length + 1)
                two = [_hash_of(_prefix_sums(data, salt), starts, starts + length).view(np.int64) for salt in (0, 77)]
                n = len(starts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, gram[i])), pa.array(two[0]), pa.array(two[1]), pa.array(np.full(n, mult[i])), pa.array(np.full(n, row[i])), pa.array(at[i] + starts)], names=["gram", "h1", "h2", "mult", "row", "at"])

    windows = pieces.select("gram", "mult", "row", "at", "bytes").mapInArrow(hashes, "gram long, h1 long, h2 long, mult long, row long, at long")
    key = ["gram", "h1", "h2"]
    often = windows.groupBy(*key).agg(F.sum("mult").alias("n")).filter("n > 1")
    return windows.join(often, key).select("row", F.col("at").alias("lo"), (F.col("at") + length).alias("hi"))


def repeated_spans(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """(row, lo, hi): bytes of the texts (row, text) under repeated windows; spans may overlap."""
    found = materialize(occurrences(rows, length, gram), "lz4")
    key = ["gram", "piece", "shape"]
    pieces = materialize(found.groupBy(*key).agg(F.count(F.lit(1)).alias("mult"), F.min(F.struct("row", "at")).alias("first"), F.first("left").alias("left"), F.first("right").alias("right")), "lz4")
    multiple = pieces.filter("mult > 1").select(*key)
    n, rel = F.floor(F.col("shape") / 1024), F.col("shape") % 1024
    whole = found.join(multiple, key).select("row", F.col("at").alias("lo"), (F.col("at") + n - 1 + length).alias("hi"))
    open_ = lambda rows: rows.groupBy("gram").agg(F.count(F.lit(1)).alias("distinct"), F.min("mult").alias("least")).filter("distinct > 1 AND least = 1").select("gram", "distinct")
    classed = pieces.join(open_(pieces).select("gram"), "gram").select("gram", "mult", F.col("first.row").alias("row"), F.col("first.at").alias("at"), n.alias("n"), rel.alias("rel"), "left", "right")
    classed = materialize(classed, "lz4")
    often = lambda side: classed.groupBy("gram", side).agg(F.count(F.lit(1)).alias("c")).filter(f"c > 1 AND {side} IS NOT NULL").select("gram", side, F.lit(True).alias(f"by_{side}"))
    # Of a window that begins at w, the half on the left of the anchor is in it if w <= rel - half; else the half on the right is.
    edge = F.col("rel") - (length - gram) // 2 + 1
    lo = F.when(F.col("by_left").isNull(), F.greatest(F.lit(0), edge)).otherwise(F.lit(0))
    hi = F.when(F.col("by_right").isNull(), F.least("n", edge)).otherwise(F.col("n"))
    sided = classed.join(often("left"), ["gram", "left"], "left").join(often("right"), ["gram", "right"], "left").filter("by_left OR by_right")
    trimmed = sided.select("gram", "mult", "row", (F.col("at") + lo).alias("at"), (hi - lo).alias("n")).filter("n > 0")
    trimmed = materialize(trimmed, "lz4")
    asked = materialize(trimmed.join(open_(trimmed), "gram").select("gram", "distinct", "mult", "row", "at", "n"), "lz4")
    drop_table(trimmed)
    drop_table(classed)
    by_row = asked.groupBy("row").agg(F.collect_list(F.struct("gram", "distinct", "mult", "at", "n")).alias("asked"))
    cut = rows.join(by_row, "row").select("row", F.col("text").cast("binary").alias("bytes"), F.explode("asked").alias("a"))
    bytes_ = F.substring("bytes", (F.col("a.at") + 1).cast("int"), (F.col("a.n") + length - 1).cast("int"))
    texts = materialize(cut.select("a.gram", "a.distinct", "a.mult", "row", "a.at", bytes_.alias("bytes")), "zstd")
    settled = merged_spans(texts.filter(F.col("distinct") <= most).repartition("gram").sortWithinPartitions("gram"), length)
    rest = counted_spans(texts.filter((F.col("distinct") > most)), length).join(asked.filter("mult = 1").select("row").distinct(), "row", "left_semi")
    out = materialize(whole.unionByName(settled).unionByName(rest), "lz4")
    for t in (found, pieces, asked, texts):
        drop_table(t)
    return out


REMOVED = "row long, doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<long>"


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """One row a document: row, doc_id, n_bytes, n_removed, n_spans, kept (the bytes left), spans (lo, hi, lo, hi ... removed).

    Null counts as empty; texts shorter than `length` lose nothing; copies lose all that is covered,
    each of them; repeated rows are copies of each other.
    """
    rows = with_rows(docs, doc_id=F.col(id_col).cast("long"), text=F.coalesce(F.col(text_col), F.lit("")))
    spans = repeated_spans(rows, length, gram, most).groupBy("row").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, doc, text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch.column(2)), batch.column(3), strict=True):
                kept, edges = text, np.zeros(0, np.int64)
                if spans.is_valid:
                    pairs = np.array([(s["lo"], s["hi"]) for s in spans.as_py()], dtype=np.int64)
                    delta = np.zeros(len(text) + 1, dtype=np.int64)
                    np.add.at(delta, pairs[:, 0], 1)
                    np.add.at(delta, pairs[:, 1], -1)
                    covered = np.cumsum(delta[:-1]) > 0
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
                    kept = np.frombuffer(text, dtype=np.uint8)[~covered].tobytes()
                out.append((row, doc, len(text), len(text) - len(kept), len(edges) // 2, kept, edges))
            kinds = [pa.int64()] * 5 + [pa.binary(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds], names=[x.split(" ")[0] for x in REMOVED.split(", ")])

    return rows.join(spans, "row", "left").select("row", "doc_id", "text", "spans").mapInArrow(apply, REMOVED)


def repeats_digest(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of `remove_repeats`."""
    return remove_repeats(docs, **options).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

