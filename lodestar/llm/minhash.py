"""Near-duplicate documents by MinHash with tensored banding, confirmed on full shingle sets.

Two collections of `members` keys are made, each key of `depth` minhashes. A table key joins one
key of either collection, so members**2 tables of 2 * depth rows cost 2 * members * depth minhashes
instead of members**2 * 2 * depth. With 8 members of depth 2, 32 minhashes make 64 tables, and a
pair at similarity 0.85 meets in one of them with probability 1 - 7e-5.

Documents with the same shingle set are one node. In each bucket the members are compared with a
pivot, the one with the most company; the links join into components. Members of a bucket in different
components are compared with each other where their differences from the pivot leave it open (see
`linked_components`), so no candidate of the banding is left out and no bucket is expanded into all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, drop_table, free, keep_rows, materialize, only_rows, with_rows
from .components import components
from .hashing import mixed, shingle_sets, some_texts, texts_of

MEMBERS, DEPTH = 8, 2
#: Rows with a text or two whole shingle sets that a Python worker holds at a time.
BATCH = 500
SIGNED = "row long, doc_id long, n long, h1 long, h2 long, sig binary"


def signatures(rows: DataFrame, words: int, members: int, depth: int) -> DataFrame:
    n = 2 * members * depth
    salts = mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in some_texts(texts_of(batch.column(2))):
                sets = shingle_sets(texts, words)
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                full = np.flatnonzero(sizes)
                sig = np.zeros((len(sets), n), dtype=np.uint32)
                h1, h2 = np.zeros(len(sets), dtype=np.uint64), np.zeros(len(sets), dtype=np.uint64)
                if len(full):
                    flat = np.concatenate([sets[i] for i in full])
                    at = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                    h1[full] = np.add.reduceat(flat, at)
                    h2[full] = np.add.reduceat(mixed(flat), at)
                    for k in range(n):
                        x = flat * salts[k]
                        x ^= x >> np.uint64(29)
                        sig[full, k] = np.minimum.reduceat(x * salts[k - 1], at) >> np.uint64(32)
                part = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sizes), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array([s.tobytes() for s in sig], pa.binary())], names=["row", "doc_id", "n", "h1", "h2", "sig"])

    return rows.select("row", "doc_id", "text").mapInArrow(sign, SIGNED)


def table_keys(nodes: DataFrame, members: int, depth: int) -> DataFrame:
    """(key, row, n): members**2 rows a node."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.uint32).reshape(batch.num_rows, 2, members, depth).astype(np.uint64)
            part = np.zeros(sig.shape[:3], dtype=np.uint64)
            for d in range(depth):
                part = mixed(part * np.uint64(0x9E3779B97F4A7C15) + sig[..., d] + np.uint64(1))
            part += (np.arange(2 * members, dtype=np.uint64) + np.uint64(1)).reshape(2, members)
            key = mixed(mixed(part[:, 0])[:, :, None] * np.uint64(3) + mixed(part[:, 1])[:, None, :]).reshape(batch.num_rows, -1)
            each = members * members
            yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), each)), pa.array(np.repeat(batch.column(1).to_numpy(), each))], names=["key", "row", "n"])

    return nodes.select("row", "n", "sig").mapInArrow(keys, "key long, row long, n long")


def full_sets(pairs: DataFrame, rows: DataFrame, words: int) -> DataFrame:
    """(row, set) of the rows that `pairs` (u, v) name, computed from the whole texts."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in some_texts(texts_of(batch.column(1))):
                out = [s.tobytes() for s in shingle_sets(texts, words)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(out, pa.binary())], names=["row", "set"])

    named = pairs.select(F.explode(F.array("u", "v")).alias("row")).distinct()
    return only_rows(rows.select("row", "text"), named).mapInArrow(sets, "row long, set binary")


def compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """u, v, linked (100 * intersection >= percent * union of the full sets), d (the size of their symmetric difference)."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked, far = [], []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(a.as_buffer(), dtype=np.uint64), np.frombuffer(b.as_buffer(), dtype=np.uint64)
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
                far.append(len(x) + len(y) - 2 * both)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_()), pa.array(far, pa.int64())], names=["u", "v", "linked", "d"])

    return _both_sets(pairs, sets).select("u", "v", "us", "vs").mapInArrow(meet, "u long, v long, linked boolean, d long")


def _both_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    one = pairs.join(sets.withColumnsRenamed({"row": "u", "set": "us"}), "u")
    return one.join(sets.withColumnsRenamed({"row": "v", "set": "vs"}), "v")


def climbed(members: DataFrame, sets: DataFrame, percent: int, rounds: int) -> tuple[DataFrame, DataFrame]:
    """Compare the members of each group g with a pivot, in turn with g, the member nearest to it, and so on.

    A copy with a change of its own is nearest to the text it was made of, so the pivots climb to
    the middle of a family. Returns the links (u, v) and, of groups in which no pivot is linked with
    every member, (g, v): the pivot with the most links.
    """
    now = members.select("g", F.col("g").alias("v")).distinct().withColumn("used", F.array("v"))
    all_seen, tries, spent = [], [], []
    for _ in range(rounds):
        asked = materialize(members.join(now, "g").filter("row != v").select("g", F.col("row").alias("u"), "v", "used"), "lz4")
        pairs = asked.select("u", "v").distinct()
        for earlier in all_seen:
            pairs = pairs.join(earlier, ["u", "v"], "left_anti")
        all_seen.append(materialize(compared(pairs, sets, percent), "lz4"))
        seen = all_seen[0]
        for more in all_seen[1:]:
            seen = seen.union(more)
        met = asked.join(seen, ["u", "v"])
        nearest = F.min(F.when(~F.array_contains("used", F.col("u")), F.struct("d", "u")))["u"]
        by_group = met.groupBy("g", "v").agg(F.count_if("linked").alias("links"), F.count(F.lit(1)).alias("size"), F.first("used").alias("used"), nearest.alias("next"))
        tried = materialize(by_group, "lz4")
        drop_table(asked)
        tries.append(tried.select("g", "v", "links", "size"))
        spent.append(tried)
        now = tried.filter("links < size AND next IS NOT NULL").select("g", F.col("next").alias("v"), F.array_append("used", F.col("next")).alias("used"))
    every = tries[0]
    for t in tries[1:]:
        every = every.union(t)
    best = every.groupBy("g").agg(F.max(F.struct("links", "v")).alias("best"), F.bool_or(F.col("links") == F.col("size")).alias("done"))
    links = materialize(seen.filter("linked").select("u", "v"), "lz4")
    open_ = materialize(best.filter("NOT done").select("g", F.col("best.v").alias("v")), "lz4")
    for t in [*all_seen, *spent]:
        drop_table(t)
    free(members.sparkSession)
    return links, open_


def _reach(n: Column, percent: int) -> Column:
    """The most that a set of n can differ from one it is linked with."""
    return F.floor(F.lit(100 - percent) * n / percent)


def _with_roots(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of the keys whose rows have two roots or more: the rows' other columns without `root`, and `company`, the key's rows.

    Counts are made where the rows are before they meet, so a key that most rows hold is a row a
    task; the join back splits it where it is too large (AQE).
    """
    overall = rows.groupBy(*keys).agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("company")).filter("lo != hi")
    return rows.drop("root").join(overall.select(*keys, "company"), keys)


def contested(groups: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The rows (g, v, row, root, n) of groups that may still be linked with a row of another root.

    A row linked with one of another root has at least `percent` of its shingles in common with it,
    so as many of its shingles have to occur under other roots at all. What shares only a common
    line or passage falls out here.
    """

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                found = [np.frombuffer(x.as_buffer(), dtype=np.int64) for x in part.column(2)]
                sizes = [len(f) for f in found]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(), sizes)), pa.array(np.repeat(part.column(1).to_numpy(), sizes)), pa.array(np.concatenate([*found, np.zeros(0, np.int64)]))], names=["row", "root", "e"])

    placed = groups.join(roots.withColumnRenamed("u", "row"), "row", "left").withColumn("root", F.coalesce("root", "row"))
    open_ = placed.groupBy("g").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a != b").select("g")
    asked = materialize(placed.join(open_, "g", "left_semi"), "lz4")
    each = asked.select("row", "root").distinct().join(sets, "row").select("row", "root", "set").mapInArrow(elements, "row long, root long, e long")
    common = _with_roots(each, ["e"]).groupBy("row").agg(F.count(F.lit(1)).alias("m"))
    size = sets.select("row", (F.octet_length("set") / 8).cast("long").alias("n"))
    near = common.join(size, "row").filter(F.col("m") * 100 >= F.col("n") * percent).select("row", "n")
    left = asked.join(near, "row")
    open_ = left.groupBy("g").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a != b").select("g")
    out = materialize(left.join(open_, "g", "left_semi").select("g", "v", "row", "root", "n"), "lz4")
    drop_table(asked)
    free(groups.sparkSession)
    return out


def close_lists(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Lists (g, e) of rows of a group, one of which every two linked rows of different roots share.

    Let x and y differ from their group's pivot v by the sets Dx and Dy. They differ from each other
    by |Dx| + |Dy| - 2 |Dx & Dy|, which has to be at most t, a bound that follows from their sizes.
    With |Dx| >= |Dy|, and any fixed order of elements, that takes a common element among the first
    t + 1 of Dx and the first t / 2 + 1 of Dy (prefix filter; rows linked with the pivot have its
    root). The order: elements that occur under one root only, which nothing that is looked for has
    in common, then the rarest of the group first. Columns: g, e, u, root, n, d, m (elements of the
    second kind), at (the place of e among them), front (among the first t / 2 + 1), size (the list's rows).
    """

    def differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                found = []
                for a, b in zip(part.column(3), part.column(4), strict=True):
                    found.append(np.setxor1d(np.frombuffer(a.as_buffer(), dtype=np.int64), np.frombuffer(b.as_buffer(), dtype=np.int64), assume_unique=True))
                sizes = np.array([len(f) for f in found], dtype=np.int64)
                columns = [pa.array(np.repeat(part.column(i).to_numpy(), sizes)) for i in range(3)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate([*found, np.zeros(0, np.int64)]))], names=["g", "u", "root", "e"])

    pairs = rows.withColumnRenamed("row", "u").filter("u != v")
    each = _both_sets(pairs, sets).select("g", "u", "root", "us", "vs").mapInArrow(differences, "g long, u long, root long, e long")
    stored = materialize(each)
    sizes = stored.groupBy("g", "u").agg(F.count(F.lit(1)).alias("d"))
    found = _with_roots(stored, ["g", "e"]).groupBy("g", "u").agg(F.sort_array(F.collect_list(F.struct("company", "e"))).alias("es"))  # of one document's shingles
    ordered = found.join(sizes, ["g", "u"]).join(rows.select("g", F.col("row").alias("u"), "root", "n"), ["g", "u"])
    placed = ordered.select("g", "u", "root", "n", "d", F.size("es").alias("m"), F.posexplode("es").alias("at", "x"))
    t, place = _reach(F.col("n"), percent), F.col("d") - F.col("m") + F.col("at")
    first = materialize(placed.filter(place <= t).select("g", "u", "root", "n", "d", "m", "at", F.col("x.e").alias("e"), (place <= F.floor(t / 2)).alias("front")))
    drop_table(stored)
    alive = first.groupBy("g", "e").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("size"), F.bool_or("front").alias("any")).filter("lo != hi AND any").select("g", "e", "size")
    out = materialize(first.join(alive, ["g", "e"]))
    drop_table(first)
    free(rows.sparkSession)
    return out


def open_pairs(lists: DataFrame, percent: int, wide: int) -> DataFrame:
    """Pairs (u, v) of rows of a list, of different roots, that may be linked.

    What they have in common of their differences is at most what both hold before e, e itself and
    what both hold after it; what only one root holds counts against them. A list longer than
    `wide` is dealt to blocks of about so many rows, each of which meets the front rows.
    """
    blocks = F.ceil(F.col("size") / wide).cast("int")
    x = lists.withColumn("block", F.pmod(F.xxhash64("u"), blocks).cast("int")).alias("x")
    y = lists.filter("front").withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).alias("y")
    sizes = F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * percent
    order = (F.col("x.d") > F.col("y.d")) | (F.col("x.d") == F.col("y.d")) & (F.col("x.u") > F.col("y.u"))
    apart = F.lit(100 - percent) * (F.col("x.n") + F.col("y.n"))  # 100 + percent times the most they may differ by
    alone = (F.col("x.d") - F.col("x.m") + F.col("y.d") - F.col("y.m")) * (100 + percent) <= apart
    common = F.least("x.at", "y.at") + 1 + F.least(F.col("x.m") - F.col("x.at"), F.col("y.m") - F.col("y.at")) - 1
    near = (F.col("x.d") + F.col("y.d") - 2 * common) * (100 + percent) <= apart
    met = x.join(y, (F.col("x.g") == F.col("y.g")) & (F.col("x.e") == F.col("y.e")) & (F.col("x.block") == F.col("y.block")) & (F.col("x.root") != F.col("y.root")) & order & sizes & alone & near)
    return met.select(F.col("x.u").alias("u"), F.col("y.u").alias("v")).distinct()


def long_list_pivots(lists: DataFrame, wide: int, turn: int, pivots: int = 4) -> DataFrame:
    """Pairs (u, v) of the rows of long lists with a few pivots of the list, drawn by hashes."""
    long_ = lists.filter(F.col("size") > wide).withColumn("salt", F.pmod(F.xxhash64("u"), F.lit(64)))
    drawn = [F.min(F.struct(F.xxhash64("u", "g", F.lit(turn * pivots + k)).alias("h"), "u", "root")).alias(f"p{k}") for k in range(pivots)]
    parts = long_.groupBy("g", "e", "salt").agg(*drawn)
    whole = parts.groupBy("g", "e").agg(*[F.min(f"p{k}").alias(f"p{k}") for k in range(pivots)])
    some = F.explode(F.array_distinct(F.array(*[F.struct(F.col(f"p{k}.u").alias("v"), F.col(f"p{k}.root").alias("of")) for k in range(pivots)]))).alias("p")
    named = parts.select("g", "e", "salt").join(whole, ["g", "e"]).select("g", "e", "salt", some)
    # Only rows of another root: every link found then joins two components, so this ends.
    return long_.join(named, ["g", "e", "salt"]).filter("root != p.of").select("u", F.col("p.v").alias("v")).distinct()


def linked_components(groups: DataFrame, sets: DataFrame, percent: int, rounds: int, wide: int = 256) -> DataFrame:
    """Components (u, root) of what is linked within the groups (g, row); g is a row, the first pivot.

    Groups are compared with pivots; rows still open go to lists of their differences from the
    pivot. Long lists (rows that share a change) are compared with pivots of their own as long as
    that links anything; then what is left is compared in pairs.
    """
    links, best = climbed(groups, sets, percent, rounds)
    now = materialize(groups.join(best, "g").select(F.col("v").alias("g"), "v", "row").distinct(), "lz4")
    turn, roots = 0, components(links)
    while True:
        open_ = contested(now, roots, sets, percent)
        if open_.isEmpty():
            return roots
        lists = close_lists(open_, sets, percent)
        drop_table(open_)
        fresh = materialize(compared(long_list_pivots(lists, wide, turn), sets, percent).filter("linked").select("u", "v"), "lz4")
        last = fresh.isEmpty()
        if last:
            fresh = materialize(compared(materialize(open_pairs(lists, percent, wide), "lz4"), sets, percent).filter("linked").select("u", "v"), "lz4")
        drop_table(lists)
        if last and fresh.isEmpty():
            return roots
        # The stars found so far stand for all their links.
        roots = components(roots.select("u", F.col("root").alias("v")).union(fresh))
        if last:
            return roots
        turn += 1


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 85, members: int = MEMBERS, depth: int = DEPTH, rounds: int = 3, rows: DataFrame | None = None) -> DataFrame:
    """One row a document: row, doc_id, n_shingles, component_id, kept.

    Documents are linked at 100 * intersection >= percent * union of their sets of shingles;
    component_id is the smallest id reachable (null after all others). Without words (null, empty,
    white space) a document is linked with nothing. Repeated rows are documents of their own with
    the same set. `kept` marks one row a component, that of the smallest id (of rows alike the first).
    """
    if rows is None:
        rows = with_rows(docs, doc_id=F.col(id_col).cast("long"), text=F.col(text_col))
    with arrow_batches(rows.sparkSession, BATCH):
        return _near_components(rows, words, percent, members, depth, rounds)


def _near_components(rows: DataFrame, words: int, percent: int, members: int, depth: int, rounds: int) -> DataFrame:
    signed = materialize(signatures(rows, words, members, depth), "lz4")
    same = ["h1", "h2", "n"]
    # One node for each distinct set, found in two steps, so that a set of many documents is dealt.
    best = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    salted = signed.filter("n > 0").groupBy(*same, F.pmod("row", F.lit(1024)).alias("salt")).agg(F.min(best).alias("best"), F.min("row").alias("row"))
    nodes = salted.groupBy(*same).agg(F.min("best").alias("best"), F.min("row").alias("row"))
    members_of = materialize(
        signed.withColumn("salt", F.pmod("row", F.lit(1024))).join(salted.select(*same, "salt").join(nodes, same), [*same, "salt"], "left")
        .select(signed.row, "doc_id", "n", F.coalesce(nodes.row, signed.row).alias("node"), "sig"), "lz4")
    drop_table(signed)
    keys = materialize(table_keys(members_of.filter("row = node AND n > 0"), members, depth), "lz4")
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    shared = materialize(keys.join(sizes, "key").select("key", "row", "size"), "lz4")
    drop_table(keys)
    free(rows.sparkSession)
    # The pivot is the member with the most company in all its buckets: the text that copies were made of.
    company = shared.groupBy("row").agg(F.sum("size").alias("company"))
    pivots = shared.join(company, "row").groupBy("key").agg(F.max(F.struct("company", "row"))["row"].alias("g"))
    groups = materialize(shared.join(pivots, "key").select("row", "g").distinct(), "lz4")
    drop_table(shared)
    free(rows.sparkSession)
    sets = materialize(full_sets(groups.select(F.col("row").alias("u"), F.col("row").alias("v")), rows, words), "lz4")
    roots = linked_components(groups, sets, percent, rounds)
    drop_table(sets)
    drop_table(groups)
    linked = members_of.join(roots.withColumnRenamed("u", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    by_root = linked.groupBy("root", F.pmod("row", F.lit(1024)).alias("salt")).agg(F.min(best).alias("best"))
    overall = by_root.groupBy("root").agg(F.min("best").alias("best"))
    final = linked.withColumn("salt", F.pmod("row", F.lit(1024))).join(by_root.select("root", "salt").join(overall, "root"), ["root", "salt"])
    return final.select("row", "doc_id", F.col("n").alias("n_shingles"), F.col("best.doc_id").alias("component_id"), (F.col("row") == F.col("best.row")).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents with one of each component, all columns as they came; documents without words stay.

    The row with the smallest id of a component stays, a null id after all others, of repeated rows
    one; an empty table stays empty; columns may have any names.
    """
    stored = with_rows(docs, doc=F.struct(*[docs[c] for c in docs.columns]))
    rows = stored.select("row", F.col(f"doc.{id_col}").cast("long").alias("doc_id"), F.col(f"doc.{text_col}").alias("text"))
    return keep_rows(stored, near_components(docs, rows=rows, **options).filter("kept"))
