"""Joins two tables of names at an edit distance of at most one, by partitioned neighbourhoods.

A name of n code points is cut into three pieces, at n // 3 and n - n // 3. One edit (insertion,
deletion, substitution, exchange of neighbours) lies in one piece, or is an exchange across a
border, which is one plain edit in either piece beside it; so of two names at distance one, some
piece is within one plain edit of its counterpart. Two strings within one plain edit, and two that
differ by an exchange, have a one-deletion variant in common or are alike.

The left names' pieces give their one-deletion variants. A right name is cut as a left name of one
code point fewer, as many, or one more would be: its pieces are substrings shifted by the
difference of lengths. A key holds the piece's variant and what stands before and after the piece,
which the edit leaves alone. A common piece by itself would be a hot key (a first name that a third
of all rows share); with its surroundings a key holds at most the names that are one code point
apart. Whole names are verified afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def plain_form(name: Column) -> Column:
    """A-Z lower-cased, white space removed; null if nothing is left."""
    bare = F.translate(name, UPPER + WHITE, UPPER.lower())
    return F.when(bare != "", bare)


def pieces(n: int) -> list[tuple[int, int]]:
    """Where the three pieces of a name of n code points lie; the middle one is empty only if the name is."""
    return [(0, n // 3), (n // 3, n - n // 3), (n - n // 3, n)]


def _key(n: int, piece: int, kind: str, before: str, variant: str, after: str) -> str:
    return f"{n}\0{piece}{kind}\0{before}\0{variant}\0{after}"


def _shorter(piece: str) -> set[str]:
    return {piece[:i] + piece[i + 1 :] for i in range(len(piece))}


def _across(name: str, cuts: list[tuple[int, int]]) -> set[str]:
    """For an exchange across a border: the code points beside it in sorted order, the rest as it is."""
    out = set()
    for border in {cuts[0][1], cuts[1][1]}:
        if 0 < border < len(name):
            out.add(_key(len(name), border, "x", name[: border - 1], "".join(sorted(name[border - 1 : border + 1])), name[border + 1 :]))
    return out


def left_keys(name: str) -> set[str]:
    """Keys of a name whose pieces are cut at its own length: each piece itself ("w") and its one-deletion variants ("d")."""
    cuts = pieces(len(name))
    out = _across(name, cuts)
    for k, (a, b) in enumerate(cuts):
        out.add(_key(len(name), k, "w", name[:a], name[a:b], name[b:]))
        out.update(_key(len(name), k, "d", name[:a], v, name[b:]) for v in _shorter(name[a:b]))
    return out


def right_keys(name: str) -> set[str]:
    """Keys under which a name finds all left names at a distance of at most one."""
    out = _across(name, pieces(len(name)))
    for more in (-1, 0, 1):  # code points it has more than the left name
        n = len(name) - more
        if n < 1:
            continue
        for k, (a, b) in enumerate(pieces(n)):
            if b + more < a:  # an empty piece can't be shorter
                continue
            before, piece, after = name[:a], name[a : b + more], name[b + more :]
            if more <= 0:
                out.add(_key(n, k, "w" if not more else "d", before, piece, after))
            if more >= 0:
                out.update(_key(n, k, "w" if more else "d", before, v, after) for v in _shorter(piece))
    return out


def _keyed(names: DataFrame, side: str) -> DataFrame:
    """(key, name): the hashed keys of each distinct name."""
    make = left_keys if side == "left" else right_keys

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 2000):
                known = batch.column(0).slice(first, 2000).to_pylist()
                found = [(k, n) for n in known for k in make(n)]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([n for _, n in found], pa.string())], names=["key", "name"])

    return names.select("name").mapInArrow(each, "key string, name string").select(F.xxhash64("key").alias("key"), F.col("name").alias(side))


def distance_to_one(a: Column, b: Column) -> Column:
    """0 or 1 if that is the unrestricted Damerau-Levenshtein distance, else null."""
    plain = F.levenshtein(a, b, 2)
    n = F.length(a)
    swapped = F.exists(F.sequence(F.lit(1), n - 1), lambda i: F.concat(F.substr(a, F.lit(1), i - 1), F.substr(a, i + 1, F.lit(1)), F.substr(a, i, F.lit(1)), F.substr(a, i + 2)) == b)
    return F.when(a == b, 0).when(plain == 1, 1).when((plain == 2) & (n == F.length(b)) & (n > 1) & swapped, 1)


def name_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left, right, distance): the pairs at a distance of at most one of two tables of names (column `name`).

    Names are compared as they are; null and empty ones take no part, repeated ones count once; an
    empty table gives no rows. Nothing is broadcast: both sides are dealt by key.
    """
    one, two = (t.select("name").filter("name != ''").distinct() for t in (left, right))
    met = _keyed(one, "left").hint("merge").join(_keyed(two, "right"), "key")
    return met.select("left", "right", distance_to_one(F.col("left"), F.col("right")).alias("distance")).filter("distance IS NOT NULL").distinct()


def joined_names(vendors: DataFrame, clients: DataFrame, vendor_id: str = "vendor_id", vendor_name: str = "name", client_id: str = "client_id", client_name: str = "name") -> DataFrame:
    """Per vendor and exact distance with a pair: vendor_id, distance, n_clients, first_client_id, clients_crc.

    Names are compared in their plain form; null ones and those without anything but white space
    take no part. Every client row counts, also repeated ones; a repeated vendor row (id and name)
    counts once. A null client id is counted but is neither first nor in the sum. Extra columns are
    not read.

    Equal names are one row on either side before they meet, so a name of a third of all clients is
    a row a task; the join back to vendors splits where a name is very common (AQE).
    """
    sold = vendors.select(F.col(vendor_id).alias("vendor_id"), plain_form(F.col(vendor_name)).alias("name")).filter("name IS NOT NULL").distinct()
    held = clients.select(F.col(client_id).alias("id"), plain_form(F.col(client_name)).alias("name")).filter("name IS NOT NULL")
    known = held.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), F.sum(F.crc32(F.col("id").cast("string").cast("binary"))).alias("crc"))
    pairs = name_pairs(sold, known)
    counted = pairs.hint("merge").join(known.withColumnRenamed("name", "right"), "right").groupBy("left", "distance")
    totals = counted.agg(F.sum("n").alias("n_clients"), F.min("first").alias("first_client_id"), F.coalesce(F.sum("crc"), F.lit(0)).alias("clients_crc"))
    found = sold.hint("merge").join(totals.withColumnRenamed("left", "name"), "name")
    return found.groupBy("vendor_id", "distance").agg(F.sum("n_clients").alias("n_clients"), F.min("first_client_id").alias("first_client_id"), F.sum("clients_crc").alias("clients_crc"))


def misspelt(vendor_id: Column, name: Column) -> Column:
    """The name with two neighbouring code points exchanged, where the id's crc32 is even and the name has two at least."""
    h, n = F.crc32(vendor_id.cast("string").cast("binary")), F.length(name)
    at = F.pmod(h, (n - 1).cast("long")).cast("int")  # counted from 0
    swapped = F.concat(F.substr(name, F.lit(1), at), F.substr(name, at + 2, F.lit(1)), F.substr(name, at + 1, F.lit(1)), F.substr(name, at + 3))
    return F.when((h % 2 == 0) & (n >= 2), swapped).otherwise(name)
