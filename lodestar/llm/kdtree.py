"""Sharding by a k-d tree over document metadata, split at distributed weighted medians.

All nodes of a level are split together. A node splits along its widest dimension (its extent
against the whole table's), at the key below which its share of the bytes lies. Keys are the
dimension's value scaled to 40 bits and a hash of the row, so equal values split too. The median is
found in passes over histograms of 65,536 bins between the bounds known so far; only the bin that
holds it, a row a node, comes to the driver. What the driver holds grows with the number of shards,
never with the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, numbered

BINS, TIE_BITS, SCALE_BITS = 16, 22, 40


#: Distinct texts of a column up to which their ranks are broadcast.
FEW = 10_000


def with_ranks(rows: DataFrame, name: str) -> DataFrame:
    """The rows with a text column replaced by the rank of its value among all distinct values (null stays null).

    Values are sorted by ranges, ranked within a range, and moved by the ranges before, a row a range.
    """
    values = rows.select(name).filter(F.col(name).isNotNull()).distinct().repartitionByRange(name)
    ranges = materialize(values.withColumn("__range", F.spark_partition_id()), "lz4")
    within = ranges.withColumn("__in", F.row_number().over(Window.partitionBy("__range").orderBy(name)))
    counts = ranges.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))  # a row a range
    offsets = counts.select("__range", F.coalesce(before, F.lit(0)).alias("__before"))
    ranks = within.join(F.broadcast(offsets), "__range").select(F.col(name).alias("__value"), (F.col("__before") + F.col("__in")).alias("__rank"))
    if ranges.count() <= FEW:
        ranks = F.broadcast(ranks)
    met = rows.join(ranks, F.col(name) == F.col("__value"), "left")
    return met.select(*[F.col("__rank").alias(c) if c == name else F.col(c) for c in rows.columns])


def as_number(df: DataFrame, name: str) -> Column:
    """A metadata column as a number in the same order, null below all others; texts have to be ranks by now."""
    return F.coalesce(F.col(name).cast("double"), F.lit(-1.0))


def kd_shards(rows: DataFrame, dims: list[str], size: str, leaves: int | None = None, target_bytes: int | None = None, tolerance: float = 1e-3) -> DataFrame:
    """The rows with `shard`, 0 .. leaves - 1 in the tree's order, of nearly equal sums of `size`.

    `leaves`, or as many as bring each leaf to `target_bytes`. Null metadata counts as lowest; an
    empty table gives no rows; rows that are the same in all are split only as far as `row` differs.
    """
    spark, given = rows.sparkSession, rows
    rows = rows.select("row", size, *[d for d in dims if d not in ("row", size)])
    for d in dims:
        if dict(rows.dtypes)[d] == "string":
            rows = with_ranks(rows, d)
    if any(dict(given.dtypes)[d] == "string" for d in dims):
        rows = materialize(rows, "lz4")
    span = rows.agg(F.sum(size).alias("total"), *[F.min(as_number(rows, d)).alias(f"lo{i}") for i, d in enumerate(dims)], *[F.max(as_number(rows, d)).alias(f"hi{i}") for i, d in enumerate(dims)]).first()
    if span.total is None:
        return given.withColumn("shard", F.lit(0))
    leaves = leaves or max(1, -(-int(span.total) // int(target_bytes)))
    tie = F.shiftrightunsigned(F.xxhash64("row"), 64 - TIE_BITS)

    def key(i: int, d: str) -> Column:
        lo, width = span[f"lo{i}"], span[f"hi{i}"] - span[f"lo{i}"]
        scaled = F.floor((as_number(rows, d) - lo) / width * ((1 << SCALE_BITS) - 1)).cast("long") if width > 0 else F.lit(0).cast("long")
        return (F.shiftleft(scaled, TIE_BITS) + tie).alias(f"k{i}")

    small = materialize(rows.select("row", F.col(size).cast("long").alias("bytes"), F.lit(0).alias("node"), *[key(i, d) for i, d in enumerate(dims)]), "lz4")
    ks = [f"k{i}" for i in range(len(dims))]
    #: node -> first shard, number of shards, the node's box: lowest key and the key after the highest of each dimension
    tree = {0: (0, leaves, [(0, 1 << (SCALE_BITS + TIE_BITS) if span[f"hi{i}"] > span[f"lo{i}"] else 1 << TIE_BITS) for i in range(len(dims))])}
    per_leaf, level = span.total / leaves, 0
    while any(many > 1 for _, many, _ in tree.values()):
        asked = []
        for n, (_, many, box) in tree.items():
            if many > 1:
                axis = max(range(len(box)), key=lambda i: (box[i][1] - 1 >> TIE_BITS) - (box[i][0] >> TIE_BITS))
                asked.append((n, axis, *box[axis], 0.0, many // 2 / many, None))
        splits = _medians(spark, small, asked, len(dims), per_leaf * tolerance)
        table = F.broadcast(spark.createDataFrame([(n, a, s) for n, (a, s) in splits.items()], "node int, axis int, split long"))  # a row a node
        pick = F.element_at(F.array(*ks), F.col("axis") + 1)
        small = small.join(table, "node", "left").withColumn("node", F.when(F.col("split").isNull(), F.col("node") * 2).otherwise(F.col("node") * 2 + (pick >= F.col("split")).cast("int"))).drop("axis", "split")
        level += 1
        if not level % 3:
            small = materialize(small, "lz4")
        grown = {}
        for n, (first, many, box) in tree.items():
            if n in splits:
                axis, at = splits[n]
                cut = lambda lo, hi, box=box, axis=axis: [(lo, hi) if i == axis else b for i, b in enumerate(box)]
                grown[2 * n] = (first, many // 2, cut(box[axis][0], at))
                grown[2 * n + 1] = (first + many // 2, many - many // 2, cut(at, box[axis][1]))
            else:
                grown[2 * n] = (first, 1, box)
        tree = grown
    named = F.broadcast(spark.createDataFrame([(n, first) for n, (first, _, _) in tree.items()], "node long, shard int"))  # a row a shard
    return given.join(small.select("row", F.col("node").cast("long").alias("node")).join(named, "node").select("row", "shard"), "row")


def _medians(spark, small: DataFrame, asked: list, n_dims: int, enough: float) -> dict[int, tuple[int, int]]:
    """node -> (axis, key): the rows of the node with a smaller key have about the asked share of its bytes.

    asked: node, axis, bounds of the key, bytes below them, share, and the bytes it makes once known.
    """
    found: dict[int, tuple[int, int]] = {}
    schema = "node int, axis int, lo long, hi long, below double, share double, want double, step long"
    while asked:
        bounds = F.broadcast(spark.createDataFrame([(*a, max(1, -(-(a[3] - a[2]) >> BINS))) for a in asked], schema))  # a row a node
        pick = F.element_at(F.array(*[f"k{i}" for i in range(n_dims)]), F.col("axis") + 1)
        inside = small.join(bounds, "node").withColumn("key", pick).filter("key >= lo AND key < hi")
        bins = inside.groupBy("node", F.floor((F.col("key") - F.col("lo")) / F.col("step")).cast("long").alias("bin")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"))
        by_node = Window.partitionBy("node")
        upto = bins.join(bounds, "node").select("node", "bin", "bytes", "n", "axis", "lo", "hi", "step", "share", F.coalesce("want", F.col("share") * F.sum("bytes").over(by_node)).alias("want"), (F.col("below") + F.sum("bytes").over(by_node.orderBy("bin"))).alias("upto"))
        hit = upto.filter("upto >= want").groupBy("node").agg(F.min(F.struct("bin", "upto", "bytes", "n", "axis", "lo", "hi", "step", "share", "want")).alias("x")).select("node", "x.*").collect()  # a row a node
        rest, left = [], {a[0]: a for a in asked}
        for r in hit:
            lo, before = r.lo + r.bin * r.step, r.upto - r.bytes
            hi = min(lo + r.step, r.hi)
            if r.step == 1 or r.n == 1 or r.bytes <= enough:
                # The bin goes to the side that leaves the halves closer to what is asked for.
                found[r.node] = (r.axis, lo if r.want - before < r.upto - r.want else hi)
            else:
                rest.append((r.node, r.axis, lo, hi, float(before), r.share, r.want))
            left.pop(r.node)
        for n, a, _, hi, *_ in left.values():
            found[n] = (a, hi)
        asked = rest
    return found


def document_shards(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", dims: tuple[str, ...] = ("doc_id", "lang", "source", "bytes")) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: a row a document; shards hold nearly the same bytes.

    A document's size is its UTF-8 bytes (null: none) plus 8. Slots number a shard's documents
    without gaps. Metadata columns that the table lacks are left out.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    has = [c for c in dims if c in docs.columns and c not in (id_col, "doc_id", "bytes")]
    meta = materialize(docs.select(F.col(id_col).alias("doc_id"), *has, (F.octet_length(text) + 8).cast("long").alias("bytes"), F.crc32(text).alias("text_crc32"), F.monotonically_increasing_id().alias("row")), "lz4")
    dealt = kd_shards(meta, [d for d in dims if d in meta.columns], "bytes", leaves=shards)
    order = [F.col("doc_id").asc_nulls_last(), F.col("row")]
    placed = numbered(dealt, ["shard"], order, F.lit(1), "slot", spread=F.xxhash64("row"))
    return placed.select("doc_id", F.col("bytes").alias("size"), "text_crc32", "shard", "slot")
