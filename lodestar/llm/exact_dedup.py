"""Exact dedup by a tree merge of sorted digest runs, in DataFrame operations only.

Every row has a place in one of `runs` runs (by a hash of its id). A run is sorted by digest and
holds one entry a digest: the row that stays so far and the number of rows. In each round `arity`
neighbouring runs merge into one (sort-based aggregation on run and digest), so after
log_arity(runs) rounds one run is left, itself spread over the tasks by digest. The results then
go down the same tree. A text that a third of all rows share has at most `arity` entries to merge
in each node, and rows / runs rows at the leaves, whatever its size.

Entries are equal only if SHA-256, a second independent hash and the byte length agree, so that a
collision of one digest can't merge different texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, keep_rows, materialize, with_rows

KEY = ["digest", "check", "n_bytes"]


def fingerprints(rows: DataFrame, runs: int) -> DataFrame:
    """Per row: its run, and the digests of the text without white space (null counts as empty)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.translate(text, WHITE, "").cast("binary")
    keyed = rows.select("row", "doc_id", F.length(text).cast("long").alias("points"), bare.alias("bare"))
    return keyed.select(
        "row", "doc_id", "points", F.pmod(F.xxhash64("row", "doc_id"), F.lit(runs)).cast("int").alias("run"),
        F.unhex(F.sha2("bare", 256)).alias("digest"), F.xxhash64("bare").alias("check"), F.octet_length("bare").alias("n_bytes"),
    )


def merge_runs(leaves: DataFrame, runs: int, arity: int) -> list[DataFrame]:
    """The levels of the tree, from the leaves to the one run at the root."""
    levels, width = [leaves], runs
    while width > 1:
        width = -(-width // arity)
        parent = levels[-1].withColumn("run", F.floor(F.col("run") / arity).cast("int"))
        levels.append(parent.groupBy("run", *KEY).agg(F.min("best").alias("best"), F.sum("n").alias("n")))
    return levels


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = 4096, arity: int = 64, rows: DataFrame | None = None) -> DataFrame:
    """One row a document: row, doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the most code points stays, then the one with the smallest id
    (null after all others), then the first of rows that are the same in both.
    Null text counts as empty; an empty table gives no rows; other columns are not read.
    """
    if rows is None:
        rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    keyed = materialize(fingerprints(rows, runs))
    best = F.struct((-F.col("points")).alias("minus_points"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("row").alias("row"))
    leaves = keyed.groupBy("run", *KEY).agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("n"))
    levels = merge_runs(leaves, runs, arity)
    down = levels[-1]
    for level in reversed(levels[:-1]):
        below = level.select(F.col("run").alias("child"), F.floor(F.col("run") / arity).cast("int").alias("run"), *KEY)
        down = below.join(down, ["run", *KEY]).select(F.col("child").alias("run"), *KEY, "best", "n")
    out = keyed.join(down, ["run", *KEY])
    return out.select(
        "row", "doc_id", F.col("best.id").alias("keep_id"), F.col("n").cast("long").alias("group_size"),
        (F.col("best.row") == F.col("row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = 4096, arity: int = 64) -> DataFrame:
    """The documents with one of each group of equal texts, all columns as they came.

    Null text counts as empty, so of all empty ones one stays; of repeated rows one stays; a null id
    comes after all others; an empty table stays empty; columns may have any names.
    """
    stored = with_rows(docs, doc=F.struct(*[docs[c] for c in docs.columns]))
    rows = stored.select(F.col(f"doc.{id_col}").alias("doc_id"), F.col(f"doc.{text_col}").alias("text"), "row")
    groups = exact_groups(docs, runs=runs, arity=arity, rows=rows)
    return keep_rows(stored, groups.filter("kept"))
