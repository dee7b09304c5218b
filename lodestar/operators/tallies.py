"""Counts and classes over facts: shares, merged scan results, censuses, cross-tables, modes, agreement.

Keys may be null: they are a group of their own, unless a function says that they are left out. An
empty table gives no rows. Counts are made where the rows are before anything is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import crowded, dealt
from .ranks import top


def used_among(rows: DataFrame, key: str, used: DataFrame) -> DataFrame:
    """Rows whose key occurs in `used` (the key's column), each once however often it occurs there; null occurs nowhere."""
    return rows.join(used.select(key).distinct(), key, "left_semi")


def counter_shares(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, n, pct: the merged counts of groups and their share of all rows in percent."""
    n = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    total = F.broadcast(n.agg(F.sum("n").alias("__all")))  # one row
    return n.join(total).select(*by, "n", F.round(100 * F.col("n") / F.col("__all"), 6).alias("pct"))


def merged_scans(rows: DataFrame, key: str, sums: list[str], items: str, kinds: str) -> DataFrame:
    """key, the sums, items and kinds of the results of one scan each: numbers add up, items (arrays) are joined in order, kinds are counted once.

    Items of one key are one array, as a result holds them: a key is one scan's scope, not a source of rows.
    """
    listed = F.sort_array(F.flatten(F.collect_list(items)))
    return rows.groupBy(key).agg(*[F.sum(c).alias(c) for c in sums], listed.alias(items), F.count_distinct(kinds).alias(kinds))


def reachable_reads(reads: DataFrame, body: str, reachable: DataFrame, key: str, in_loop: Column) -> DataFrame:
    """key, sites, bodies, in_loop: what reachable bodies read, how often, in how many bodies and how often in a loop.

    Reads are dealt by body and sorted once, so the first read of a key in its body is known before
    bodies meet the reachable ones: no task holds a table of (key, body). Reads of a body that has more
    than fit a task are counted by key where they are.
    """
    n, _, hot = crowded(reads, body)
    rows = reads.select(body, key, in_loop.alias("__loop"))
    sites, loops = F.lit(1).cast("long"), F.coalesce(F.col("__loop").cast("int"), F.lit(0)).cast("long")
    if hot is not None:
        many = rows.filter(hot).groupBy(body, key).agg(F.sum(sites).alias("__sites"), F.sum(loops).alias("__loops"))
        rows = rows.filter(~hot).select(body, key, sites.alias("__sites"), loops.alias("__loops")).unionByName(many)
        sites, loops = F.col("__sites"), F.col("__loops")
    first = F.row_number().over(Window.partitionBy(body, key).orderBy(key)) == 1
    kept = dealt(rows, n, body).withColumn("__first", first).join(dealt(reachable.select(body).distinct(), n, body), body)
    return kept.groupBy(key).agg(F.sum(sites).alias("sites"), F.count_if("__first").alias("bodies"), F.sum(loops).alias("in_loop"))


def with_examples(rows: DataFrame, key: str, example: str, limit: int = 5) -> DataFrame:
    """key, n, examples: the rows of a key and its first `limit` examples in order.

    Examples are made distinct, then taken by two levels of ranks, so a key of any size brings `limit`
    texts to its group, not all of them.
    """
    counted = rows.groupBy(key, example).agg(F.count(F.lit(1)).alias("__n"))
    few = top(counted.filter(F.col(example).isNotNull()), key, [F.col(example)], limit, F.xxhash64(example))
    shown = few.groupBy(key).agg(F.sort_array(F.collect_list(example)).alias("examples"))
    totals = counted.groupBy(key).agg(F.sum("__n").alias("n")).withColumnRenamed(key, "__key")
    met = totals.join(shown, F.col("__key").eqNullSafe(F.col(key)), "left")
    return met.select(F.col("__key").alias(key), "n", F.coalesce("examples", F.array().cast("array<string>")).alias("examples"))


def registration_table(rows: DataFrame, by: str, known: Column, found: Column) -> DataFrame:
    """by, hit, missed, unresolved: registrations whose listener is known and found, known and not found, unknown (null counts as no)."""
    k, f = F.coalesce(known, F.lit(False)), F.coalesce(found, F.lit(False))
    return rows.groupBy(by).agg(F.count_if(k & f).alias("hit"), F.count_if(k & ~f).alias("missed"), F.count_if(~k).alias("unresolved"))


def burst_modes(rows: DataFrame, load: str, early: Column, late: Column, slow: Column, share: float = 0.05) -> DataFrame:
    """load, mode: when the bursts of a load come: at load (late ones are less than `share`), in play (some are slow), by windows, or unknown without any."""
    c = rows.groupBy(load).agg(F.count_if(early).alias("__early"), F.count_if(late).alias("__late"), F.count_if(slow).alias("__slow"))
    both = F.col("__early") + F.col("__late")
    mode = F.when(both == 0, "unknown").when(F.col("__late") < share * both, "at load").when(F.col("__slow") > 0, "in play").otherwise("by windows")
    return c.select(load, mode.alias("mode"))


def trace_classes(rows: DataFrame, by: list[str], hard: Column, stopped: Column, abort: Column) -> DataFrame:
    """by, mode: any hard abort makes a body interpreted, else a finished trace makes it compiled, else any abort mixed; without events no-trace."""
    s = rows.groupBy(*by).agg(F.coalesce(F.bool_or(hard), F.lit(False)).alias("__hard"), F.coalesce(F.bool_or(stopped), F.lit(False)).alias("__stopped"), F.count_if(abort).alias("__aborts"))
    mode = F.when(F.col("__hard"), "interpreted").when(F.col("__stopped"), "compiled").when(F.col("__aborts") > 0, "mixed").otherwise("no-trace")
    return s.select(*by, mode.alias("mode"))


def agreement(predicted: DataFrame, observed: DataFrame, line: str) -> DataFrame:
    """covered, agreement: of the predictions (line, predicted) whose line was observed (line, observed), how many and the share that came true (null of none)."""
    met = predicted.join(observed, line)
    return met.agg(F.count(F.lit(1)).alias("covered"), F.round(F.avg((F.col("predicted") == F.col("observed")).cast("int")), 6).alias("agreement"))


def sample_until(rows: DataFrame, ident: str, hit: Column, want: int, seed: int = 13) -> DataFrame:
    """The rows of a shuffled order up to the one with which `want` hits are found, with `place_hash`; all rows if there are fewer hits.

    The order is that of a hash of seed and id (of equal hashes by id), the same for any dealing of the
    rows. Only the hits' `want` smallest hashes are gathered, each task's at most; nothing is sorted as
    a whole. With want 0 there are no rows.
    """
    placed = rows.withColumn("place_hash", F.xxhash64(F.lit(seed), F.col(ident).cast("string")))
    if want <= 0:
        return placed.limit(0)
    order = F.struct("place_hash", F.col(ident).cast("string").alias("id"))
    last = placed.filter(F.coalesce(hit, F.lit(False))).select(order.alias("o")).orderBy("o").limit(want).agg(F.max("o").alias("__last"), F.count(F.lit(1)).alias("__hits"))
    return placed.join(F.broadcast(last)).filter((F.col("__hits") < want) | (order <= F.col("__last"))).drop("__last", "__hits")  # one row joined
