"""Ordered analytics and sequential state: gaps, fills, survivors, verdicts, markers, rollbacks, trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import crowded, dealt, stored
from .ranks import ranked_values


def gaps(rows: DataFrame, key: str, t: str) -> DataFrame:
    """Gaps between consecutive rows: their number and upper median (in units of `t`)."""
    gap = F.col(t) - F.lag(t).over(Window.partitionBy(key).orderBy(t))
    each = stored(rows.withColumn("__gap", gap).filter("__gap IS NOT NULL").select(key, "__gap"))
    n = each.groupBy(key).agg(F.count(F.lit(1)).alias("gaps"))
    median = ranked_values(each, [key], "__gap", n.select(key, F.floor(F.col("gaps") / 2).alias("__rank")))
    return n.join(median, key).select(key, F.col("gaps").cast("int").alias("gaps"), F.col("__value").cast("long").alias("median_gap"))


def fill_forward(rows: DataFrame, key: str, order: list[str], value: Column, into: str) -> DataFrame:
    """The last value so far (this row's own included)."""
    return rows.withColumn(into, F.last(value, ignorenulls=True).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def survivors(rows: DataFrame, generation: str, score: str, ident: str, beam: int, least: float) -> DataFrame:
    """Status of each scored row: the best `beam` of a generation with a score of at least `least` stay; unscored ones are open."""
    place = F.row_number().over(Window.partitionBy(generation).orderBy(F.col(score).desc_nulls_last(), ident))
    status = F.when(F.col(score).isNull(), "open").when((F.col("place") <= beam) & (F.col(score) >= least), "kept").otherwise("pruned")
    return rows.withColumn("place", place).withColumn("status", status)


def drop_first(rows: DataFrame, run: str, order: list[str], n: int) -> DataFrame:
    return rows.withColumn("__place", F.row_number().over(Window.partitionBy(run).orderBy(*order))).filter(F.col("__place") > n).drop("__place")


def sweep_verdict(rows: DataFrame, group: str, k: str, ok: str) -> DataFrame:
    """Over a sweep: pass-all, fail-all, or from which k on it never fails again (mixed if from none)."""
    rest = Window.partitionBy(group).orderBy(k).rowsBetween(0, Window.unboundedFollowing)
    held = rows.withColumn("__held", F.min(F.col(ok).cast("int")).over(rest))
    out = held.groupBy(group).agg(F.bool_and(ok).alias("all_ok"), F.bool_or(ok).alias("any_ok"), F.min(F.when(F.col("__held") == 1, F.col(k))).alias("from_k"))
    verdict = F.when(F.col("all_ok"), "pass").when(~F.col("any_ok"), "fail").when(F.col("from_k").isNotNull(), "from").otherwise("mixed")
    return out.select(group, verdict.alias("verdict"), F.when(~F.col("all_ok"), F.col("from_k")).alias("from_k"))


def inside(rows: DataFrame, key: str, order: list[str], opens: Column, closes: Column, into: str) -> DataFrame:
    """Whether the last marker so far opened a section (the state machine of a log)."""
    marker = F.when(opens, F.lit(True)).when(closes, F.lit(False))
    return rows.withColumn(into, F.coalesce(F.last(marker, ignorenulls=True).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)), F.lit(False)))


def rollback(rows: DataFrame, group: str, admitted: Column) -> DataFrame:
    """A group's rows stay only if every one of them was admitted."""
    return rows.withColumn("applied", F.bool_and(admitted).over(Window.partitionBy(group)))


def max_path(rows: DataFrame, keys: list[str], chain: str) -> DataFrame:
    """keys, worst, flat: the most rows of a key that one run can meet, and all of them.

    `chain` is the path of a row through nested forks, an array of structs (fork, branch). Of the
    branches of a fork only one is taken, so it counts with its largest; forks and rows side by side
    add up. Innermost forks are folded first, into the first of their rows. Rows are dealt by key and
    sorted along their paths once; all levels are windows in that order. Rows of a key that has more
    than fit a task are counted by path where they are.
    """
    total, deepest, hot = crowded(rows, *keys, most=F.size(chain))
    deepest = max(deepest or 0, 0)
    path = [f"__{part}{i}" for i in range(deepest) for part in ("fork", "branch")]
    steps = [F.get(chain, F.lit(i))[part].alias(f"__{part}{i}") for i in range(deepest) for part in ("fork", "branch")]
    now, n = rows.select(*keys, F.coalesce(F.size(chain), F.lit(0)).alias("__deep"), *steps), F.lit(1).cast("long")
    if hot is not None:
        many = now.filter(hot).groupBy(*now.columns).agg(F.sum(n).alias("__rows"))
        now, n = now.filter(~hot).withColumn("__rows", n).unionByName(many), F.col("__rows")
    now, flat = dealt(now, total, *keys), F.sum(n).alias("flat")
    for depth in range(deepest, 0, -1):
        # Rows of this depth are counted by branch, the largest goes to the fork's first row; others are by themselves.
        ends, upto = F.col("__deep") >= depth, 2 * depth
        fork = Window.partitionBy(*keys, *path[: upto - 1]).orderBy(*path[upto - 1 :])
        now = now.withColumn("__sum", F.sum(F.when(ends, n)).over(Window.partitionBy(*keys, *path[:upto])))
        largest = F.max("__sum").over(fork.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        place = F.count(F.when(ends, 1)).over(fork.rowsBetween(Window.unboundedPreceding, 0))
        now = now.withColumns({"__largest": largest, "__place": place})
        now = now.withColumn("__n", F.when(~ends, n).when(F.col("__place") == 1, F.col("__largest")).otherwise(0))
        n = F.col("__n")
    return now.groupBy(*keys).agg(F.sum(n).alias("worst"), flat)
