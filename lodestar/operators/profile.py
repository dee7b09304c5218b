"""Profiler windows, slow frames and hitches: rates, spreads between runs, tails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import spread


def run_spread(windows: DataFrame, arm: str, run: str, value: str, drop_runs: int = 0) -> DataFrame:
    """The spread between an arm's runs of their means over windows; `drop_runs` leaves out the first runs of an arm (cold ones)."""
    by_run = windows.groupBy(arm, run).agg(F.avg(value).alias("__mean"))
    kept = by_run.withColumn("__place", F.row_number().over(Window.partitionBy(arm).orderBy(run))).filter(F.col("__place") > drop_runs)  # a row a run
    return spread(kept, [arm], "__mean")


def cold_and_warm(windows: DataFrame, arm: str, run: str, value: str) -> DataFrame:
    """An arm's mean of run means with all runs and without the first, and the change against the arm of least name in percent."""
    both = run_spread(windows, arm, run, value).select(arm, F.col("n").alias("runs"), F.col("mean").alias("cold")).join(run_spread(windows, arm, run, value, 1).select(arm, F.col("mean").alias("warm")), arm, "left")
    base = F.broadcast(both.agg(F.min_by(F.struct("cold", "warm"), arm).alias("base")))  # one row
    change = lambda c: F.when(F.col(f"base.{c}") != 0, F.bround(100 * (F.col(c) - F.col(f"base.{c}")) / F.col(f"base.{c}"), 2))
    return both.join(base).select(arm, "runs", "cold", "warm", change("cold").alias("cold_pct"), change("warm").alias("warm_pct"))


def ranking_over_runs(entries: DataFrame, run: str, name: str, cost: str, frames: DataFrame) -> DataFrame:
    """A name's cost a frame, averaged over the runs that have it, with its spread between them; `frames`: (run, frames)."""
    rate = entries.groupBy(run, name).agg(F.sum(cost).alias("__c")).join(frames, run).withColumn("__rate", F.col("__c") / F.col("frames"))
    return spread(rate, [name], "__rate").select(name, F.col("n").alias("runs"), F.col("mean").alias("per_frame"), "cv_pct")


def overhead(windows: DataFrame, run: str, calls: str, nested: str, frames: str, ns: Column) -> DataFrame:
    """What the instrument costs a frame in ms: ns a call, over all calls and frames of a run; null without frames."""
    return windows.groupBy(run).agg((F.sum(F.col(calls) + F.col(nested)) * ns / F.nullif(F.sum(frames), F.lit(0)) / 1e6).alias("overhead_ms"))


def slow_frames(frames: DataFrame, ms: str, floor: float, artefact: Column) -> DataFrame:
    """Frames of `floor` ms or more that no log flush explains."""
    return frames.filter((F.col(ms) >= floor) & ~F.coalesce(artefact, F.lit(False)))


def frame_summary(frames: DataFrame, run: str, ms: str, share: str, collected_kb: str, least_kb: float = -64) -> DataFrame:
    """n, worst, medians, and the frames in which the collector freed more than 64 kB."""
    return frames.groupBy(run).agg(
        F.count(F.lit(1)).alias("n"), F.max(ms).alias("worst_ms"), F.median(ms).alias("median_ms"), F.median(share).alias("median_share"), F.count_if(F.col(collected_kb) < least_kb).alias("gc_frames")
    )


def top_scopes(frames: DataFrame, run: str, top: str, limit: int) -> DataFrame:
    """The dearest scopes of slow frames: `top` is an array of (label, ms); marks without a name don't count."""
    each = frames.select(run, F.explode(top).alias("x")).filter("x.label NOT IN ('', '-') AND x.ms IS NOT NULL")
    sums = each.groupBy(run, F.col("x.label").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.sum("x.ms").alias("ms"), F.max("x.ms").alias("max_ms"))
    place = F.row_number().over(Window.partitionBy(run).orderBy(F.col("ms").desc(), "label"))  # a row a scope
    return sums.withColumn("place", place).filter(F.col("place") <= limit)


def trimmed(samples: DataFrame, run: str, t: str, warm_up: float) -> DataFrame:
    """Samples from `warm_up` on, their clock from 0; a run that is over by then keeps its last sample."""
    ends = samples.groupBy(run).agg(F.max(t).alias("__end"), F.min(F.when(F.col(t) >= warm_up, F.col(t))).alias("__from"))
    first = F.coalesce("__from", "__end")
    return samples.join(ends, run).filter(F.col(t) >= first).withColumn(t, F.col(t) - first).drop("__end", "__from")


def tail_bracket(hits: DataFrame, by: list[str], buckets: str, floor: str, above: str, calls: str, p: float) -> DataFrame:
    """Bounds of a percentile from the counts of log2 buckets above a floor, found from the top down.

    Calls that never crossed the floor come in by `calls`; `above` is the lesser bound of it. The top
    bucket is open (no upper bound); a percentile below all buckets lies in (0, floor).
    """
    total = F.greatest(calls, above)
    at = hits.select(*by, floor, total.alias("__total"), F.size(buckets).alias("__n"), F.posexplode(buckets).alias("__i", "__c"))
    down = F.sum("__c").over(Window.partitionBy(*by).orderBy(F.col("__i").desc()))  # a row a bucket
    met = at.withColumn("__seen", down).filter((F.col("__total") > 0) & (F.col("__seen") >= F.col("__total") * (1 - p))).groupBy(*by).agg(F.max(F.struct("__i", "__n")).alias("__hit"))
    lo = F.col(floor) * F.pow(F.lit(2.0), F.col("__hit.__i").cast("double"))
    joined = hits.join(met, by, "left")
    top = F.col("__hit.__i") == F.col("__hit.__n") - 1
    return joined.select(*by, F.coalesce(lo, F.lit(0.0)).alias("p_lo"), F.when(F.col("__hit").isNull(), F.col(floor).cast("double")).when(~top, lo * 2).alias("p_hi"))


def merged_hitches(hits: DataFrame, by: list[str]) -> DataFrame:
    """Hitches of an arm's runs: calls add up, the worst counts, the first slow call is that of the least frame, the bracket the highest."""
    return hits.groupBy(*by).agg(F.sum("calls").alias("calls"), F.max("max_ms").alias("max_ms"), F.min("first_frame").alias("first_frame"), F.max(F.struct("p_lo", "p_hi")).alias("__p")).select(*by, "calls", "max_ms", "first_frame", "__p.p_lo", "__p.p_hi")


def growth_split(calls: DataFrame, key: str, before: str, after: str, cost: str) -> DataFrame:
    """Mean cost of calls that grew something and of those that did not."""
    grew = F.col(after) > F.col(before)
    return calls.groupBy(key).agg(F.count_if(grew).alias("grew"), F.avg(F.when(grew, F.col(cost))).alias("grew_mean"), F.avg(F.when(~grew, F.col(cost))).alias("flat_mean"))


def trains(frames: DataFrame, key: str, t: str, lo: int, hi: int, rows: int) -> DataFrame:
    """Whether one of the last `rows` rows of a key came lo to hi units of `t` earlier."""
    order = Window.partitionBy(key).orderBy(t)
    hit = F.lit(False)
    for back in range(1, rows + 1):
        gap = F.col(t) - F.lag(t, back).over(order)
        hit = hit | F.coalesce(gap.between(lo, hi), F.lit(False))
    return frames.withColumn("in_train", hit)


def slow_start(frames: DataFrame, run: str, t: str, ms: str, floor: float = 12.0, first: float = 90.0) -> DataFrame:
    """run, slow, worst, lost_ms: frames of `floor` or more in a run's first seconds, the worst, and what they took beyond the floor; runs without one are left out."""
    early = frames.filter((F.col(ms) >= floor) & (F.col(t) <= first))
    return early.groupBy(run).agg(F.count(F.lit(1)).alias("slow"), F.max(ms).alias("worst"), F.round(F.sum(F.col(ms) - floor), 6).alias("lost_ms"))
