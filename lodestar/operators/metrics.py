"""Frame metrics: exact percentiles, harmonic means, slowest shares, spreads, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import micros
from ..scratch import stored
from .ranks import numbered, ranked_values

MICROS = 1_000_000.0


def frame_metrics(samples: DataFrame, run: str, frametime: str) -> DataFrame:
    """A metrics document a run: count, harmonic fps, median, p95, p99, 1 % low, extremes.

    Frame times that are null, NaN, infinite, or 0 or less are no samples; a run without samples, and
    a null run, has no row. Percentiles are exact, between the two ranks around them; they come from
    ranked values, so no task sorts or holds a whole run.
    """
    ft = F.col(frametime).cast("double")
    valid = samples.select(F.col(run).alias("__run"), ft.alias("__ft")).filter((F.col("__ft") > 0) & (F.col("__ft") < float("inf")))
    base = stored(valid.groupBy("__run").agg(F.count(F.lit(1)).alias("__frames"), F.avg("__ft").alias("__mean"), F.min("__ft").alias("__min"), F.max("__ft").alias("__max")))
    at = {"median_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99}
    k = lambda p: (F.col("__frames") - 1) * F.lit(p)
    slow = F.greatest(F.lit(1), F.floor(F.col("__frames") * 0.01))
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(k(p)), F.ceil(k(p))) for p in at.values()], F.array(F.col("__frames") - slow))))
    values = ranked_values(valid, ["__run"], "__ft", base.select("__run", F.explode(ranks).alias("__rank")))
    bag = values.groupBy("__run").agg(F.map_from_entries(F.collect_list(F.struct("__rank", "__value"))).alias("__bag"))  # seven entries at most
    known = base.join(bag, "__run").withColumn("__floor", F.col("__bag")[F.col("__frames") - slow])
    over = valid.join(known.select("__run", "__floor"), "__run").filter("__ft > __floor").groupBy("__run").agg(F.count(F.lit(1)).alias("__above"), F.sum(1000 / F.col("__ft")).alias("__fps"))
    both = known.join(over, "__run", "left")
    between = lambda p: F.col("__bag")[F.floor(k(p))] + (k(p) - F.floor(k(p))) * (F.col("__bag")[F.ceil(k(p))] - F.col("__bag")[F.floor(k(p))])
    low = (F.coalesce("__fps", F.lit(0.0)) + (slow - F.coalesce("__above", F.lit(0))) * 1000 / F.col("__floor")) / slow
    shown = [F.col("__run").alias(run), F.col("__frames").alias("frames"), F.round(1000 / F.col("__mean"), 6).alias("fps_avg")]
    return both.select(*shown, *[F.round(between(p), 6).alias(n) for n, p in at.items()], F.round(low, 6).alias("fps_1pct_low"), F.col("__min").alias("min_ms"), F.col("__max").alias("max_ms"))


def anchored_windows(samples: DataFrame, run: str, ts: str, frametime: str, width_s: float) -> DataFrame:
    """Harmonic mean fps of tumbling windows that begin at a run's first sample; empty windows make no row."""
    t = micros(ts)
    valid = samples.filter(F.col(frametime) > 0)
    first = valid.groupBy(run).agg(F.min(t).alias("__first"))
    at = valid.join(first, run).withColumn("window", F.floor((t - F.col("__first")) / F.lit(int(width_s * MICROS))).cast("long"))
    return at.groupBy(run, "window").agg(F.count(F.lit(1)).alias("frames"), F.round(1000 / F.avg(frametime), 6).alias("fps"))


def cap_detection(windows: DataFrame, run: str, caps: list[float], tolerance: float) -> DataFrame:
    """Whether the windows of a run sit at a known frame cap: three or more, of a range within 2 * tolerance, around a cap."""
    stats = windows.groupBy(run).agg(F.count(F.lit(1)).alias("windows"), F.min("fps").alias("lo"), F.max("fps").alias("hi"))
    middle = (F.col("lo") + F.col("hi")) / 2
    near = F.array_min(F.filter(F.array(*[F.lit(float(c)) for c in caps]), lambda c: F.abs(c - middle) <= tolerance))
    steady = (F.col("windows") >= 3) & (F.col("hi") - F.col("lo") <= 2 * tolerance)
    return stats.select(run, "windows", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), F.coalesce(steady & near.isNotNull(), F.lit(False)).alias("capped"), F.when(steady, near).alias("cap_fps"))


def downsample(rows: DataFrame, run: str, order: str, value: str, limit: int) -> DataFrame:
    """At most `limit` rows a run: of each bucket of neighbouring rows the one with the largest value (the first of equals)."""
    counts = rows.groupBy(run).agg(F.count(F.lit(1)).alias("__n"))
    placed = numbered(rows, run, [order], "__i").join(counts, run)
    bucket = F.floor(((F.col("__i") + 1) * limit - 1) / F.col("__n"))
    dealt = placed.withColumn("bucket", F.when(F.col("__n") <= limit, F.col("__i")).otherwise(bucket).cast("long"))
    best = dealt.groupBy(run, "bucket").agg(F.max_by(F.struct(order, value), F.struct(F.col(value), -F.col("__i"))).alias("best"))
    return best.select(run, "bucket", F.col(f"best.{order}").alias(order), F.col(f"best.{value}").alias(value))


def spread(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, mean, sample deviation (0 for one row), coefficient of variation and range in percent of the mean (null for a mean of 0)."""
    mean = F.avg(value)
    over = F.when(mean != 0, mean)
    deviation = F.coalesce(F.stddev_samp(value), F.lit(0.0))
    return rows.groupBy(*by).agg(
        F.count(value).alias("n"), F.round(mean, 6).alias("mean"), F.round(deviation, 6).alias("stdev"), F.round(deviation / over * 100, 6).alias("cv_pct"),
        F.min(value).alias("min"), F.max(value).alias("max"), F.round((F.max(value) - F.min(value)) / over * 100, 6).alias("range_pct"),
    )


def ranking(rows: DataFrame, name: str, cost: str, top: int | None = None, axis: str | None = None) -> DataFrame:
    """Cost a name with its share of the total (of its axis, as axes overlap), dearest first."""
    by = [axis] if axis else []
    sums = rows.groupBy(*by, name).agg(F.sum(cost).alias("__cost"), F.count(F.lit(1)).alias("calls"))
    cost_of, share = F.round("__cost", 2).alias("cost"), lambda total: F.round(F.col("__cost") / total * 100, 6).alias("share_pct")
    if not axis:
        total = F.broadcast(sums.agg(F.sum("__cost").alias("__total")))  # one row
        out = sums.join(total).select(name, "calls", cost_of, share(F.col("__total")))
        return out if top is None else out.orderBy(F.col("cost").desc(), name).limit(top)
    each = Window.partitionBy(axis)  # a row a name
    place = F.row_number().over(each.orderBy(F.round("__cost", 2).desc(), name))
    out = sums.select(axis, name, "calls", cost_of, share(F.sum("__cost").over(each)), place.alias("place"))
    return out if top is None else out.filter(F.col("place") <= top)


def log2_bucket(value: Column, floor: float, buckets: int) -> Column:
    """0 below the floor; bucket i from floor * 2**(i-1) on; the last one open."""
    out = F.lit(0)
    for i in range(1, buckets):
        out = out + (value >= floor * 2 ** (i - 1)).cast("int")
    return out


def percentile_bracket(rows: DataFrame, by: str, value: str, floor: float, buckets: int, p: float) -> DataFrame:
    """The log2 bucket in which a percentile lies, found from the top of the histogram down."""
    histogram = rows.withColumn("bucket", log2_bucket(F.col(value), floor, buckets)).groupBy(by, "bucket").agg(F.count(F.lit(1)).alias("n"))
    down = Window.partitionBy(by).orderBy(F.col("bucket").desc())
    total = F.sum("n").over(Window.partitionBy(by))
    reached = histogram.withColumn("above", F.sum("n").over(down)).withColumn("want", F.greatest(F.lit(1.0), total * (1 - p))).withColumn("total", total)
    hit = reached.filter("above >= want").groupBy(by).agg(F.max("bucket").alias("bucket"), F.max("total").alias("total"))
    low = F.when(F.col("bucket") == 0, 0.0).otherwise(F.lit(floor) * F.pow(F.lit(2.0), F.col("bucket") - 1))
    high = F.when(F.col("bucket") < buckets - 1, F.lit(floor) * F.pow(F.lit(2.0), F.col("bucket").cast("double")))
    return hit.select(by, "total", "bucket", low.alias("p_lo"), high.alias("p_hi"))
