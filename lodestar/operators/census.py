"""Censuses over facts and files: layers, registrations, guards, references, histograms of two arms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import ranked_values


def layered_winners(shipped: DataFrame, ranks: DataFrame, layers: list[DataFrame]) -> DataFrame:
    """rel, mod, losers, layer: which copy of each file is live.

    Of the mods (rel, mod) that ship a path, in any case of letters, the one of least rank (mod,
    rank) wins; mods without a rank don't count. Paths that no mod ships come from the first of the
    layers (rel, mod) that has them.
    """
    key = F.lower("rel").alias("key")
    ranked = shipped.join(ranks, "mod").select(key, "rel", "mod", "rank")
    best = ranked.groupBy("key").agg(F.min_by(F.struct("rel", "mod"), F.struct("rank", "mod")).alias("w"), (F.count_distinct("mod") - 1).alias("losers"))
    out = best.select("key", "w.rel", "w.mod", "losers", F.lit(0).alias("layer"))
    for i, layer in enumerate(layers, 1):
        own = layer.groupBy(key).agg(F.min(F.struct("rel", "mod")).alias("w")).join(out.select("key"), "key", "left_anti")
        out = out.unionByName(own.select("key", "w.rel", "w.mod", F.lit(0).cast("long").alias("losers"), F.lit(i).alias("layer")))
    return out.drop("key")


def unshipped(files: DataFrame, shipped: DataFrame) -> DataFrame:
    """Files (rel, ...) that no mod ships."""
    return files.withColumn("__key", F.lower("rel")).join(shipped.select(F.lower("rel").alias("__key")).distinct(), "__key", "left_anti").drop("__key")


def registrations(events: DataFrame) -> DataFrame:
    """name, registered, unregistered, sent, permanent, churn, callers of rows (file, name, kind, function).

    A registration is permanent if it is made at a script's start and the same file never takes it
    back; the others are churn.
    """
    taken_back = events.filter("kind = 'unregister'").select("file", "name").distinct().withColumn("back", F.lit(True))
    met = events.join(taken_back, ["file", "name"], "left")
    is_kind = lambda k: F.col("kind") == k
    lasting = is_kind("register") & F.col("function").isin("on_game_start", "<toplevel>") & F.col("back").isNull()
    return met.groupBy("name").agg(
        F.count_if(is_kind("register")).alias("registered"), F.count_if(is_kind("unregister")).alias("unregistered"), F.count_if(is_kind("send")).alias("sent"),
        F.count_if(lasting).alias("permanent"), F.count_if(is_kind("register") & ~lasting).alias("churn"), F.count_distinct(F.when(is_kind("register"), F.col("function"))).alias("callers"),
    )


def guard_kind(guards: Column, hints: list[str]) -> Column:
    """unguarded without guards, flag-guard if one holds a hint, else conditional."""
    hinted = F.exists(guards, lambda g: F.greatest(*[F.instr(F.lower(g), h) for h in [*hints, hints[0]]]) > 0)
    return F.when(F.coalesce(F.size(guards), F.lit(0)) <= 0, "unguarded").when(hinted, "flag-guard").otherwise("conditional")


def impure(calls: Column, pure: list[str]) -> Column:
    """The calls among arguments that are neither on the list by full name nor by the last part of it."""
    known = F.array(*map(F.lit, pure))
    return F.filter(calls, lambda c: ~F.array_contains(known, c) & ~F.array_contains(known, F.element_at(F.split(c, r"\."), -1)))


def reference_kind(line: Column, name: str) -> Column:
    """How a line uses a name first: called, bound (after = , ( or [) or other; null without it."""
    at = F.instr(line, name)
    tail = F.ltrim(F.substr(line, at + F.lit(len(name)), F.length(line)))
    head = F.rtrim(F.substr(line, F.lit(1), at - 1))
    bound = F.substr(head, F.greatest(F.length(head), F.lit(1)), F.lit(1)).isin("=", ",", "(", "[")
    return F.when(at > 0, F.when(tail.startswith("("), "called").when(bound & (F.length(head) > 0), "bound").otherwise("other"))


def reference_uses(lines: DataFrame, line: str, name: str) -> DataFrame:
    """The rows with `kind`, once for each use of a whole name in their line: called, bound (after = , ( or [) or other."""
    quoted = "\\Q" + name + "\\E"
    hit = F.regexp_extract_all(line, F.lit(rf"([=,(\[])?\s*(?<![\w.:]){quoted}(?!\w)\s*(\()?"), F.lit(0))
    each = lines.select("*", F.explode(hit).alias("__use"))
    kind = F.when(F.col("__use").endswith("("), "called").when(F.substring("__use", 1, 1).isin("=", ",", "(", "["), "bound").otherwise("other")
    return each.withColumn("kind", kind).drop("__use")


def two_arms(calls: DataFrame, name: str, arm: str, frames: dict[str, int]) -> DataFrame:
    """name and its calls a frame in either arm (0 where it has none), of names that differ."""
    (a, n_a), (b, n_b) = frames.items()
    by = calls.groupBy(name).agg((F.count_if(F.col(arm) == a) / n_a).alias("base"), (F.count_if(F.col(arm) == b) / n_b).alias("patched"))
    return by.filter(F.abs(F.col("base") - F.col("patched")) >= 1e-9)


def _rounded(x: Column, digits: int) -> Column:
    """Half to even of the scaled double, as DuckDB's round_even does (`bround` goes by the decimal digits that are shown)."""
    scale = F.lit(10.0**digits)
    scaled = F.rint(x * scale) / scale
    return F.when(F.abs(scaled) < float("inf"), scaled).otherwise(x)


def _between(lo: Column, hi: Column, d: Column) -> Column:
    """lo * (1 - d) + hi * d with the first product unrounded (a fused multiply-add), so that ties round as with quantile_cont."""

    def halves(x: Column) -> tuple[Column, Column]:
        big = x * 134217729.0
        top = big - (big - x)
        return top, x - top

    e = 1 - d
    (a, b), (c, f) = halves(lo), halves(e)
    first, second = lo * e, hi * d
    lost = ((a * c - first) + a * f + b * c) + b * f  # of the product
    total = first + second
    part = total - first
    lost = lost + ((first - (total - part)) + (second - part))  # and of the sum
    return F.when((d == 0) | (lo == hi), lo).when(F.abs(lost) < float("inf"), total + lost).otherwise(total)


def metric_document(samples: DataFrame, run: str, still: bool = False) -> DataFrame:
    """A run's document of samples (t_s, frametime_ms, fps, cpu_pct, rss_mb): null, 0, NaN and infinity are no measurement.

    With `still` a rate of 0 is one: its frame takes for ever. Without frame times they come from the
    rates. fps_avg is the rate of the mean frame time. Values are rounded half to even.
    `crashed` and `load_time_s` of a run come from its log: join `engine_log.summaries` by run.
    """
    measured = lambda c: F.when((F.col(c) != 0) & (F.abs(F.col(c)) < float("inf")), F.col(c))
    ft, fps = measured("frametime_ms"), measured("fps")
    frame = F.when(F.col("__fps") > 0, 1000 / F.col("__fps"))
    if still:
        fps, frame = F.coalesce(fps, F.when(F.col("fps") == 0, 0.0)), frame.when(F.col("__fps") == 0, float("inf"))
    own = samples.withColumn("__ft", ft).withColumn("__fps", fps)
    timed = own.groupBy(run).agg((F.count("__ft") > 0).alias("__timed"))
    rows = own.join(timed, run).withColumn("__ft", F.when(F.col("__timed"), F.col("__ft")).otherwise(frame))
    base = rows.groupBy(run).agg(
        F.count(F.lit(1)).alias("samples"), F.count("__ft").alias("frames"), _rounded(1000 / F.avg("__ft"), 3).alias("fps_avg"), _rounded(F.max("t_s") - F.min("t_s"), 3).alias("duration_s"),
        _rounded(F.avg("cpu_pct"), 2).alias("cpu_avg"), _rounded(F.max("cpu_pct"), 2).alias("cpu_peak"), _rounded(F.max("rss_mb"), 3).alias("ram_peak_mb"), _rounded(F.min("__fps"), 3).alias("fps_min"), _rounded(F.max("__fps"), 3).alias("fps_max"),
    )
    k = lambda p: (F.col("frames") - 1) * F.lit(p)
    at = {"median_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99}
    wanted = base.filter("frames > 0").select(run, F.explode(F.array_distinct(F.array(*[f(k(p)) for p in at.values() for f in (F.floor, F.ceil)]))).alias("__rank"))
    values = ranked_values(rows, [run], "__ft", wanted).groupBy(run).agg(F.map_from_entries(F.collect_list(F.struct("__rank", "__value"))).alias("__bag"))
    at_rank = lambda p: _between(F.col("__bag")[F.floor(k(p))], F.col("__bag")[F.ceil(k(p))], k(p) - F.floor(k(p)))
    return base.join(values, run, "left").withColumns({n: _rounded(at_rank(p), 3) for n, p in at.items()}).drop("__bag")


def guarded_between(accesses: DataFrame, lines: DataFrame) -> DataFrame:
    """Accesses (path, name, assign_line, access_line) without a line (path, line, text) between that tests the name.

    A test is a line `if name`, `if not name` or `name ==`/`~=`; the join is by script, and only lines in between count.
    """
    tests = lines.filter(F.col("text").contains("if ") | F.col("text").contains("==") | F.col("text").contains("~="))
    named = F.regexp_extract_all("text", F.lit(r"\bif\s+(?:not\s+)?([A-Za-z_]\w*)|([A-Za-z_]\w*)\s*[=~]="), F.lit(0))
    tested = tests.select("path", "line", F.explode(named).alias("hit")).select("path", "line", F.regexp_replace("hit", r"^if\s+(not\s+)?|\s*[=~]=$", "").alias("name"))
    near = accesses.join(tested, ["path", "name"]).filter((F.col("line") > F.col("assign_line")) & (F.col("line") <= F.col("access_line"))).select(*accesses.columns).distinct()
    return accesses.join(near, accesses.columns, "left_anti")


def later_uses(rows: DataFrame, key: list[str], order: str, mark: Column) -> DataFrame:
    """Each marked row with the next row of its key, or null."""
    after = Window.partitionBy(*key).orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    return rows.withColumn("next_use", F.min(order).over(after)).filter(mark)
