"""The catalogue of runs: documents to rows, health, baselines, comparisons, gates, queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RESULTS = (
    "analyze_s double, fix_s double, files_modified long, edits_applied long, findings_by_pattern map<string,long>, findings_by_severity map<string,long>, "
    "parse_failures array<variant>, timeouts array<variant>, crashes array<variant>, compile_failures_after_fix array<variant>, idempotence_violations array<variant>, differential_failures array<variant>"
)
MANIFEST = "run_id string, commit string, corpus string, started string, status string, notes string, flags array<string>"
FAILURES = ("compile_failures_after_fix", "idempotence_violations", "crashes", "differential_failures")
WARNINGS = ("parse_failures", "timeouts")


def bag_total(bag: Column) -> Column:
    """The sum of a map's values, 0 for none."""
    return F.aggregate(F.coalesce(F.map_values(bag), F.array().cast("array<long>")), F.lit(0).cast("long"), lambda s, x: s + F.coalesce(x, F.lit(0)))


def health(results: Column) -> Column:
    """unknown without results, fail with failures after a fix, warn with texts that could not be read, else ok."""
    some = lambda names: F.lit(False) if not names else F.greatest(*[F.coalesce(F.size(results[n]), F.lit(0)) for n in names]) > 0
    return F.when(results.isNull(), "unknown").when(some(FAILURES), "fail").when(some(WARNINGS), "warn").otherwise("ok")


def run_rows(manifests: DataFrame, results: DataFrame) -> DataFrame:
    """One flat row a run: manifests (run_id, document) with their results (run_id, document), both JSON texts.

    A run without results, or with results that can't be read, is still a row (health unknown).
    """
    # A text that isn't a whole document has nothing readable, not half of it.
    whole = F.when(F.try_parse_json("document").isNotNull(), F.col("document"))
    m = manifests.select("run_id", F.from_json(whole, MANIFEST).alias("m"))
    r = results.select("run_id", F.from_json(whole, RESULTS).alias("r"))
    both = m.join(r, "run_id", "left")
    sizes = [F.coalesce(F.size(f"r.{n}"), F.lit(0)).alias(n) for n in (*WARNINGS, *FAILURES)]
    sizes = [F.greatest(s, F.lit(0)).alias(n) for s, n in zip(sizes, (*WARNINGS, *FAILURES), strict=True)]
    return both.select(
        "run_id", "m.corpus", "m.started", "m.status", F.coalesce("m.notes", F.lit("")).alias("notes"), F.substring("m.commit", 1, 8).alias("commit_short"), "r.analyze_s", "r.fix_s", "r.files_modified",
        "r.edits_applied", bag_total(F.col("r.findings_by_pattern")).alias("findings"), F.coalesce(F.size(F.map_keys("r.findings_by_pattern")), F.lit(0)).alias("patterns"), *sizes,
        health(F.col("r")).alias("health"), F.col("r").isNotNull().alias("has_results"), (bag_total(F.col("r.findings_by_pattern")) == bag_total(F.col("r.findings_by_severity"))).alias("sums_agree"),
    )


def overall_gate(rows: DataFrame) -> DataFrame:
    """runs, clean, failed, unknown, passed: over rows of `run_rows`: passed if every run has results and none failed; null without runs."""
    n = lambda h: F.count_if(F.col("health").isin(*h))
    out = rows.agg(F.count(F.lit(1)).alias("runs"), n(["ok", "warn"]).alias("clean"), n(["fail"]).alias("failed"), n(["unknown"]).alias("unknown"))
    return out.withColumn("passed", F.when(F.col("runs") > 0, (F.col("failed") == 0) & (F.col("unknown") == 0)))


def latest_and_trend(runs: DataFrame, group: str, order: list[str], value: str, last: int = 5) -> DataFrame:
    """group, latest, before, change, trend: the newest value, the one before it, their difference, and the last values from old to new (`last` at most; nulls are no values)."""
    newest = Window.partitionBy(group).orderBy(*[F.col(c).desc() for c in order])
    few = runs.filter(F.col(value).isNotNull()).withColumn("__place", F.row_number().over(newest)).filter(F.col("__place") <= last)
    by = few.groupBy(group).agg(F.max(F.when(F.col("__place") == 1, F.col(value))).alias("latest"), F.max(F.when(F.col("__place") == 2, F.col(value))).alias("before"), F.transform(F.array_sort(F.collect_list(F.struct((-F.col("__place")).alias("p"), F.col(value).alias("v")))), lambda x: x["v"]).alias("trend"))
    return by.select(group, "latest", "before", (F.col("latest") - F.col("before")).alias("change"), "trend")


def failure_kinds(rows: DataFrame) -> DataFrame:
    """run_id, kinds: which kinds of failure and warning a run has, in order of name."""
    names = sorted((*FAILURES, *WARNINGS))
    return rows.select("run_id", F.filter(F.array(*[F.when(F.col(n) > 0, n) for n in names]), lambda x: x.isNotNull()).alias("kinds"))


def failure_files(items: Column) -> Column:
    """File names of a list whose entries are texts or objects with a `file`; other entries are left out."""
    one = lambda v: F.coalesce(F.try_variant_get(v, "$.file", "string"), F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")))
    return F.filter(F.transform(items, one), lambda x: x.isNotNull())


def started_key(started: Column, run_id: Column) -> Column:
    """When a run began: as noted, else read off a run id of the form YYYYMMDD-HHMMSS-name, else empty."""
    shape = r"^(\d{4})(\d{2})(\d{2})-(\d{2})(\d{2})(\d{2}).*$"
    return F.coalesce(F.nullif(started, F.lit("")), F.when(run_id.rlike(shape), F.regexp_replace(run_id, shape, "$1-$2-$3T$4:$5:$6")), F.lit(""))


def is_baseline(notes: Column, idea: Column) -> Column:
    """Notes with "variant" never mark a baseline; those that begin with it, or say so, do; else a run without an idea is one."""
    n = F.lower(F.trim(F.coalesce(notes, F.lit(""))))
    marked = n.startswith("baseline") | n.startswith("[baseline]") | n.contains("baseline=true")
    return F.when(n.contains("variant"), F.lit(False)).when(marked, F.lit(True)).otherwise(F.coalesce(idea, F.lit("")).isin("", "baseline"))


def best_against_baseline(runs: DataFrame) -> DataFrame:
    """idea, variant, base, delta, pct: each idea's best run (run_id, idea, fps, started, notes, crashed) against a baseline.

    That is the idea's own first baseline, else the newest of all; none compares with itself. Of
    equal runs the one with the smallest id counts. A row an idea, and one row for the newest baseline.
    """
    scored = runs.filter(F.col("fps").isNotNull() & ~F.coalesce("crashed", F.lit(False)))
    best = scored.filter(F.coalesce("idea", F.lit("")) != "").groupBy("idea").agg(F.min_by(F.struct("run_id", "fps"), F.struct(-F.col("fps"), F.col("run_id"))).alias("v"))
    bases = scored.filter(is_baseline(F.col("notes"), F.col("idea")))
    own = bases.groupBy("idea").agg(F.min_by(F.struct("run_id", "fps"), "run_id").alias("own"))
    newest = bases.agg(F.max_by(F.struct("run_id", "fps"), F.struct(F.coalesce("started", F.lit("")), "run_id")).alias("newest"))  # one row
    met = best.join(own, "idea", "left").join(F.broadcast(newest)).withColumn("b", F.coalesce("own", "newest")).filter("b IS NOT NULL AND b.run_id != v.run_id")
    delta = F.col("v.fps") - F.col("b.fps")
    return met.select("idea", F.col("v.run_id").alias("variant"), F.col("b.run_id").alias("base"), F.bround(delta, 3).alias("delta"), F.when(F.col("b.fps") != 0, F.bround(100 * delta / F.col("b.fps"), 2)).alias("pct"))


def arm_means(runs: DataFrame, arm: str, values: list[str], capped: str) -> DataFrame:
    """Means an arm without its capped runs, unless all are capped; n counts those, n_all every run."""
    free = ~F.coalesce(F.col(capped), F.lit(False))
    mean = lambda v: F.bround(F.coalesce(F.avg(F.when(free, F.col(v))), F.when(F.count_if(free) == 0, F.avg(v))), 2)
    n = F.count_if(free)
    return runs.groupBy(arm).agg(F.when(n > 0, n).otherwise(F.count(F.lit(1))).alias("n"), F.count(F.lit(1)).alias("n_all"), *[mean(v).alias(v) for v in values], F.count_if(~free).alias("capped"))


def arms_compared(means: DataFrame, arm: str, values: list[str], base: str) -> DataFrame:
    """arm, and of each value delta and pct against the arm `base` (pct null where that is 0); the base itself is left out, without it there are no rows."""
    b = F.broadcast(means.filter(F.col(arm) == base).select(*[F.col(v).alias(f"__{v}") for v in values]).limit(1))  # one row
    delta = lambda v: F.col(v) - F.col(f"__{v}")
    shown = [x for v in values for x in (F.bround(delta(v), 3).alias(f"{v}_delta"), F.when(F.col(f"__{v}") != 0, F.bround(100 * delta(v) / F.col(f"__{v}"), 2)).alias(f"{v}_pct"))]
    return means.filter(F.col(arm) != base).join(b).select(arm, *shown)


def speedups(timings: DataFrame, keys: list[str], arm: str, seconds: str) -> DataFrame:
    """Best and median times of the arms `original` and `rewrite`, their ratios, and the jitter (the worse median over its best)."""
    by = lambda f, a: f(F.when(F.col(arm) == a, F.col(seconds)))
    t = timings.groupBy(*keys).agg(*[by(f, a).alias(f"{n}_{a}") for n, f in (("best", F.min), ("median", F.median)) for a in ("original", "rewrite")])
    ratio = lambda a, b: F.when(F.col(b) != 0, F.col(a) / F.col(b))
    jitter = F.greatest(*[F.coalesce(ratio(f"median_{a}", f"best_{a}"), F.lit(1.0)) for a in ("original", "rewrite")])
    return t.withColumn("speedup", ratio("best_original", "best_rewrite")).withColumn("speedup_median", ratio("median_original", "median_rewrite")).withColumn("jitter", jitter)


def gate(points: DataFrame, keys: list[str], mode: str, modes: list[str], least: float, floor: float) -> DataFrame:
    """Whether every mode's `speedup` reaches `least` and `floor`; null where a mode is missing."""
    seen = F.count_distinct(F.when(F.col(mode).isin(*modes) & F.col("speedup").isNotNull(), F.col(mode)))
    return points.groupBy(*keys).agg(F.when(seen == len(modes), F.bool_and((F.col("speedup") >= least) & (F.col("speedup") >= floor))).alias("passed"))


def bucket_verdicts(buckets: DataFrame, points: DataFrame, key: str) -> DataFrame:
    """Buckets (key, lo, hi, sites, and what else they have) with the verdict of the measured points (key, k, ok) inside them; buckets without a point are left out."""
    met = buckets.join(points, key).filter(F.col("k").between(F.col("lo"), F.col("hi")))
    verdict = F.when(F.bool_and("ok"), "pass").when(~F.bool_or("ok"), "fail").otherwise("mixed")
    return met.groupBy(*buckets.columns).agg(verdict.alias("verdict"), F.count(F.lit(1)).alias("points"))


def weighted_verdict(verdicts: DataFrame, key: str) -> DataFrame:
    """Sites a key that pass, fail, or lie in mixed buckets; with a column `estimated` also how many of them are only estimated."""
    if "estimated" in verdicts.columns:
        guessed = verdicts.groupBy(key).agg(F.coalesce(F.sum(F.when(F.col("estimated"), F.col("sites"))), F.lit(0)).alias("estimated_sites"))
        return weighted_verdict(verdicts.drop("estimated"), key).join(guessed, key)
    return verdicts.groupBy(key).agg(*[F.coalesce(F.sum(F.when(F.col("verdict") == v, F.col("sites"))), F.lit(0)).alias(f"{v}_sites") for v in ("pass", "fail", "mixed")], F.sum("sites").alias("sites"))


def buckets_of(spec: Column) -> Column:
    """`3-10?:15 68:3` as an array of (lo, hi, sites, estimated); entries of another form, or with a range upside down, are null."""
    shape = r"^(\d+)(?:-(\d+))?(\?)?(?::(\d+))?$"

    def one(x: Column) -> Column:
        part = lambda i: F.nullif(F.regexp_extract(x, shape, i), F.lit(""))
        lo, hi = part(1).cast("int"), F.coalesce(part(2), part(1)).cast("int")
        made = F.struct(lo.alias("lo"), hi.alias("hi"), part(4).cast("int").alias("sites"), part(3).isNotNull().alias("estimated"))
        return F.when(x.rlike(shape) & (lo >= 1) & (hi >= lo), made)

    return F.transform(F.filter(F.split(spec, r"[\s,]+"), lambda x: x != ""), one)


def merged(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of `old` with the values of `new` where it has some (null: keep), and its new keys."""
    values = [c for c in old.columns if c != key]
    return old.alias("o").join(new.alias("n"), key, "full").select(key, *[F.coalesce(f"n.{c}", f"o.{c}").alias(c) if c in new.columns else F.col(f"o.{c}").alias(c) for c in values])


def recent(rows: DataFrame, key: str, order: list[Column], keep: int) -> DataFrame:
    """The last `keep` rows a key, newest first in `place`."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("place") <= keep)


def toggled(entries: DataFrame, wanted: DataFrame, name: str) -> DataFrame:
    """The changes that switches (name, want) make to entries (name, enabled): old and new state, `missing` for unknown names."""
    state = lambda c: F.when(F.col(c), "enabled").otherwise("disabled")
    both = wanted.join(entries, name, "left")
    out = both.select(name, F.when(F.col("enabled").isNotNull(), state("enabled")).alias("old"), F.when(F.col("enabled").isNull(), "missing").otherwise(state("want")).alias("new"))
    return out.filter(~F.col("old").eqNullSafe(F.col("new")))
