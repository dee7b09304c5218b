"""Frame captures (CSV whose headers drift) and tagged profiler lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import kv_bag, number, rates

# Names of columns in the order they are tried.
FRAME_COLUMNS = ["msbetweenpresents", "frametime", "mspresenttime", "msinpresentapi"]
SECOND_COLUMNS = ["timeinseconds", "cpustarttime", "time"]
MS_COLUMNS = ["timeinms", "cpustarttimeinms"]


def samples(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """key, t_s, frametime_ms, fps of capture rows as read (texts), in the order of a capture.

    Times start at 0 with the first that is known; a row without one follows the row before it by its
    frame time. What isn't a number is null.
    """
    lower = {c.lower().strip(): c for c in rows.columns}
    pick = lambda names: next((lower[n] for n in names if n in lower), None)
    as_number = lambda c, scale=1.0: F.col(f"`{c}`").cast("string").try_cast("double") * scale if c else F.lit(None).cast("double")
    seconds = pick(SECOND_COLUMNS)
    t = as_number(seconds) if seconds else as_number(pick(MS_COLUMNS), 0.001)
    rows = rows.select(F.col(key), *order, t.alias("__t"), as_number(pick(FRAME_COLUMNS)).alias("frametime_ms"))
    by = Window.partitionBy(key).orderBy(*order)
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    known = F.col("__t").isNotNull()
    rows = rows.withColumn("__n", F.row_number().over(by)).withColumn("__run", F.count("__t").over(so_far)).withColumn("__from", F.first("__t", ignorenulls=True).over(so_far)).withColumn("__base", F.last("__t", ignorenulls=True).over(so_far))
    step = F.when(known | (F.col("__n") == 1), 0.0).otherwise(F.coalesce("frametime_ms", F.lit(0.0)) / 1000)
    in_run = Window.partitionBy(key, "__run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    t_s = F.coalesce(F.col("__base") - F.col("__from"), F.lit(0.0)) + F.sum(step).over(in_run)
    fps = F.when(F.col("frametime_ms") > 0, 1000 / F.col("frametime_ms"))
    return rows.select(key, *order, t_s.alias("t_s"), "frametime_ms", fps.alias("fps"))


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """path, t_s, frametime_ms, fps of capture files with one header."""
    rows = spark.read.option("header", True).csv(path)
    rows = rows.select("*", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__at"))
    return samples(rows, "path", ["__block", "__at"]).drop("__block", "__at")


def write_samples(rows: DataFrame, path: str) -> None:
    """CSV of t_s, frametime_ms, fps with 4, 3 and 2 decimals; null is blank."""
    fixed = lambda c, digits: F.format_string(f"%.{digits}f", c)
    some = lambda c, digits: F.when(F.col(c).isNotNull(), fixed(c, digits)).alias(c)
    rows.select(some("t_s", 4), some("frametime_ms", 3), some("fps", 2)).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def profile_records(lines: DataFrame, tag: str) -> DataFrame:
    """path, line_no, kind, rest, kv: lines (path, line_no, raw) with `tag|version|kind|k=v|k=v` anywhere in them."""
    pattern = rf"{tag}\|(\w+)\|(\w+)\|?(.*)$"
    rows = lines.filter(F.col("raw").rlike(pattern)).select("path", "line_no", F.regexp_extract("raw", pattern, 2).alias("kind"), F.regexp_extract("raw", pattern, 3).alias("rest"))
    # A generated column: what reads it or filters by it does not take the line apart again.
    return rows.select("*", F.explode(F.array(F.when(F.col("kind") != "err", kv_bag(F.col("rest"))))).alias("kv"))


def _num(name: str, default: float | None = None) -> Column:
    got = number(F.col("kv")[name])
    return got if default is None else F.coalesce(got, F.lit(default))


def profile_windows(records: DataFrame, least_frames: int = 0) -> DataFrame:
    """path, seq, t0, t1, span_ms, frames, total_units, calls, nested, names of the windows that are complete (an end was seen)."""
    rows = records.withColumn("seq", _num("seq")).filter("seq IS NOT NULL AND kind IN ('win', 'cb', 'lst', 'axs', 'eow')")
    window = F.struct(*[_num(c).alias(c) for c in ("t0", "t1", "span_ms")], _num("frames", 0).cast("long").alias("frames"), _num("total_units", 0).alias("total_units"), *[_num(c, 0).cast("long").alias(c) for c in ("calls", "nested", "names")])
    found = rows.groupBy("path", F.col("seq").cast("long").alias("seq")).agg(F.max_by(F.when(F.col("kind") == "win", window), F.when(F.col("kind") == "win", F.col("line_no"))).alias("w"), F.max(F.col("kind") == "eow").alias("complete"))
    return found.filter("complete").select("path", "seq", "w.*").filter(F.coalesce("frames", F.lit(0)) >= least_frames)


def profile_calls(records: DataFrame) -> DataFrame:
    """path, seq, kind (cb, lst, axs), axis, name, calls, units, nested: of equal names in a window the last line holds."""
    rows = records.filter(F.col("kind").isin("cb", "lst", "axs")).withColumn("seq", _num("seq")).filter("seq IS NOT NULL")
    axis = F.when(F.col("kind") == "axs", F.coalesce(F.col("kv")["axis"], F.lit("?")))
    value = F.struct(_num("calls", 0).cast("long").alias("calls"), _num("units", 0).alias("units"), _num("nested", 0).cast("long").alias("nested"))
    return rows.groupBy("path", F.col("seq").cast("long").alias("seq"), "kind", axis.alias("axis"), F.coalesce(F.col("kv")["name"], F.lit("?")).alias("name")).agg(F.max_by(value, "line_no").alias("v")).select("path", "seq", "kind", "axis", "name", "v.*")


def slow_frames(records: DataFrame) -> DataFrame:
    """path, n, frame, t, ms, dt_dev, u_top, u_cb, u_bnd, u_eng, u_evt, gc0, gc1, n_top, spawn, destroy, after_log, top (label, units): slow frames with their dearest labels."""
    parts = [*[_num(c, 0).alias(c) for c in ("u_top", "u_cb", "u_bnd", "u_eng", "u_evt", "gc0", "gc1")], *[_num(c, 0).cast("long").alias(c) for c in ("n_top", "spawn", "destroy", "after_log")]]
    return records.filter("kind = 'frm'").select("path", _num("n", 0).cast("long").alias("n"), _num("frame", 0).cast("long").alias("frame"), _num("t", 0).alias("t"), _num("ms", 0).alias("ms"), _num("dt_dev").alias("dt_dev"), *parts, _pairs("top").alias("top"))


def hitches(records: DataFrame) -> DataFrame:
    """path, scope, name, max_units, above, first_t, buckets of the last line of each name."""
    buckets = F.transform(F.filter(F.split(F.coalesce(F.col("kv")["b"], F.lit("")), ","), lambda x: x != ""), lambda x: x.try_cast("long"))
    value = F.struct(_num("max", 0).alias("max_units"), _num("above", 0).cast("long").alias("above"), _num("first_t", 0).alias("first_t"), F.when(F.forall(buckets, lambda x: x.isNotNull()), buckets).otherwise(F.array().cast("array<bigint>")).alias("buckets"))
    return records.filter("kind = 'hit'").filter(_num("seq").isNotNull()).groupBy("path", F.coalesce(F.col("kv")["scope"], F.lit("cb")).alias("scope"), F.coalesce(F.col("kv")["name"], F.lit("?")).alias("name")).agg(F.max_by(value, "line_no").alias("v")).select("path", "scope", "name", "v.*")


def burst_values(lines: DataFrame, raw: str, tag: str) -> DataFrame:
    """seq, n, worst: lines `tag|seq=...|v=a,b,...`: the number of values of a sequence in all its lines, and the largest.

    Other lines and those without a number of the sequence are left out; what isn't a number counts as a value but is no largest.
    """
    bag = lines.filter(F.col(raw).startswith(f"{tag}|")).select(kv_bag(F.col(raw)).alias("m"))
    values = bag.select(number(F.col("m")["seq"]).cast("long").alias("seq"), F.transform(F.split(F.coalesce(F.col("m")["v"], F.lit("")), ","), lambda x: x.try_cast("double")).alias("v")).filter("seq IS NOT NULL")
    return values.groupBy("seq").agg(F.sum(F.size("v")).cast("long").alias("n"), F.max(F.array_max("v")).alias("worst"))


def _text(name: str, default: str | None = None) -> Column:
    got = F.col("kv")[name]
    return got if default is None else F.coalesce(got, F.lit(default))


def _last(rows: DataFrame, value: Column) -> DataFrame:
    return rows.groupBy("path").agg(F.max_by(value, "line_no").alias("v")).select("path", "v.*")


def headers(records: DataFrame) -> DataFrame:
    """path and what the last header of a log says: timer, units_per_ms, overhead_ns, calib_ms, calib_units, make_callback, binders, listeners, hitch, hitch_floor_ms, hitch_buckets, dump_ms, ts."""
    numbers = [_num(c).alias(c) for c in ("units_per_ms", "overhead_ns", "calib_ms", "calib_units", "hitch_floor_ms", "dump_ms", "ts")]
    value = F.struct(
        _text("timer", "").alias("timer"), *numbers, F.coalesce(_text("make_callback") == "true", F.lit(False)).alias("make_callback"), *[_text(c, "off").alias(c) for c in ("binders", "listeners", "hitch")], _num("hitch_buckets").cast("int").alias("hitch_buckets")
    )
    return _last(records.filter("kind = 'hdr'"), value)


def walkout_headers(records: DataFrame) -> DataFrame:
    """path and what the last second header says (off and null without one), and probes: how many targets were tried and how many of them were wrapped."""
    value = F.struct(
        _text("walkout", "off").alias("walkout"), F.coalesce(_text("binder_update") == "true", F.lit(False)).alias("binder_update"), _text("frames", "off").alias("frames"),
        *[_num(c).alias(c) for c in ("frame_floor_ms", "frame_max", "rescan_every", "ver", "ts")], _num("pending", 0).cast("long").alias("pending"), _text("selfcheck", "").alias("selfcheck"), _text("misses", "").alias("misses"))
    probes = probe_rows(records).groupBy("path").agg(F.count(F.lit(1)).alias("probes"), F.count_if(F.col("wrapped") > 0).alias("wrapped"))
    heads = _last(records.filter("kind = 'wdr'"), value)
    both = heads.join(probes, "path", "full")
    return both.withColumn("walkout", F.coalesce("walkout", F.lit("off"))).fillna(0, ["probes", "wrapped"])


def probe_rows(records: DataFrame) -> DataFrame:
    """path, line_no, target, wrapped, mod, cls, via, why: what came of each target that was to be wrapped."""
    return records.filter("kind = 'bnx'").select("path", "line_no", _text("target", "?").alias("target"), _num("wrapped", 0).cast("long").alias("wrapped"), *[_text(c, "").alias(c) for c in ("mod", "cls", "via", "why")])


def _pairs(name: str) -> Column:
    """label~number pairs; parts without a number at their end are left out."""
    parts = F.filter(F.split(_text(name, ""), ","), lambda p: F.regexp_extract(p, r"~([^~]*)$", 1).try_cast("double").isNotNull())
    return F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"^(.*)~[^~]*$", 1).alias("label"), F.regexp_extract(p, r"~([^~]*)$", 1).cast("double").alias("units")))


def nested_calls(records: DataFrame) -> DataFrame:
    """path, n, frame, t, axis, scope, units, top, inside (label, units): slow calls with what they were made of."""
    return records.filter("kind = 'nst'").select(
        "path", *[_num(c, 0).cast("long").alias(c) for c in ("n", "frame")], _num("t", 0).alias("t"), _text("axis", "").alias("axis"), _text("scope", "?").alias("scope"), _num("units", 0).alias("units"), (_text("top", "1") == "1").alias("top"), _pairs("in").alias("inside"))


def trace_calls(records: DataFrame) -> DataFrame:
    """path, n, name, units, frame, t, pre, post: single calls of a named listener; pre and post are maps of `k=v,k=v` before and after it."""
    return records.filter("kind = 'trace'").select(
        "path", _num("n", 0).cast("long").alias("n"), _text("name", "?").alias("name"), _num("units", 0).alias("units"), _num("frame", 0).cast("long").alias("frame"), _num("t", 0).alias("t"), *[kv_bag(_text(c, ""), ",").alias(c) for c in ("pre", "post")])


def profile_errors(records: DataFrame) -> DataFrame:
    """path, line_no, message: what the instrument itself complained of."""
    return records.filter("kind = 'err'").select("path", "line_no", F.btrim("rest").alias("message"))


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """path, at, t_s, frametime_ms, fps, cpu_pct, rss_mb of sample files as `write_samples` and others write them.

    Blank and what isn't a number is null, a missing column too; of frame time and rate the one gives
    the other; without a time the row's place stands for it.
    """
    rows = spark.read.option("header", True).csv(path).select("*", F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("at"))
    return tolerant_samples(rows, ["path", "at"])


def tolerant_samples(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The columns of `read_samples` of rows as read (texts), after the keys; the last key is the row's place."""
    lower = {c.lower().strip(): c for c in rows.columns}
    get = lambda name: F.col(f"`{lower[name]}`").cast("string").try_cast("double") if name in lower else F.lit(None).cast("double")
    ft, fps = rates(get("frametime_ms"), get("fps"))
    place = F.row_number().over(Window.partitionBy(*keys[:-1]).orderBy(keys[-1])) - 1 if "t_s" not in lower else F.lit(None)
    return rows.select(*keys, F.coalesce(get("t_s"), place.cast("double")).alias("t_s"), ft.alias("frametime_ms"), fps.alias("fps"), get("cpu_pct").alias("cpu_pct"), get("rss_mb").alias("rss_mb"))
