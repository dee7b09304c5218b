"""Engine logs: one entry a line, the crash and stack sections, and a summary a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Signs at the start of a line, phrases (in lower case) and what names a module.
SIGNS = "*!~#$"
FATAL, TRACE, PHASE = "fatal error", "stack trace", "phase time:"
LEVELS = ("starting level", "loading level")
LOADED, CREATED = "is successfully loaded", "new game is successfully created"
TIMES = ("load time", "loading time", "loadtime")
SIMULATION = ("alife", "a-life")
MODULES = (".dll", ".exe")
#: A time in brackets comes first, then a sign, then a tag in brackets with a colon, then the text; each of the three may be missing.
HEAD = r"(?s)^(?: *\[([:. \t]*[0-9][0-9:. \t]*)\] *)?(?:([" + SIGNS + r"]) *)?(?:\[([^\]]+)\]: *)?(.*)$"


def _after(text: Column, phrase: str) -> Column:
    """What follows a phrase (in any case), or null."""
    at = F.instr(F.lower(text), phrase)
    return F.when(at > 0, F.substr(text, at + F.lit(len(phrase)), F.length(text)))


def _first_of(columns: list[Column]) -> Column:
    return F.coalesce(*columns)


def _number(text: Column) -> Column:
    """The first number of a text."""
    return F.regexp_extract(text, r"\d+\.?\d*", 0).try_cast("double")


def _has(text: Column, phrases: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | F.lower(text).contains(p)
    return out


def entries(lines: DataFrame) -> DataFrame:
    """path, index, raw, sigil, tag, text, timestamp, t_s, part of lines (path, line_no, raw); blank ones are left out.

    `part`: `fatal`, `marker` (a stack trace begins), `stack`, `detail` (of a crash) or `plain`. A
    stack lasts while lines are indented or name a module; details are bracketed lines after a crash.
    """
    rows = lines.withColumn("line", F.regexp_replace("raw", r"\s+$", "")).filter("line != ''")
    piece = lambda i: F.regexp_extract("line", HEAD, i)
    rows = rows.withColumns({"stamp": F.nullif(F.trim(piece(1)), F.lit("")), "sigil": piece(2), "tag": piece(3), "body": piece(4)})
    stamp = F.col("stamp")
    clock = F.split(stamp, ":")
    part = lambda i, by: F.get(clock, F.lit(i)).try_cast("double") * by
    seconds = F.coalesce(stamp.try_cast("double"), F.when(F.size(clock) == 3, part(0, 3600) + part(1, 60) + part(2, 1)))
    rows = rows.withColumn("fatal", F.lower("line").contains(FATAL)).withColumn("marker", ~F.col("fatal") & F.lower("line").contains(TRACE))
    frame = F.substring("line", 1, 1).isin(" ", "\t") | _has(F.substring_index(F.trim("line"), " ", 1), MODULES)
    before = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    state = F.when(F.col("marker"), True).when(~F.col("fatal") & ~frame, False)
    rows = rows.withColumn("in_stack", F.coalesce(F.last(state, ignorenulls=True).over(before), F.lit(False))).withColumn("crashed", F.coalesce(F.max("fatal").over(before), F.lit(False)))
    kind = F.when(F.col("fatal"), "fatal").when(F.col("marker"), "marker").when(F.col("in_stack") & frame, "stack").when(F.col("crashed") & F.ltrim("line").startswith("["), "detail").otherwise("plain")
    return rows.select("path", F.col("line_no").alias("index"), "raw", "sigil", "tag", F.trim("body").alias("text"), stamp.alias("timestamp"), seconds.alias("t_s"), kind.alias("part"), F.btrim("line", F.lit(" \t")).alias("line"))


def summaries(rows: DataFrame) -> DataFrame:
    """One row a file: lines, crashed, errors, warnings, stack_trace, levels, world_loads, phase_times_ms, load_time_s, alife, build."""
    plain = F.col("part") == "plain"
    in_order = lambda when, what: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("index", what.alias("v"))))), lambda x: x["v"])
    low = F.lower("text")
    error = F.when(F.col("part") == "fatal", F.coalesce(F.nullif("text", F.lit("")), F.col("line"))).when(F.col("part") == "detail", F.col("line")).when(plain & (F.col("sigil") == "!") & low.contains("error"), F.col("text"))
    level = F.coalesce(F.btrim(_first_of([_after(F.col("text"), p) for p in LEVELS]), F.lit(" []\t")), F.lit(""))
    told = _first_of([_after(F.col("text"), p) for p in TIMES])
    unit = F.lower(F.btrim(F.regexp_replace(told, r"^[^\d]*[\d.]+", ""), F.lit(" )]\t")))
    took = _number(told) * F.when(unit.startswith("ms"), 0.001).otherwise(1.0)
    low_line = F.lower("line")
    ready = low_line.contains("*") & (low_line.contains(CREATED) | low_line.contains("game ") & low_line.contains(LOADED))
    name = _after(F.substr("line", F.lit(1), F.instr(low_line, LOADED) - 1), "game ")
    save = F.when(low_line.contains(CREATED), "<new game>").otherwise(F.coalesce(F.nullif(F.trim(name), F.lit("")), F.lit("<new game>")))
    phase = _number(_after(F.col("line"), PHASE))
    out = rows.groupBy("path").agg(
        F.count(F.lit(1)).alias("lines"),
        F.max(F.col("part") == "fatal").alias("crashed"),
        in_order(error.isNotNull(), error).alias("errors"),
        F.count_if(plain & F.col("sigil").isin("!", "~")).alias("warnings"),
        in_order(F.col("part") == "stack", F.col("line")).alias("stack_trace"),
        F.array_distinct(in_order(plain & (level != ""), level)).alias("levels"),
        in_order(plain & ready, save).alias("world_loads"),
        in_order(plain & phase.isNotNull(), phase.cast("long")).alias("phase_times_ms"),
        F.min(F.when(plain & took.isNotNull() & ~low.contains("texture"), F.struct("index", took.alias("s")))).alias("took"),
        F.min(F.when(plain & low.contains("build") & F.col("text").rlike(r"\d"), F.struct("index", "text"))).alias("build"),
    )
    phases = F.aggregate("phase_times_ms", F.lit(0).cast("long"), lambda a, x: a + x) / 1000
    out = out.withColumn("load_time_s", F.coalesce("took.s", F.when(F.size("phase_times_ms") > 0, phases))).withColumn("build", F.col("build.text")).drop("took")
    # `name : number` between commas; the name is what follows the colon before it.
    pieces = rows.filter(plain & _has(F.col("text"), SIMULATION)).select("path", "index", F.posexplode(F.split(F.translate("text", "=;", ":,"), ",")).alias("at", "piece"))
    ends = pieces.select("path", "index", "at", F.split("piece", ":").alias("p")).filter(F.size("p") > 1)
    found = ends.select("path", "index", "at", F.trim(F.element_at("p", -2)).alias("k"), F.regexp_extract(F.trim(F.element_at("p", -1)), r"^-?\d+(\.\d+)?", 0).try_cast("double").alias("v")).filter("v IS NOT NULL AND k != ''")
    last = found.groupBy("path", F.replace(F.lower("k"), F.lit(" "), F.lit("_")).alias("key")).agg(F.max_by("v", F.struct("index", "at")).alias("value"))
    alife = last.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("alife"))
    return out.join(alife, "path", "left")


def after_marker(samples: DataFrame, key: str, t: str, marker: str, warm_up: float) -> DataFrame:
    """Samples of each run from `warm_up` after its first marker on; runs without one give none."""
    first = F.min(F.when(F.col(marker), F.col(t))).over(Window.partitionBy(key))
    return samples.withColumn("__from", first + warm_up).filter(F.col(t) >= F.col("__from")).drop("__from")
