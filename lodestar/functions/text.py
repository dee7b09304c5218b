"""Text and number functions of the reports: key-value bags, slugs, log lines, sizes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: What surrounds a key or a value without being part of it.
BLANKS = " \t\n\x0b\x0c\r"


def kv_bag(line: Column, separator: str = "|") -> Column:
    """`k=v` parts as a map, split at the first `=`, without the blanks around keys and values.

    Parts without a `=` are left out. Of equal keys the last holds, whatever the session's policy for
    repeated keys: earlier ones are taken out before the map is made. A null line gives null.
    """
    parts = F.filter(F.split(line, "\\" + separator), lambda p: F.instr(p, "=") > 0)
    strip = lambda c: F.btrim(c, F.lit(BLANKS))
    pair = lambda p: F.struct(strip(F.substring_index(p, "=", 1)).alias("key"), strip(F.substr(p, F.instr(p, "=") + 1)).alias("value"))
    keys = lambda pairs: F.transform(pairs, lambda p: p["key"])
    # By key and place; the last of each key stays.
    placed = lambda pairs: F.sort_array(F.transform(pairs, lambda p, i: F.struct(p["key"].alias("key"), i.alias("at"), p["value"].alias("value"))))
    last = lambda by_key: F.filter(by_key, lambda p, i: F.coalesce(F.get(by_key, i + 1)["key"] != p["key"], F.lit(True)))
    without_place = lambda kept: F.transform(kept, lambda p: F.struct(p["key"], p["value"]))
    bag = lambda pairs: F.map_from_entries(F.when(F.size(F.array_distinct(keys(pairs))) == F.size(pairs), pairs).otherwise(without_place(_once(placed(pairs), last))))
    return _once(F.transform(parts, pair), bag)


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is worked out once, however often `then` names it."""
    return F.transform(F.array(value), then)[0]


def number(text: Column) -> Column:
    """A number, or null for `nil` and what isn't one."""
    return F.nullif(text, F.lit("nil")).try_cast("double")


def slug(text: Column, limit: int = 40, default: str = "run") -> Column:
    """Lower case, runs of other characters as one dash, cut to a length."""
    dashed = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")
    cut = F.substring(F.regexp_replace(dashed, "^-+|-+$", ""), 1, limit)
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit(default))


def log_level(line: Column) -> Column:
    """What the first character of an engine log line says."""
    first = F.substring(line, 1, 1)
    return F.when(first == "!", "error").when(first == "~", "warning").when(first == "*", "info").when(first == "#", "script").when(first == "$", "command").otherwise("plain")


def human_size(n: Column) -> Column:
    return F.when(n < 1024, F.format_string("%d B", n)).when(n < 1024 * 1024, F.format_string("%.1f KB", n / 1024)).otherwise(F.format_string("%.1f MB", n / (1024 * 1024)))


def trip_count(start: Column, stop: Column, step: int) -> Column:
    """Rounds of a counting loop, never below 0."""
    return F.greatest(F.lit(0), F.floor((stop - start) / step) + 1)


def typed_number(text: Column) -> Column:
    """A struct of `whole` (whole numbers without a point, also in the form 1e3) and `real` (the others); both null for `nil` and what isn't a number."""
    t = F.trim(text)
    digits, value = t.rlike(r"^[+-]?\d+$"), F.nullif(t, F.lit("nil")).try_cast("double")
    is_whole = digits | ~t.contains(".") & (value == F.floor(value)) & (F.abs(value) < 1e18)
    whole = F.when(digits, t.try_cast("long")).when(is_whole, value.cast("long"))
    return F.struct(whole.alias("whole"), F.when(~F.coalesce(is_whole, F.lit(False)), value).alias("real"))


def rates(ft: Column, fps: Column) -> tuple[Column, Column]:
    """Frame time and rate, each from the other where it is missing; null where that would divide by 0."""
    other = lambda x: F.when(x != 0, 1000 / x)
    return F.coalesce(ft, other(fps)), F.coalesce(fps, other(ft))


def patched_once(text: Column, old: str, new: str) -> Column:
    """The text with `old` replaced if it occurs exactly once, else null."""
    quoted = "\\Q" + old + "\\E"
    return F.when(F.regexp_count(text, F.lit(quoted)) == 1, F.replace(text, F.lit(old), F.lit(new)))


def masked_scripts(rows: DataFrame, text: str) -> DataFrame:
    """The rows with comments and string literals of script texts blanked, all other characters in their places."""
    import re

    marks = re.compile(r"--\[(=*)\[[\s\S]*?(?:\]\1\]|\Z)|--[^\n]*|\[(=*)\[[\s\S]*?\]\2\]|\"(?:\\[\s\S]|[^\"\\\n])*\"|'(?:\\[\s\S]|[^'\\\n])*'")
    at = rows.columns.index(text)
    schema = rows.schema

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            blank = lambda m: re.sub(r"[^\n]", " ", m.group())
            columns = list(batch.columns)
            columns[at] = pa.array([None if t is None else marks.sub(blank, t) for t in columns[at].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return rows.mapInArrow(run, schema)


def indent_unit(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, unit: the most frequent leading white space of the text's lines (of equals the shortest, then the least)."""
    lead = rows.select(key, F.explode(F.split(text, "\n")).alias("__line")).select(key, F.regexp_extract("__line", r"^(\s*)\S", 1).alias("unit")).filter("unit != ''")
    counted = lead.groupBy(key, "unit").agg(F.count(F.lit(1)).alias("__n"))
    return counted.groupBy(key).agg(F.min_by("unit", F.struct(-F.col("__n"), F.length("unit"), "unit")).alias("unit"))
