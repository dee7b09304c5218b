"""Reports of findings: counts, nested documents, tables, diffs, selections."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranks import numbered, top


def pattern_counts(findings: DataFrame) -> DataFrame:
    """Findings a pattern, most first (of equals by name)."""
    n = findings.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("place", F.row_number().over(Window.orderBy(F.col("n").desc(), "pattern")))  # a row a pattern


def severity_counts(findings: DataFrame, known: list[str]) -> DataFrame:
    """Findings a severity with their share, known severities in their order, unknown ones after."""
    n = findings.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    total = F.broadcast(n.agg(F.sum("n").alias("total")))  # one row
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, known)), F.col("severity")), F.lit(0)), F.lit(1000)).cast("int")
    return n.join(total).select("severity", "n", F.round(100 * F.col("n") / F.col("total"), 6).alias("pct"), place.alias("place"))


def nested(findings: DataFrame) -> DataFrame:
    """mod, path, findings: a row a file of the report, its findings in order of line; a file's findings are bounded by its length, a mod's are not."""
    return findings.groupBy("mod", "path").agg(F.sort_array(F.collect_list(F.struct("line", "pattern", "severity"))).alias("findings"))


def rollup(findings: DataFrame, impacts: DataFrame | None = None, default: str = "unknown") -> DataFrame:
    """mod, files, findings, by_severity, by_impact: totals of each mod, counted where the findings are.

    `impacts` (pattern, impact) names each pattern's impact, others have the default; without it by_impact is empty.
    """
    rows = findings.withColumn("__impact", F.lit(None).cast("string")) if impacts is None else findings.join(impacts.select("pattern", F.col("impact").alias("__impact")), "pattern", "left").fillna(default, ["__impact"])
    counted = rows.groupBy("mod", "path", "severity", "__impact").agg(F.count(F.lit(1)).alias("__n"))
    bag = lambda key: F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, "__n"))))
    by = lambda key, into: counted.filter(F.col(key).isNotNull()).groupBy("mod", key).agg(F.sum("__n").alias("__n")).groupBy("mod").agg(bag(key).alias(into))
    totals = counted.groupBy("mod", "path").agg(F.sum("__n").alias("__n")).groupBy("mod").agg(F.count(F.lit(1)).alias("files"), F.sum("__n").alias("findings"))
    return totals.join(by("severity", "by_severity"), "mod", "left").join(by("__impact", "by_impact"), "mod", "left")


def summary(findings: DataFrame, failures: DataFrame, rewritten: DataFrame) -> DataFrame:
    """One row: what the report says first: findings, by_severity, by_pattern, failures by kind, and the edits applied, dropped and the scripts they changed.

    failures (path, what); rewritten (path, applied, dropped). Empty tables give zeros.
    """
    count = lambda rows, key: rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("n"), F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, "n")))).alias("by"))
    severity, pattern, failed = count(findings, "severity"), count(findings, "pattern"), count(failures, "what")
    edits = rewritten.agg(F.coalesce(F.sum("applied"), F.lit(0)).alias("applied"), F.coalesce(F.sum("dropped"), F.lit(0)).alias("dropped"), F.count_if(F.col("applied") > 0).alias("modified"))
    one = severity.select(F.coalesce("n", F.lit(0)).alias("findings"), F.col("by").alias("by_severity"))
    rows = [pattern.select(F.col("by").alias("by_pattern")), failed.select(F.coalesce("n", F.lit(0)).alias("failures"), F.col("by").alias("by_failure")), edits]
    for r in rows:
        one = one.join(F.broadcast(r))  # one row each
    return one


def write_report(findings: DataFrame, failures: DataFrame, rewritten: DataFrame, path: str, impacts: DataFrame | None = None) -> None:
    """The whole report as JSON lines below a folder: `summary` (one document), `mods` (one a mod), `files` (one a file, in order of mod and path), `failures`."""
    summary(findings, failures, rewritten).coalesce(1).write.mode("overwrite").json(f"{path}/summary")
    rollup(findings, impacts).write.mode("overwrite").json(f"{path}/mods")
    nested(findings).repartitionByRange("mod", "path").sortWithinPartitions("mod", "path").write.mode("overwrite").json(f"{path}/files")
    failures.write.mode("overwrite").json(f"{path}/failures")


def json_documents(findings: DataFrame) -> DataFrame:
    """mod, document: a JSON summary of each mod, its totals by severity in order of name."""
    by = findings.groupBy("mod", "severity").agg(F.count(F.lit(1)).alias("n"))
    every = F.map_from_entries(F.sort_array(F.collect_list(F.struct("severity", "n"))))
    return by.groupBy("mod").agg(F.sum("n").alias("total"), every.alias("by_severity")).select("mod", F.to_json(F.struct("mod", "total", "by_severity")).alias("document"))


def write_json(findings: DataFrame, path: str) -> None:
    """The nested report, a JSON document a line, a file each."""
    nested(findings).write.mode("overwrite").json(path)


#: Rows of a table that comes to the driver to be printed.
SHOWN = 1000


def markdown(rows: DataFrame, most: int = SHOWN) -> str:
    """A small table in Markdown: its first `most` rows come to the driver, so pass an aggregate."""
    head = [f"| {' | '.join(rows.columns)} |", "|" + "---|" * len(rows.columns)]
    return "\n".join([*head, *(f"| {' | '.join('' if v is None else str(v) for v in r)} |" for r in rows.take(most))])


def plain_text(rows: DataFrame, most: int = SHOWN) -> str:
    """The same as aligned columns."""
    cells = [rows.columns, *[["" if v is None else str(v) for v in r] for r in rows.take(most)]]
    widths = [max(len(r[i]) for r in cells) for i in range(len(rows.columns))]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(r, widths, strict=True)).rstrip() for r in cells)


def html(rows: DataFrame, title: str, most: int = SHOWN) -> str:
    """The same as a page."""
    from html import escape

    row = lambda r, tag: "<tr>" + "".join(f"<{tag}>{escape('' if v is None else str(v))}</{tag}>" for v in r) + "</tr>"
    body = "".join([row(rows.columns, "th"), *(row(r, "td") for r in rows.take(most))])
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1><table>{body}</table></body></html>'


def examples(rows: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """The first `most` rows a key, for a report's lists; first of each of a key's parts, then of those, so that no task sorts a whole key."""
    return top(rows, keys, [F.col(c) for c in order], most, F.xxhash64(*order)).drop("place")


def fixable(findings: DataFrame, severities: list[str], opted: Column) -> DataFrame:
    """Findings of the severities, and opted ones on lines that none of those has."""
    first = findings.filter(F.col("severity").isin(*severities))
    return first.unionByName(findings.filter(opted & ~F.col("severity").isin(*severities)).join(first.select("path", "line").distinct(), ["path", "line"], "left_anti").select(*findings.columns))


def without(rows: DataFrame, excluded: DataFrame, name: str) -> DataFrame:
    """Rows whose name isn't on the list of exclusions."""
    return rows.join(excluded.select(name).distinct(), name, "left_anti")


def with_impact(rows: DataFrame, table: DataFrame, prefixes: list[tuple[str, str]], default: str) -> DataFrame:
    """`impact` of each pattern: by name, else by the first prefix that fits, else the default."""
    by_prefix = F.lit(None).cast("string")
    for prefix, impact in prefixes:
        by_prefix = F.coalesce(by_prefix, F.when(F.col("pattern").startswith(prefix), impact))
    return rows.join(table, "pattern", "left").withColumn("impact", F.coalesce("impact", by_prefix, F.lit(default)))


def unified_diff(pairs: DataFrame, keys: list[str], context: int = 3, most: int | None = None) -> DataFrame:
    """keys, diff: the unified diff of two texts (old, new), empty for equal ones; with `most` only the first so many by keys whose texts differ."""
    if most is not None:
        pairs = pairs.filter(~F.col("old").eqNullSafe(F.col("new"))).orderBy(*keys).limit(most)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.select(*keys).schema), "diff string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(keys)
            out = []
            for a, b in zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist(), strict=True):
                out.append("\n".join(difflib.unified_diff((a or "").split("\n"), (b or "").split("\n"), "old", "new", lineterm="", n=context)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(out, pa.string())], names=[*keys, "diff"])

    return pairs.select(*keys, "old", "new").mapInArrow(run, schema)


def chunks(names: DataFrame, name: str, size: int) -> DataFrame:
    """Names in order, dealt to chunks of `size` (for archives; a row a name); places are counted by ranges of names."""
    placed = numbered(names.withColumn("__all", F.lit(0)), "__all", [name], "__i")
    return placed.withColumn("chunk", F.floor(F.col("__i") / size).cast("int")).drop("__all", "__i")


def natural(column: str) -> list[Column]:
    """Sort keys: whole numbers by value before texts, nulls last."""
    c = F.col(column)
    is_number = c.rlike("^[0-9]+$")
    return [F.when(is_number, 0).otherwise(1), F.when(is_number, c.cast("long")), c.asc_nulls_last()]


def natural_key(column: Column) -> Column:
    """A sort key of mixed texts as people read them: runs of digits by their value, the rest without regard to case; of runs alike, the one with fewer zeros before it is first. Null for null."""
    pieces = F.regexp_extract_all(column, F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    digits = lambda x: F.regexp_replace(x, "^0+(?=.)", "")
    # A number's key begins with how many digits it has, so longer ones come after.
    return F.transform(pieces, lambda x: F.when(x.rlike("^[0-9]"), F.concat(F.lit("0"), F.lpad(F.length(digits(x)).cast("string"), 6, "0"), digits(x), F.lit(" "), F.lpad((F.length(x) - F.length(digits(x))).cast("string"), 6, "0"))).otherwise(F.concat(F.lit("1"), F.lower(x))))


def seen_before(rows: DataFrame, key: str, order: list[str], mark: Column, back: int, into: str) -> DataFrame:
    """How many of the `back` rows before this one are marked; null for none."""
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(-back, -1)
    return rows.withColumn(into, F.sum(F.when(mark, F.lit(1).cast("long"))).over(before))


def balance(rows: DataFrame, key: str, order: str, delta: Column) -> DataFrame:
    """How the running sum of brackets of a key ends: never opened, closed, broken (below 0 on the way) or open."""
    run = F.sum(delta).over(Window.partitionBy(key).orderBy(order))
    ends = rows.withColumn("__b", run).groupBy(key).agg(F.max("__b").alias("hi"), F.min("__b").alias("lo"), F.max_by("__b", order).alias("end"))
    outcome = F.when(F.col("hi") < 0, "never").when((F.col("lo") >= 0) & (F.col("end") == 0), "closed").when(F.col("lo") < 0, "broken").otherwise("open")
    return ends.select(key, outcome.alias("outcome"))
