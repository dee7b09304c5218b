"""Edits of scripts: made from facts, admitted a script at a time, spliced into its text.

An edit: path, pattern, start, end (characters, end exclusive; equal for an insertion), text, priority,
grp (edits that belong together, or null), enabler (an insertion of use only with its group's
replacements), atomic (the group is applied as a whole or not at all).
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rules as R
from .rules import more, of

EDIT = ["path", "pattern", "start", "end", "text", "priority", "grp", "enabler", "atomic"]
_SIMPLE = ("name", "index", "call", "invoke", "paren")


def edit(rows: DataFrame, pattern: str, start: Column | str, end: Column | str, text: Column, priority: int = 0, grp: Column | None = None, enabler: bool = False, atomic: bool = False) -> DataFrame:
    start, end = (F.col(x) if isinstance(x, str) else x for x in (start, end))
    return rows.select(
        "path", F.lit(pattern).alias("pattern"), start.cast("int").alias("start"), end.cast("int").alias("end"), text.alias("text"), F.lit(priority).alias("priority"),
        (F.lit(None) if grp is None else grp).cast("string").alias("grp"), F.lit(enabler).alias("enabler"), F.lit(atomic).alias("atomic"),
    )


LO, HI = "lo", "hi"


def _product(base: Column, exponent: Column) -> Column:
    return F.concat(F.lit("("), F.array_join(F.array_repeat(base, exponent.cast("int")), "*"), F.lit(")"))


def _root(base: Column) -> Column:
    return F.concat(F.lit("math.sqrt("), base, F.lit(")"))


def _literal(text: Column) -> Column:
    """A text as a string literal."""
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\0", "\\0")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return F.concat(F.lit('"'), text, F.lit('"'))


def length_edits(facts: DataFrame) -> DataFrame:
    calls = of(facts, "call").filter(F.col("name").isin("table.getn", "string.len") & (F.size("args") == 1))
    arg = F.col("args")[0]
    return edit(calls, "length", LO, HI, F.when(F.col("kinds")[0].isin(*_SIMPLE), F.concat(F.lit("#"), arg)).otherwise(F.concat(F.lit("#("), arg, F.lit(")"))))


def power_edits(facts: DataFrame) -> DataFrame:
    calls = of(facts, "call").filter((F.col("name") == "math.pow") & (F.size("args") == 2) & (F.col("kinds")[1] == "number"))
    base, exponent = F.col("args")[0], F.element_at(F.split(more("numbers"), ","), 2).cast("double")
    root = (exponent == 0.5) & more("negative").isNull()
    product = exponent.isin(2.0, 3.0, 4.0) & F.col("kinds")[0].isin("name", "number")
    first = edit(calls.filter(root | product), "power", LO, HI, F.when(root, _root(base)).otherwise(_product(base, exponent)))
    rows = of(facts, "pow").withColumn("e", more("exponent").cast("double"))
    root = (F.col("e") == 0.5) & more("negative").isNull()
    product = F.col("e").isin(2.0, 3.0) & more("base").isin("name", "number")
    return first.unionByName(edit(rows.filter(root | product), "power", LO, HI, F.when(root, _root(F.col("name"))).otherwise(_product(F.col("name"), F.col("e")))))


def fold_edits(facts: DataFrame) -> DataFrame:
    return edit(of(facts, "concat"), "fold", LO, HI, _literal(more("text")))


def plain_find_edits(facts: DataFrame) -> DataFrame:
    calls = of(facts, "call").filter((F.col("name") == "string.find") & F.size("args").between(2, 3) & (F.col("kinds")[1] == "string"))
    flag = F.when(F.size("args") == 2, ", 1, true").otherwise(", true")
    return edit(calls.filter(~more("second").rlike(R.PATTERN_MARKS)), "plain_find", F.col(HI) - 1, F.col(HI) - 1, flag)


def equality_edits(facts: DataFrame) -> DataFrame:
    other = F.when(F.col("name") == "==", "~=").otherwise("==")
    return edit(of(facts, "not_eq"), "equality", LO, HI, F.concat_ws(" ", more("left"), other, more("right")))


def distance_edits(facts: DataFrame) -> DataFrame:
    """Two spans a comparison, the method's name and the number, that go together."""
    rows = of(facts, "distance")
    square = F.pow(more("threshold").cast("double"), F.lit(2.0))
    text = F.when(square == F.floor(square), F.floor(square).cast("string")).otherwise(F.regexp_replace(F.format_string("%.6g", square), r"\.?0+$", ""))
    grp = F.concat_ws(":", F.lit("distance"), "lo")
    name = edit(rows, "distance", more("method_lo"), more("method_hi"), F.lit("distance_to_sqr"), grp=grp, atomic=True)
    return name.unionByName(edit(rows, "distance", more("number_lo"), more("number_hi"), text, grp=grp, atomic=True))


def append_edits(facts: DataFrame) -> DataFrame:
    calls = of(facts, "call").filter((F.col("name") == "table.insert") & (F.size("args") == 2) & more("statement").isNotNull() & more("alias").isNull() & F.col("kinds")[0].isin("name", "index"))
    t = F.col("args")[0]
    return edit(calls, "append", LO, HI, F.concat(t, F.lit("[#"), t, F.lit("+1] = "), F.col("args")[1]))


def debug_edits(facts: DataFrame) -> DataFrame:
    """Debug calls that are statements become comments, whatever follows on their line."""
    calls = of(facts, "call").filter(more("func").isin(*R.DEBUG) & ~F.col("name").startswith("math.") & more("statement").isNotNull())
    text = F.concat(F.col("name"), F.lit("("), F.array_join("args", ", "), F.lit(")"))
    return edit(calls, "debug", LO, HI, F.concat(F.lit("--[==[ "), F.replace(text, F.lit("]==]"), F.lit("] ==]")), F.lit(" ]==]")), priority=200)


def dead_edits(facts: DataFrame) -> DataFrame:
    after = edit(of(facts, "dead"), "dead", LO, HI, F.lit(""), priority=10)
    never = of(facts, "constant").filter(more("value").isin("false", "nil") & ((F.col("name") == "while") | more("branches").isNull()))
    return after.unionByName(edit(never, "dead", LO, HI, F.lit(""), priority=10))


def cache_edits(facts: DataFrame) -> DataFrame:
    """A local at the start of a body for each library function that it calls often, and the calls through it.

    The local's name is the first of name, name_1 ... name_9 that the script has nowhere.
    """
    wanted = R.uncached_calls(facts).select("path", "func", "name")
    taken = facts.filter(F.col("name").isNotNull()).groupBy("path").agg(F.collect_set("name").alias("taken"))
    base = F.regexp_replace("name", r"\.", "_")
    options = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.concat(F.lit("c_"), base, F.when(i == 0, "").otherwise(F.concat(F.lit("_"), i.cast("string")))))
    named = wanted.join(taken, "path").withColumn("held", F.filter(options, lambda x: ~F.array_contains("taken", x))[0]).filter("held IS NOT NULL").drop("taken")
    grp = F.concat_ws(":", F.lit("cache"), "func", "name")
    bodies = of(facts, "scope").select("path", "func", more("body").alias("body"))
    local = edit(named.join(bodies, ["path", "func"]), "cache", F.col("body"), F.col("body"), F.concat(F.lit("local "), "held", F.lit(" = "), "name", F.lit("\n")), 100, grp, enabler=True)
    calls = of(facts, "call").filter(more("alias").isNull() & more("bound").isNull() & more("method").isNull()).join(named, ["path", "func", "name"])
    return local.unionByName(edit(calls, "cache", more("callee_lo"), more("callee_hi"), F.col("held"), 100, grp))


def guard_edits(facts: DataFrame) -> DataFrame:
    """A statement that uses what may be nil, right after it was assigned and nowhere else, goes into a test."""
    rows = of(facts, "nil_access").filter(more("safe").isNotNull()).dropDuplicates(["path", "line", "name"])
    return edit(rows, "guard", more("at_lo"), more("at_hi"), F.concat(F.lit("if "), "name", F.lit(" then "), more("text"), F.lit(" end")), 50)


GENERATORS = {
    "length": length_edits, "power": power_edits, "fold": fold_edits, "plain_find": plain_find_edits, "equality": equality_edits, "distance": distance_edits,
    "append": append_edits, "debug": debug_edits, "dead": dead_edits, "cache": cache_edits, "guard": guard_edits,
}
SAFE = ("length", "power", "fold", "plain_find", "equality", "distance", "append")


def edits_of(facts: DataFrame, kinds: tuple[str, ...] = SAFE) -> DataFrame:
    parts = [GENERATORS[k](facts) for k in kinds]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


class Edit:
    __slots__ = ("start", "end", "text", "priority", "grp", "enabler", "atomic", "inner")

    def __init__(self, start, end, text, priority=0, grp=None, enabler=False, atomic=False):
        self.start, self.end, self.text, self.priority, self.grp, self.enabler, self.atomic = start, end, text, priority, grp, enabler, atomic
        self.inner: list[Edit] = []


def spliced(source: str, edits: list[Edit]) -> tuple[str, int, int, list[tuple[int, int, int, int]]]:
    """The text with the edits that fit together, how many were applied and dropped, and the pieces put in.

    A piece is (start, end) in the source and (to_start, to_end) in the text.

    Replacements come by falling priority, then from the end. One that overlaps nothing held is held;
    one that wraps held ones takes them in if its text has the wrapped source exactly once; what
    overlaps partly is dropped. An atomic group that lost a replacement is given up, and what its
    members had taken in is held by itself again. Then insertions: the same one at one place counts
    once, one inside a held replacement goes into its text at the source around it, if that can be
    told, and enablers whose group holds no replacement are dropped.
    """
    by_rank = sorted(edits, key=lambda e: (-e.priority, -e.start))
    replacements = [e for e in by_rank if e.end > e.start]
    held: list[Edit] = []  # apart from each other, in the order of the source
    landed: set[int] = set()
    for e in replacements:
        first_after = bisect_right(held, e.start, key=lambda h: h.end)
        behind = bisect_left(held, e.end, key=lambda h: h.start)
        met = held[first_after:behind]
        if met:
            first, last = met[0].start, met[-1].end
            wrapped = source[first:last]
            if first < e.start or last > e.end or e.text.count(wrapped) != 1:
                continue
            parts, at = [], first
            for h in met:
                parts += [source[at : h.start], h.text]
                at = h.end
            e.text, e.inner = e.text.replace(wrapped, "".join(parts)), met
        held[first_after:behind] = [e]
        landed.add(id(e))
    lost = {e.grp for e in replacements if e.atomic and e.grp is not None and id(e) not in landed}
    for e in [h for h in held if h.atomic and h.grp in lost]:
        at = held.index(e)
        held[at : at + 1] = e.inner
        landed.discard(id(e))
    landed -= {id(e) for e in replacements if e.atomic and e.grp in lost}
    live = {e.grp for e in replacements if id(e) in landed and e.grp is not None}
    placed: list[Edit] = []
    seen = set()
    for e in by_rank:
        if e.end > e.start or (e.start, e.text) in seen:
            continue
        seen.add((e.start, e.text))
        at = bisect_left(held, e.start, key=lambda h: h.start) - 1  # the last that starts before
        around = held[at] if at >= 0 and held[at].end > e.start else None
        if around is None:
            if not (e.enabler and e.grp is not None and e.grp not in live):
                placed.append(e)
                landed.add(id(e))
            continue
        for width in range(1, around.end - around.start + 1):
            lo, hi = max(around.start, e.start - width), min(around.end, e.start + width)
            if around.text.count(source[lo:hi]) == 1:
                at = around.text.index(source[lo:hi]) + e.start - lo
                around.text = around.text[:at] + e.text + around.text[at:]
                landed.add(id(e))
                break
    out, at, to, pieces = [], 0, 0, []
    for e in sorted([*held, *placed], key=lambda e: (e.start, e.end)):
        out += [source[at : e.start], e.text]
        to += e.start - at
        pieces.append((e.start, e.end, to, to + len(e.text)))
        at, to = e.end, to + len(e.text)
    return "".join([*out, source[at:]]), len(landed), len(edits) - len(landed), pieces


def resolve(source: str, edits: list[Edit]) -> tuple[str, int, int]:
    """`spliced` without the pieces."""
    return spliced(source, edits)[:3]


_PIECE = pa.struct([(c, pa.int32()) for c in ("start", "end", "to_start", "to_end")])
REWRITTEN = "path string, text string, applied int, dropped int, pieces array<struct<start:int,end:int,to_start:int,to_end:int>>"


def rewrite(files: DataFrame, edits: DataFrame) -> DataFrame:
    """path, text, applied, dropped, pieces (what was put in, and where): each script (path, text) with its edits; a script's edits are bounded by its length."""
    ordered = F.struct("start", "end", "text", "priority", "grp", "enabler", "atomic")
    by_path = edits.groupBy("path").agg(F.sort_array(F.collect_list(ordered)).alias("edits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            fields = [c.to_pylist() for c in lists.flatten().flatten()]
            each = map(Edit, *fields)
            done, places, ends = [], [], [0]
            for text, n in zip(batch.column(1).to_pylist(), pc.list_value_length(lists).to_pylist(), strict=True):
                made = spliced(text or "", list(islice(each, n or 0)))
                done.append(made[:3])
                places += made[3]
                ends.append(len(places))
            if done:
                pieces = pa.StructArray.from_arrays([pa.array(c, pa.int32()) for c in (zip(*places, strict=True) if places else [()] * 4)], fields=list(_PIECE))
                columns = [pa.array(c, k) for c, k in zip(zip(*done, strict=True), (pa.string(), pa.int32(), pa.int32()), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pieces)], names=["path", "text", "applied", "dropped", "pieces"])

    # Dealt by path: a join that broadcasts would leave all scripts to the few tasks that read their table.
    return files.join(by_path, "path", "left").select("path", "text", "edits").repartition("path").mapInArrow(run, REWRITTEN)
