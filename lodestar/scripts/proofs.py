"""Rules and edits that need a proof about a variable, from its mentions.

A proof is refuted, never assumed: a variable's shape is the worst that one of its mentions makes of
it (a sequence, then a table that may be anything), so it is an anti join of the declarations with
the mentions that refute. What depends on the place (a table that grows while it is walked, a read
between two writes) compares places of the same script.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import stored
from . import rules as R
from .edits import SAFE, append_edits, edit, edits_of
from .rules import finding, more, of

#: Calls that a compiled trace takes in.
TRANSPARENT = (
    "tonumber", "type", "rawget", "rawset", "rawequal", "select", "assert", "ipairs", "setmetatable", "getmetatable", "math.abs", "math.ceil", "math.floor",
    "math.max", "math.min", "math.sqrt", "math.random", "math.sin", "math.cos", "math.tan", "math.asin", "math.acos", "math.atan", "math.exp", "math.log",
    "math.log10", "math.pow", "math.modf", "string.sub", "string.byte", "string.len", "table.insert", "table.remove",
)
#: Methods of a vector that leave it where it is, and methods that copy a vector they are handed.
OWN_METHODS = (
    "set", "add", "sub", "mul", "div", "mad", "invert", "normalize", "magnitude", "distance_to", "distance_to_sqr", "distance_to_xz", "distance_to_xz_sqr",
    "dotproduct", "crossproduct", "similar", "getH", "getP", "abs",
)
COPYING_METHODS = ("distance_to", "distance_to_sqr", "distance_to_xz", "distance_to_xz_sqr", "play_at_pos")
#: Fixed value: a literal loop of fewer rounds is not worth a counter.
LEAST_ROUNDS = 20
#: Values that are never nil, by kind.
NEVER_NIL = ("number", "string", "table", "true", "false", "function", "binary", "unary")

VAR = ["path", "decl"]


def locals_of(b: DataFrame) -> DataFrame:
    """path, decl, name, func, block, declared (end of its statement), made, single: the declarations `local x = ...`."""
    rows = of(b, "declare").filter("use = 'local'")
    return rows.select(*VAR, "name", "func", "block", "line", "loops", "at_lo", F.col("at_hi").alias("declared"), more("made").alias("made"), more("single").isNotNull().alias("single"))


def uses_of(b: DataFrame) -> DataFrame:
    """Mentions of what is declared in the script; captured: from another function than the declaration's."""
    return of(b, "use").filter("decl != -1").withColumn("captured", F.col("func") != F.col("home"))


def loops_of(b: DataFrame) -> DataFrame:
    """path, loop, loop_hi, func, block, loop_line, line_lo and indent (null if the loop doesn't begin its line), trips."""
    return of(b, "loop").select(
        "path", F.col("lo").alias("loop"), F.col("hi").alias("loop_hi"), "func", "block", F.col("line").alias("loop_line"), F.col("last").alias("loop_last"), more("line_lo").cast("int").alias("line_lo"),
        more("indent").alias("indent"), more("trips").cast("long").alias("trips"), more("ends_line").isNotNull().alias("ends_line"),
    )


def names_taken(b: DataFrame) -> DataFrame:
    """path, taken: the names a script has anywhere."""
    return b.filter("name IS NOT NULL").groupBy("path").agg(F.collect_set("name").alias("taken"))


def free_name(base: Column, taken: Column, tries: int = 40) -> Column:
    """The first of base, base_1, base_2 ... that isn't taken."""
    options = F.transform(F.sequence(F.lit(0), F.lit(tries)), lambda i: F.when(i == 0, base).otherwise(F.concat(base, F.lit("_"), i.cast("string"))))
    return F.get(F.filter(options, lambda x: ~F.array_contains(taken, x)), F.lit(0))


# -- tables that are sequences


def sequences(b: DataFrame) -> DataFrame:
    """path, decl: locals that hold a sequence without holes for all of their life.

    They start empty or with constants only, and every mention reads an element, takes the length,
    walks the table, or appends to it. What another function can see, or what is handed on, returned
    or compared, may be changed by others and is none.
    """
    made = locals_of(b).filter("single AND made IN ('empty', 'literal')")
    kept = F.col("use").isin("read", "length", "iterated") | (F.col("use") == "append") & (more("order") == "after") | (F.col("use") == "insert") & more("alias").isNull()
    refuted = uses_of(b).filter(F.col("captured") | ~kept).select(*VAR)
    return made.select(*VAR, "name", "func").join(refuted, VAR, "left_anti")


def walked_sequences(b: DataFrame) -> DataFrame:
    """path, decl, name, func, loop, line, callee_lo, callee_hi: loops over `pairs(t)` of a sequence that does not grow inside."""
    walks = uses_of(b).filter((F.col("use") == "iterated") & (more("callee") == "pairs") & more("header").isNotNull())
    walks = walks.select(*VAR, "name", "func", "line", more("header").cast("int").alias("loop"), more("callee_lo").cast("int").alias("callee_lo"), more("callee_hi").cast("int").alias("callee_hi"))
    walks = walks.join(sequences(b).select(*VAR), VAR, "left_semi").join(loops_of(b).select("path", "loop", "loop_hi"), ["path", "loop"])
    grows = uses_of(b).filter("use IN ('append', 'insert')").select(*VAR, F.col("lo").alias("at"))
    inside = walks.join(grows, VAR).filter("at > loop AND at < loop_hi").select("path", "loop").distinct()
    return walks.join(inside, ["path", "loop"], "left_anti")


def undecidable(b: DataFrame) -> DataFrame:
    """path, func of bodies with a call that no list knows, so that what it does to a trace is open."""
    known = F.col("name").isin(*TRANSPARENT, *R.ABORTING, *R.ABORTING_FROM, *R.ENGINE_GLOBALS) | F.substring_index("name", ".", 1).isin(*R.ENGINE_SPACES) & F.col("name").contains(".")
    calls = of(b, "call").filter(~F.coalesce(known & F.col("use").isNull(), F.lit(False)))
    return calls.select("path", "func").unionByName(of(b, "invoke").filter(~F.col("name").isin(*R.ENGINE_METHODS)).select("path", "func")).distinct()


def modes_without(facts: DataFrame, b: DataFrame, walks: DataFrame) -> DataFrame:
    """path, func, mode of the bodies of `walks` once their `pairs` on these lines are gone."""
    places = of(facts, "scope").select("path", F.col("func").alias("scope_id"), F.col("lo").alias("func"))
    sites = R.aborting_sites(facts).withColumnRenamed("func", "scope_id").join(places, ["path", "scope_id"])
    gone = walks.select("path", "func", "line").distinct().withColumn("gone", F.lit(True))
    left = sites.join(gone, ["path", "func", "line"], "left").filter(~(F.col("gone").isNotNull() & F.col("reason").isin("library: pairs", "library: next")))
    totals = left.groupBy("path", "func").agg(F.bool_or(F.size("chain") == 0).alias("always"))
    rows = walks.select("path", "func").distinct().join(totals, ["path", "func"], "left").join(undecidable(b).withColumn("open", F.lit(True)), ["path", "func"], "left")
    mode = F.when(F.col("func") < 0, "unknown").when(F.col("always"), "interpreted").when(~F.col("always"), "mixed").when(F.col("open"), "undecidable").otherwise("compiled")
    return rows.select("path", "func", mode.alias("mode"))


def pairs_to_ipairs(facts: DataFrame, b: DataFrame) -> DataFrame:
    """pairs(t) over a sequence: GREEN where the body compiles once it is gone, RED else (there ipairs is slower)."""
    walks = stored(walked_sequences(b))
    rows = walks.join(modes_without(facts, b, walks), ["path", "func"]).withColumns({"lo": F.col("callee_lo"), "hi": F.col("callee_hi")})
    severity = F.when(F.col("mode") == "compiled", "GREEN").otherwise("RED")
    message = F.format_string("pairs(%s) walks a sequence; the body is %s without it", "name", "mode")
    return finding(rows, "pairs_to_ipairs", severity, message, {"table": F.col("name"), "mode": F.col("mode")})


def ipairs_edits(facts: DataFrame, b: DataFrame) -> DataFrame:
    return edit(pairs_to_ipairs(facts, b).filter("severity = 'GREEN'"), "ipairs", "lo", "hi", F.lit("ipairs"))


# -- counters of append loops


def append_loops(b: DataFrame) -> DataFrame:
    """Loops in which a table of the same block is only appended to: a row a table and loop.

    path, decl, name, func, loop, line_lo, indent, line, seed, sites, all_non_nil. From the
    declaration to the loop's end every mention appends in a statement of its own, none from another
    function. Literal loops of fewer than LEAST_ROUNDS rounds are left out.
    """
    tables = locals_of(b).filter("single AND made IN ('empty', 'literal', 'array')").select(*VAR, "name", "func", "block", "declared", "made")
    near = tables.join(loops_of(b), ["path", "func", "block"]).filter("loop >= declared AND coalesce(trips, 1000000) >= " + str(LEAST_ROUNDS))
    appends = ((F.col("use") == "append") | (F.col("use") == "insert")) & more("statement").isNotNull() & ~F.col("captured")
    uses = uses_of(b).select(*VAR, F.col("lo").alias("at"), appends.alias("appends"), more("value").alias("value"))
    met = near.join(uses, VAR).filter("at < loop_hi")
    inside = F.col("at") > F.col("loop")
    by = met.groupBy(*VAR, "name", "func", "loop", "loop_line", "line_lo", "indent", "made").agg(
        F.bool_and("appends").alias("only"), F.count_if(inside).alias("sites"), F.count_if(~inside).alias("before"), F.bool_and(~inside | F.col("value").isin(*NEVER_NIL)).alias("all_non_nil"))
    seed = F.when((F.col("made") == "empty") & (F.col("before") == 0), "0").otherwise(F.concat(F.lit("#"), "name"))
    return by.filter("only AND sites > 0").select(*VAR, "name", "func", "loop", "line_lo", "indent", F.col("loop_line").alias("line"), seed.alias("seed"), "sites", "all_non_nil")


def append_loop_counter(facts: DataFrame, b: DataFrame) -> DataFrame:
    """An append-only table in a loop can count for itself."""
    rows = append_loops(b)
    return finding(rows, "append_loop_counter", "YELLOW", F.format_string("%s is only appended to in this loop: count its elements", "name"), {"table": F.col("name"), "seed": F.col("seed"), "sites": F.col("sites"), "all_non_nil": F.col("all_non_nil")})


def counter_sites(b: DataFrame) -> DataFrame:
    """The appends that a counter takes over: path, decl, name, loop, line_lo, indent, seed, counter, at_lo, at_hi, value_lo, value_hi, alias.

    The loop has to begin its line. A counter whose inserts would leave a local name of table.insert
    without a reader is given up, so that the name isn't left unused.
    """
    found = append_loops(b).filter("line_lo IS NOT NULL").join(names_taken(b), "path")
    # Loops of one table share no counter: the second one's name is taken by the first.
    order = F.row_number().over(R.Window.partitionBy("path", "name").orderBy("loop")) - 1
    base = F.concat("name", F.lit("_n"))
    named = found.withColumn("nth", order).withColumn("counter", free_name(F.when(F.col("nth") == 0, base).otherwise(F.concat(base, F.col("nth") + 1)), F.col("taken")))
    sites = uses_of(b).filter(F.col("use").isin("append", "insert") & more("statement").isNotNull()).select(
        *VAR, F.col("lo").alias("at"), "at_lo", "at_hi", more("value_lo").cast("int").alias("value_lo"), more("value_hi").cast("int").alias("value_hi"), more("alias").alias("alias"))
    ends = loops_of(b).select("path", "loop", "loop_hi")
    met = stored(named.filter("counter IS NOT NULL").join(ends, ["path", "loop"]).join(sites, VAR).filter("at > loop AND at < loop_hi").drop("taken"))
    reads = of(b, "use").filter("use = 'called'").groupBy("path", F.col("name").alias("alias")).agg(F.count(F.lit(1)).alias("reads"))
    taken = met.filter("alias IS NOT NULL").groupBy("path", "alias").agg(F.count(F.lit(1)).alias("n"))
    orphaned = taken.join(reads, ["path", "alias"]).filter("n >= reads").select("path", "alias")
    dropped = met.join(orphaned, ["path", "alias"], "left_semi").select("path", "decl", "loop").distinct()
    return met.join(dropped, ["path", "decl", "loop"], "left_anti")


def counter_edits(files: DataFrame, b: DataFrame) -> DataFrame:
    """The counter's declaration above the loop and the appends through it, a group that goes together."""
    sites = stored(counter_sites(b))
    grp = F.concat_ws(":", F.lit("counter"), "decl", "loop")
    texts = sites.join(files.select("path", F.col("text").alias("source")), "path")
    value = F.substr("source", F.col("value_lo") + 1, F.col("value_hi") - F.col("value_lo"))
    line = F.concat("counter", F.lit(" = "), "counter", F.lit(" + 1; "), "name", F.lit("["), "counter", F.lit("] = "), value)
    each = edit(texts, "counter", "at_lo", "at_hi", line, -1, grp, atomic=True)
    head = sites.select("path", "decl", "loop", "line_lo", "indent", "counter", "seed").distinct()
    return each.unionByName(edit(head, "counter", "line_lo", "line_lo", F.concat("indent", F.lit("local "), "counter", F.lit(" = "), "seed", F.lit("\n")), -1, grp, enabler=True))


def arbitrated(facts: DataFrame, files: DataFrame, b: DataFrame) -> DataFrame:
    """Counter edits, and the plain appends that no counter has claimed: one winner a call."""
    counters = stored(counter_edits(files, b))
    claimed = counters.filter("end > start").select("path", "start", "end")
    return counters.unionByName(append_edits(facts).join(claimed, ["path", "start", "end"], "left_anti"))


# -- vectors that do not outlive a round


def loop_vectors(b: DataFrame) -> DataFrame:
    """Every `vector()` in a loop, with safe: it is `vector():set(...)` and nothing keeps it beyond the round.

    Safe are a statement of its own, an argument of a method that copies it, and a local whose every
    mention reads a field, calls one of its own methods or hands it to a copying method, in the same
    function. A vector of a function that is made in a loop is not safe: its loop would be hoisted into
    that one.
    """
    allocs = of(b, "alloc").filter(F.size("loops") > 0)
    kept = (F.col("use") == "read") | (F.col("use") == "receiver") & more("method").isin(*OWN_METHODS) | (F.col("use") == "handed") & more("method").isin(*COPYING_METHODS)
    refuted = uses_of(b).filter(F.col("captured") | ~F.coalesce(kept, F.lit(False))).select(*VAR).distinct().withColumn("escapes", F.lit(True))
    rows = allocs.join(refuted, VAR, "left")
    shape = (F.col("use") == "statement") | (F.col("use") == "handed") & more("method").isin(*COPYING_METHODS) | (F.col("use") == "local") & (F.col("decl") != -1) & F.col("escapes").isNull()
    return rows.withColumn("safe", F.coalesce(shape, F.lit(False)) & more("blocked").isNull()).withColumn("outer", F.col("loops")[0])


def vectors_in_loops(facts: DataFrame, b: DataFrame) -> DataFrame:
    """A vector made in every round: YELLOW where one above the loop can take its place, RED else."""
    rows = loop_vectors(b)
    return finding(rows, "vector_alloc_in_loop", F.when(F.col("safe"), "YELLOW").otherwise("RED"), F.lit("a vector is made in every round"), {"safe": F.col("safe"), "depth": F.size("loops")})


def scratch_edits(b: DataFrame) -> DataFrame:
    """One vector above the outermost loop for each safe one, under a name of its own; the loop has to begin its line."""
    rows = loop_vectors(b).filter("safe").join(loops_of(b).select("path", F.col("loop").alias("outer"), "line_lo", "indent"), ["path", "outer"]).filter("line_lo IS NOT NULL")
    rows = rows.join(names_taken(b), "path").withColumn("nth", F.row_number().over(R.Window.partitionBy("path").orderBy("lo")))  # of one script's
    options = F.filter(F.transform(F.sequence(F.lit(0), F.lit(400)), lambda i: F.when(i == 0, F.lit("_v")).otherwise(F.concat(F.lit("_v_"), i.cast("string")))), lambda x: ~F.array_contains("taken", x))
    named = rows.withColumn("scratch", F.get(options, F.col("nth") - 1)).filter("scratch IS NOT NULL")
    grp = F.concat_ws(":", F.lit("scratch"), "lo")
    head = edit(named, "scratch", "line_lo", "line_lo", F.concat("indent", F.lit("local "), "scratch", F.lit(" = vector()\n")), 0, grp, enabler=True)
    return head.unionByName(edit(named, "scratch", "lo", "hi", F.col("scratch"), 0, grp))


# -- latches that reset with every call


def local_latches(facts: DataFrame, b: DataFrame) -> DataFrame:
    """A flag meant to let something happen once, that is a local of the function and so starts anew with every call.

    The typestate of a flag over its body: it starts with a constant, is read in the test of a single
    `if` only (without other branches), and turned by that branch's last statement, after at least one
    other. No mention stands in a deeper loop than the declaration or in another function, nothing else
    writes it, and no declaration of the name follows.
    """
    flags = locals_of(b).filter("single AND func >= 0 AND made IN ('nil', 'false', 'true')").withColumn("starts", F.col("made") == "true")
    uses = uses_of(b).select(*VAR, "lo", "use", "captured", "at_lo", F.size("loops").alias("deep"), more("test").cast("int").alias("test"), more("single").alias("one"), more("value").alias("value"))
    met = flags.select(*VAR, "name", "line", "func", "starts", F.size("loops").alias("own")).join(uses, VAR)
    writes, reads = F.col("use") == "written", F.col("use") != "written"
    turned = F.when(F.col("value") == "true", True).when(F.col("value").isin("false", "nil"), False)
    by = met.groupBy(*VAR, "name", "line", "func").agg(
        F.count_if(writes).alias("writes"), F.count_if(reads).alias("reads"), F.bool_and(writes | F.col("test").isNotNull()).alias("tested"), F.min(F.when(reads, F.col("test"))).alias("test"),
        F.max(F.when(reads, F.col("test"))).alias("other"), F.bool_and(F.col("deep") == F.col("own")).alias("flat"), F.bool_or("captured").alias("captured"), F.min(F.when(writes, F.col("at_lo"))).alias("flip"),
        F.bool_and(reads | F.coalesce(F.col("one").isNotNull() & (turned != F.col("starts")), F.lit(False))).alias("turns"))
    good = by.filter("writes = 1 AND reads > 0 AND coalesce(tested, false) AND test = other AND flat AND NOT captured AND coalesce(turns, false)")
    guards = of(b, "if").filter((more("tests") == "1") & more("orelse").isNull() & (more("count").cast("int") >= 2)).select("path", F.col("lo").alias("test"), more("tail").cast("int").alias("flip"), F.col("line").alias("guard_line"), more("count").cast("int").alias("count"))
    again = of(b, "declare").select("path", "func", "name", F.col("lo").alias("later"))
    shadowed = good.join(again, ["path", "func", "name"]).filter("later > decl").select(*VAR).distinct()
    rows = good.join(guards, ["path", "test", "flip"]).join(shadowed, VAR, "left_anti")
    named = of(facts, "scope").select("path", F.col("lo").alias("func"), F.col("name").alias("function"), (more("frame").isNotNull() | more("hot").isNotNull()).alias("frame"))
    rows = rows.join(named, ["path", "func"])
    return finding(rows, "once_latch_local_to_function", "RED", F.format_string("%s starts anew with every call of %s", "name", "function"), {"flag": F.col("name"), "guard_line": F.col("guard_line"), "frame": F.col("frame"), "guarded": F.col("count") - 1})


# -- texts that grow in a loop


def grown_texts(b: DataFrame) -> DataFrame:
    """Texts that start empty and only grow in a loop of the same block: path, decl, name, at_lo, declared, loop, loop_hi, line, pays.

    From the declaration to the loop's end every mention is `s = s .. x` in the loop, in this function:
    nothing reads the text before the loop is done, so it may be put together then. `pays` unless the
    loop is a literal one of fewer than BREAK_EVEN rounds.
    """
    texts = locals_of(b).filter("single AND made = 'empty_text'").select(*VAR, "name", "func", "block", "at_lo", "declared", F.col("line").alias("init_line"))
    near = texts.join(loops_of(b), ["path", "func", "block"]).filter("loop >= declared AND ends_line AND loop_last > loop_line")
    uses = uses_of(b).select(*VAR, F.col("lo").alias("at"), "use", "captured", F.col("line").alias("use_line"))
    met = near.join(uses, VAR).filter("at < loop_hi")
    kept = (F.col("use") == "grown") & ~F.col("captured") & (F.col("at") > F.col("loop")) & (F.col("use_line") > F.col("loop_line")) & (F.col("use_line") < F.col("loop_last"))
    by = met.groupBy(*VAR, "name", "init_line", "at_lo", "declared", "loop", "loop_hi", "loop_line", "trips").agg(F.bool_and(kept).alias("only"), F.count(F.lit(1)).alias("sites"))
    return by.filter("only AND init_line < loop_line").withColumn("pays", F.coalesce("trips", F.lit(1 << 30)) >= R.BREAK_EVEN)


def parts_edits(files: DataFrame, b: DataFrame) -> DataFrame:
    """A text that grows in a loop is collected in a table and joined after it: three places that go together."""
    rows = grown_texts(b).filter("pays").join(names_taken(b), "path")
    named = rows.withColumns({"parts": free_name(F.concat(F.lit("_"), "name", F.lit("_parts")), F.col("taken")), "count": free_name(F.concat(F.lit("_"), "name", F.lit("_n")), F.col("taken"))})
    # Of several such loops after one text the first takes it; of several texts of one name only one can have its names.
    first = named.withColumn("__nth", F.row_number().over(R.Window.partitionBy("path", "name").orderBy("loop"))).filter("__nth = 1 AND parts IS NOT NULL AND count IS NOT NULL")
    grp = F.concat_ws(":", F.lit("parts"), "decl")
    head = edit(first, "parts", "at_lo", "declared", F.concat(F.lit("local "), "parts", F.lit(", "), "count", F.lit(" = {}, 0")), 50, grp, atomic=True)
    sites = uses_of(b).filter("use = 'grown'").select(*VAR, F.col("lo").alias("at"), F.col("at_lo").alias("from"), F.col("at_hi").alias("to"), more("value_lo").cast("int").alias("value_lo"), more("value_hi").cast("int").alias("value_hi"))
    texts = first.drop("at_lo").join(sites, VAR).filter("at > loop AND at < loop_hi").join(files.select("path", F.col("text").alias("source")), "path")
    value = F.substr("source", F.col("value_lo") + 1, F.col("value_hi") - F.col("value_lo"))
    each = edit(texts, "parts", "from", "to", F.concat("count", F.lit(" = "), "count", F.lit(" + 1; "), "parts", F.lit("["), "count", F.lit("] = "), value), 50, grp, atomic=True)
    before = F.substr("source", F.lit(1), "at_lo")
    indent = F.regexp_extract(before, r"(?:^|\n)([ \t]*)$", 1)
    tails = first.join(files.select("path", F.col("text").alias("source")), "path")
    tail = edit(tails, "parts", "loop_hi", "loop_hi", F.concat(F.lit("\n"), indent, F.lit("local "), "name", F.lit(" = table.concat("), "parts", F.lit(', "", 1, '), "count", F.lit(")")), 50, grp, enabler=True)
    return head.unionByName(each).unionByName(tail)


# -- reads that one local can hold

#: Names of the locals that hold repeated reads.
HELD_NAMES = {
    "time_global": "tg", "alife": "sim", "system_ini": "ini", "device": "dev", "get_console": "console", "get_hud": "hud", "game_ini": "g_ini", "getFS": "fs",
    "level.name": "level_name", "db.actor": "actor", "db.storage": "db_storage", "db.offline_objects": "db_offline_objects", "db.OnlineStalkers": "db_online_stalkers",
    "db.zone_by_name": "db_zone_by_name", "db.actor_binder": "db_actor_binder", "db.script_ids": "db_script_ids",
}
HELD_SUFFIXES = {"section": "sec", "id": "id", "clsid": "cls", "story_id": "sid", "name": "name", "section_name": "secname", "character_community": "comm", "profile_name": "profile"}


def read_sites(b: DataFrame) -> DataFrame:
    """path, func, name (as in `rules.repeated_reads`), getter, lo, hi, nest (block:statement from the body down), again."""
    rows = b.filter("func >= 0")
    calls = of(rows, "call").filter((more("args") == "0") & more("direct").isNotNull() & F.col("name").isin(*R.REPEATED_CALLS)).select("*", F.lit(False).alias("getter"))
    fields = of(rows, "field").filter(F.col("name").isin(*R.REPEATED_INDEXES)).select("*", F.lit(False).alias("getter"))
    getters = of(rows, "invoke").filter((more("args") == "0") & F.col("name").isin(*R.REPEATED_METHODS)).select("*", F.lit(True).alias("getter"))
    getters = getters.withColumn("name", F.concat(more("receiver"), F.lit(":"), "name", F.lit("()")))
    every = calls.unionByName(fields).unionByName(getters)
    return every.select("path", "func", "name", "getter", "lo", "hi", F.split(more("nest"), " ").alias("nest"), more("again").isNotNull().alias("again"))


def dominators(sites: DataFrame) -> DataFrame:
    """path, func, name, getter, at, direct, first, first_hi: the statement before which one read dominates all of a body's sites of a name.

    In a language of blocks, a statement dominates what comes after it in its block and below. The
    sites' nests agree down to the innermost block that holds them all; the first statement of that
    block with a site in it is the place. `direct`: the first site is evaluated by that statement
    itself, not by a block below it. Sites in tests that are read every round have no such place.
    """
    key = ["path", "func", "name"]
    blocks = F.transform("nest", lambda x: F.substring_index(x, ":", 1))
    by = sites.groupBy(*key).agg(
        F.min(F.size("nest")).alias("least"), F.array_sort(F.collect_list(F.struct("lo", "hi", "nest", blocks.alias("blocks")))).alias("sites"), F.bool_or("again").alias("again"), F.bool_or("getter").alias("getter"))  # of one body
    first = F.col("sites")[0]
    agree = F.filter(F.sequence(F.lit(0), F.col("least") - 1), lambda d: F.forall("sites", lambda s: F.slice(s["blocks"], 1, d + 1) == F.slice(first["blocks"], 1, d + 1)))
    deep = by.filter("NOT again AND least > 0").withColumn("level", F.array_max(agree)).filter("level IS NOT NULL")
    at = F.substring_index(F.get(first["nest"], F.col("level")), ":", -1).cast("int")
    return deep.select(*key, "getter", at.alias("at"), (F.size(first["nest"]) == F.col("level") + 1).alias("direct"), first["lo"].alias("first"), first["hi"].alias("first_hi"))


def held_reads(files: DataFrame, facts: DataFrame, b: DataFrame, severities: tuple[str, ...] = ("GREEN",)) -> DataFrame:
    """path, func, name, held (a free name), place, indent: repeated reads and where the local that holds them goes.

    Where the first read is only made on some way through its statement, a plain read goes to the start
    of the body, which dominates everything; a getter is left alone, as its receiver may be nil there.
    So is one behind `receiver and`, and one of a computed receiver. The place has to begin its line.
    """
    ids = of(facts, "scope").select("path", F.col("func").alias("id"), F.col("lo").alias("func"), more("body").cast("int").alias("body"))
    asked = R.repeated_reads(facts).filter(F.col("severity").isin(*severities)).select("path", F.col("func").alias("id"), "name").join(ids, ["path", "id"]).drop("id")
    found = asked.join(dominators(read_sites(b)), ["path", "func", "name"]).join(files.select("path", F.col("text").alias("source")), "path")
    receiver = F.substring_index("name", ":", 1)
    before = F.substr("source", F.col("at") + 1, F.col("first") - F.col("at"))
    guarded = F.regexp_replace(before, r"\s+", " ").contains(F.concat(receiver, F.lit(" and ")))
    found = found.filter(~F.col("getter") | F.col("direct") & ~guarded & ~receiver.rlike(r"[()\[\]]"))
    found = found.withColumn("at", F.when(F.col("direct"), F.col("at")).otherwise(F.col("body")))
    upto = F.substr("source", F.lit(1), "at")
    found = found.filter(upto.rlike(r"(^|\n)[ \t]*$")).withColumn("indent", F.regexp_extract(upto, r"(?:^|\n)([ \t]*)$", 1))
    plain = F.create_map(*[F.lit(x) for kv in HELD_NAMES.items() for x in kv])[F.col("name")]
    suffix = F.create_map(*[F.lit(x) for kv in HELD_SUFFIXES.items() for x in kv])[F.regexp_extract("name", r":(\w+)\(", 1)]
    base = F.when(F.col("getter"), F.concat(F.replace(receiver, F.lit("."), F.lit("_")), F.lit("_"), suffix)).otherwise(plain)
    named = found.join(names_taken(b), "path").withColumn("held", free_name(base, F.col("taken"))).filter("held IS NOT NULL")
    return named.select("path", "func", "name", "getter", "held", (F.col("at") - F.length("indent")).alias("place"), "indent")


def hold_edits(files: DataFrame, facts: DataFrame, b: DataFrame, severities: tuple[str, ...] = ("GREEN",)) -> DataFrame:
    """A local for each repeated read, put where it dominates all of them, and the reads through it."""
    held = stored(held_reads(files, facts, b, severities))
    grp = F.concat_ws(":", F.lit("hold"), "func", "name")
    value = F.when(F.col("getter") | F.col("name").isin(*R.REPEATED_INDEXES), F.col("name")).otherwise(F.concat("name", F.lit("()")))
    head = edit(held, "hold", "place", "place", F.concat("indent", F.lit("local "), "held", F.lit(" = "), value, F.lit("\n")), 100, grp, enabler=True)
    sites = read_sites(b).select("path", "func", "name", "lo", "hi").join(held.select("path", "func", "name", "held"), ["path", "func", "name"])
    return head.unionByName(edit(sites, "hold", "lo", "hi", F.col("held"), 0, grp))


def concatenation_in_loops(facts: DataFrame, b: DataFrame) -> DataFrame:
    """The findings of `rules.concatenation_in_loops`, safe only where nothing reads the text before the loop is done and the loop pays."""
    found = R.concatenation_in_loops(facts).withColumn("__loop", F.col("detail")["loop_line"].cast("int")).withColumn("__name", F.col("detail")["variable"])
    good = grown_texts(b).groupBy("path", F.col("name").alias("__name"), F.col("loop_line").alias("__loop")).agg(F.bool_or("pays").alias("__pays"))
    rows = found.join(good, ["path", "__name", "__loop"], "left")
    safe = F.map_from_arrays(F.array(F.lit("safe"), F.lit("pays")), F.array(F.col("__pays").isNotNull() & F.coalesce("__pays", F.lit(False)), F.coalesce("__pays", F.lit(False))).cast("array<string>"))
    detail = F.map_concat(F.map_filter("detail", lambda k, _: k != "safe"), safe)
    return rows.withColumn("detail", detail).select(*R.FINDING)


PROVEN = {"pairs_to_ipairs": pairs_to_ipairs, "append_loop_counter": append_loop_counter, "vectors_in_loops": vectors_in_loops, "local_latches": local_latches}


def proven_findings(facts: DataFrame, b: DataFrame, rules: list[str] | None = None) -> DataFrame:
    """Findings of the rules that need proofs; both tables should be stored ones."""
    parts = [PROVEN[r](facts, b) for r in rules or PROVEN]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def proven_edits(files: DataFrame, facts: DataFrame, b: DataFrame, yellow: bool = False) -> DataFrame:
    """All edits that are safe; with `yellow` also counters, scratch vectors and parts, each claim with one winner."""
    if not yellow:
        return edits_of(facts).unionByName(ipairs_edits(facts, b)).unionByName(hold_edits(files, facts, b))
    plain = edits_of(facts, tuple(k for k in SAFE if k != "append")).unionByName(ipairs_edits(facts, b)).unionByName(hold_edits(files, facts, b, ("GREEN", "YELLOW")))
    return plain.unionByName(arbitrated(facts, files, b)).unionByName(scratch_edits(b)).unionByName(parts_edits(files, b))
