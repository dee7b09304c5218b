"""Lint rules over code facts, each a DataFrame of findings.

A finding: path, pattern, severity (GREEN can be rewritten safely, YELLOW with care, RED is for people,
DEBUG marks debug output), line, message, detail (a map), lo, hi. Rules only filter, aggregate and
join facts by script and scope, so no rule needs more than one script's rows together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.sequences import max_path
from .facts import HOT, MAY_BE_NIL, PER_FRAME

FINDING = ["path", "pattern", "severity", "line", "message", "detail", "lo", "hi"]
THRESHOLD = 4
RULES: dict[str, Callable[[DataFrame], DataFrame]] = {}

#: Globals and library functions that are worth a local.
CACHEABLE = ("pairs", "ipairs", "next", "type", "tostring", "tonumber", "unpack", "select", "rawget", "rawset")
CACHEABLE_OF = {
    "math": "floor ceil abs min max sqrt sin cos tan random pow log exp atan2 atan asin acos deg rad fmod modf huge".split(),
    "string": "find sub gsub match gmatch format lower upper len rep byte char reverse".split(),
    "table": "insert remove concat sort getn unpack".split(),
    "bit": "band bor bxor bnot lshift rshift arshift rol ror".split(),
}
#: Functions with a rewrite of their own, debug output, calls and properties worth a local.
REPLACED = ("table.insert", "table.getn", "string.len")
DEBUG = ("print", "printf", "printe", "printd", "log", "log1", "log2", "log3", "DebugLog", "debug_log", "trace", "dump")
REPEATED_CALLS = ("alife", "system_ini", "game_ini", "getFS", "device", "get_console", "get_hud", "level.name", "time_global")
REPEATED_INDEXES = ("db.actor", "db.storage", "db.offline_objects", "db.OnlineStalkers", "db.zone_by_name", "db.actor_binder", "db.script_ids")
REPEATED_METHODS = {"section": "GREEN", "id": "GREEN", "clsid": "GREEN", "story_id": "GREEN", "name": "GREEN", "section_name": "GREEN", "character_community": "YELLOW", "profile_name": "YELLOW"}
CLOCK_THRESHOLD = 2
#: What a callback that runs every frame should not call.
DEAR = (
    "pairs", "ipairs", "string.find", "string.match", "string.gmatch", "string.gsub", "string.format", "table.sort", "table.concat", "io.open", "io.read",
    "io.write", "os.execute", "alife", "alife_object", "level.object_by_id", "simulation_objects", "get_story_object", "get_object_by_name",
)
#: Library functions and engine calls that end a compiled trace.
ABORTING = (
    "pairs", "next", "unpack", "error", "newproxy", "loadstring", "dofile", "collectgarbage", "print", "string.format", "string.find", "string.match",
    "string.gmatch", "string.gfind", "string.gsub", "string.rep", "string.upper", "string.lower", "string.reverse", "string.char", "table.concat",
    "table.sort", "table.foreach", "table.foreachi", "math.fmod", "math.randomseed", "os.clock", "os.time", "os.date", "os.getenv", "io.open",
    "io.lines", "coroutine.create", "coroutine.resume", "coroutine.yield", "coroutine.wrap",
)
ABORTING_FROM = {"table.insert": 3, "table.remove": 2}
ENGINE_SPACES = ("level", "game", "alife", "device", "relation_registry", "game_graph", "actor_stats", "main_menu", "utils_xml", "ui_events")
ENGINE_GLOBALS = (
    "time_global", "alife", "get_console", "get_hud", "device", "level_object_by_id", "system_ini", "game_ini", "create_ini_file", "alife_object",
    "alife_create", "alife_release", "get_safe_sound_object", "sound_object", "vector", "vector2", "CScriptXmlInit", "GetARGB", "GetFontLetterica16Russian",
)
#: Methods that call into the engine.
ENGINE_METHODS = (
    "position", "direction", "health", "set_health", "id", "section", "section_name", "profile_name", "clsid", "name", "alive", "parent", "level_vertex_id",
    "game_vertex_id", "object", "best_enemy", "best_danger", "best_item", "active_item", "active_detector", "active_slot", "item_in_slot", "get_enemy",
    "get_current_outfit", "character_community", "character_rank", "inventory_for_each", "iterate_inventory", "give_info_portion", "has_info",
    "disable_info_portion", "transfer_item", "transfer_money", "r_string", "r_float", "r_u32", "r_s32", "r_bool", "r_line", "line_count", "section_exists",
    "line_exists", "distance_to", "distance_to_sqr", "distance_to_xz", "distance_to_center", "set", "add", "sub", "mul", "div", "normalize", "magnitude",
    "execute", "get_float", "get_integer", "get_bool", "story_object", "story_id", "clear_abuse", "accessible",
)
PATTERN_MARKS = r"[\^$().%\[\]*+\-?]"
EMPTY_TEXTS = ('""', "''", "[[]]")
BREAK_EVEN = 30


def rule(f: Callable) -> Callable:
    RULES[f.__name__] = f
    return f


def of(facts: DataFrame, kind: str) -> DataFrame:
    return facts.filter(F.col("kind") == kind)


def more(name: str) -> Column:
    return F.col("more")[name]


def finding(rows: DataFrame, pattern: Column | str, severity: Column | str, message: Column, detail: dict[str, Column] | None = None) -> DataFrame:
    as_column = lambda c: F.lit(c) if isinstance(c, str) else c
    pairs = [x for k, v in (detail or {}).items() for x in (F.lit(k), v.cast("string"))]
    details = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    place = [F.col(c) if c in rows.columns else F.lit(None).cast("int").alias(c) for c in ("lo", "hi")]
    return rows.select("path", as_column(pattern).alias("pattern"), as_column(severity).alias("severity"), "line", message.alias("message"), details.alias("detail"), *place)


def functions(facts: DataFrame) -> DataFrame:
    """path, func, function, start, end, frame, hot: a row a function body."""
    return of(facts, "scope").select(
        "path", "func", F.col("name").alias("function"), F.col("line").alias("start"), F.col("last").alias("end"), more("frame").isNotNull().alias("frame"), more("hot").isNotNull().alias("hot")
    )


@rule
def lengths(facts):
    """table.getn(t) and string.len(s) are #t and #s."""
    calls = of(facts, "call").filter(F.col("name").isin("table.getn", "string.len") & (F.size("args") == 1))
    pattern = F.when(F.col("name") == "table.getn", "table_getn").otherwise("string_len")
    arg = F.col("args")[0]
    return finding(calls, pattern, "GREEN", F.format_string("%s(%s) is #%s", "name", arg, arg), {"operand": arg})


@rule
def powers(facts):
    """math.pow with an exponent of 0.5, or of 2, 3 or 4 and a base that may be repeated."""
    calls = of(facts, "call").filter((F.col("name") == "math.pow") & (F.size("args") == 2) & (F.col("kinds")[1] == "number"))
    exponent = F.element_at(F.split(more("numbers"), ","), 2).cast("double")
    root = (exponent == 0.5) & more("negative").isNull()
    product = exponent.isin(2.0, 3.0, 4.0) & F.col("kinds")[0].isin("name", "number")
    return finding(calls.filter(root | product), "math_pow_simple", "GREEN", F.concat(F.lit("math.pow to "), F.when(root, "math.sqrt").otherwise("a product")), {"base": F.col("args")[0], "exponent": exponent})


@rule
def power_operators(facts):
    """x ^ 2 and x ^ 3 of a base that may be repeated, and x ^ 0.5."""
    rows = of(facts, "pow").withColumn("e", more("exponent").cast("double"))
    root = (F.col("e") == 0.5) & more("negative").isNull()
    product = F.col("e").isin(2.0, 3.0) & more("base").isin("name", "number")
    pattern = F.when(root, "pow_op_sqrt").otherwise("pow_op_simple")
    return finding(rows.filter(root | product), pattern, "GREEN", F.concat("name", F.lit("^"), more("exponent")), {"base": F.col("name"), "exponent": F.col("e")})


@rule
def literal_concatenation(facts):
    """A chain of string literals only."""
    return finding(of(facts, "concat"), "string_literal_concat", "GREEN", F.lit("string literals can be one"), {"text": more("text")})


@rule
def plain_find(facts):
    """string.find for a literal without pattern marks, with no plain flag yet."""
    calls = of(facts, "call").filter((F.col("name") == "string.find") & F.size("args").between(2, 3) & (F.col("kinds")[1] == "string"))
    return finding(calls.filter(~more("second").rlike(PATTERN_MARKS)), "string_find_plain", "GREEN", F.concat(F.lit("plain search for "), more("second")), {"arguments": F.size("args")})


@rule
def negated_equality(facts):
    """not (a == b) is a ~= b, and the other way."""
    other = F.when(F.col("name") == "==", "~=").otherwise("==")
    return finding(of(facts, "not_eq"), "redundant_not_eq", "GREEN", F.concat_ws(" ", more("left"), other, more("right")), {"operator": other})


def uncached_calls(facts: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """path, func, name, calls, worst of library functions that a body may call `threshold` times or more on one path (one less in hot callbacks)."""
    cacheable = [*CACHEABLE, *(f"{m}.{f}" for m, fs in CACHEABLE_OF.items() for f in fs)]
    calls = of(facts, "call").filter(F.col("name").isin([n for n in cacheable if n not in REPLACED]) & (F.col("func") >= 0) & more("alias").isNull() & more("bound").isNull() & more("method").isNull())
    counted = max_path(calls, ["path", "func", "name"], "chain")
    held = of(facts, "assign").filter(more("local").isNotNull() & more("value_kind").isin("name", "index")).select("path", "func", more("value").alias("name"))
    bodies = functions(facts)
    return counted.join(held, ["path", "func", "name"], "left_anti").join(bodies, ["path", "func"]).filter(F.col("worst") >= F.when(F.col("hot"), threshold - 1).otherwise(threshold))


@rule
def uncached_globals(facts):
    """One finding a function: the library functions that are worth a local, and how often each is called."""
    by = uncached_calls(facts).groupBy("path", "func", "function", F.col("start").alias("line"), "hot").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "flat")))).alias("calls"))
    return finding(by, "uncached_globals_summary", "GREEN", F.format_string("cache %d globals in %s", F.size("calls"), "function"), {"globals": F.to_json("calls"), "hot": F.col("hot")})


def unwarned_chains(facts: DataFrame) -> DataFrame:
    """path, func, name of calls that may give nil and are used through a chain that nothing warns of.

    Held in a local, the chain would be warned of; so such calls stay as they are.
    """
    chains = of(facts, "call").filter(more("method").isNotNull() & more("module").endswith("()")).withColumn("held", F.expr("substr(more['module'], 1, length(more['module']) - 2)"))
    return chains.filter(F.col("held").isin(*MAY_BE_NIL) & ~F.col("name").isin(*MAY_BE_NIL)).select("path", "func", F.col("held").alias("name")).distinct()


def repeated_reads(facts: DataFrame) -> DataFrame:
    """path, func, name, flat, worst, line, severity, function, hot: engine calls without arguments, getters and properties that a body repeats often enough, unless what they are read from is rebound."""
    calls = of(facts, "call").filter((F.size("args") == 0) & (F.col("func") >= 0))
    plain = calls.filter(F.col("name").isin(*REPEATED_CALLS) & more("bound").isNull()).select("path", "func", "name", "line", "chain", F.lit("GREEN").alias("severity"))
    grade = F.create_map(*[F.lit(x) for kv in REPEATED_METHODS.items() for x in kv])[more("func")]
    getters = calls.filter(more("method").isNotNull() & more("func").isin(*REPEATED_METHODS)).select("path", "func", F.concat("name", F.lit("()")).alias("name"), "line", "chain", grade.alias("severity"))
    reads = of(facts, "index").filter(F.col("name").isin(*REPEATED_INDEXES) & (F.col("func") >= 0)).select("path", "func", "name", "line", "chain", F.lit("GREEN").alias("severity"))
    sites = plain.unionByName(getters).unionByName(reads)
    key = ["path", "func", "name"]
    counted = max_path(sites, key, "chain").join(sites.groupBy(*key).agg(F.min("line").alias("line"), F.min("severity").alias("severity")), key)
    # Rebinding either end of the receiver after the first read makes a held value stale.
    receiver = F.substring_index("name", ":", 1)
    named = counted.withColumn("ends", F.when(F.locate("(", receiver) == 0, F.array_distinct(F.array(receiver, F.substring_index(receiver, ".", 1)))))
    writes = of(facts, "assign").select("path", "func", F.col("name").alias("end"), F.col("line").alias("at"))
    stale = named.select(*key, "line", F.explode("ends").alias("end")).join(writes, ["path", "func", "end"]).filter("at >= line").select(*key).distinct()
    least = F.when(F.col("name") == "time_global", CLOCK_THRESHOLD).otherwise(F.when(F.col("hot"), THRESHOLD - 1).otherwise(THRESHOLD))
    kept = named.join(stale, key, "left_anti").join(functions(facts), ["path", "func"]).filter(F.col("worst") >= least)
    return kept.join(unheld_clocks(facts), key, "left_anti").join(unwarned_chains(facts), key, "left_anti")


@rule
def repeated(facts):
    """Reads that a body repeats and one local could hold."""
    kept = repeated_reads(facts)
    pattern = F.concat(F.lit("repeated_"), F.regexp_replace("name", "[.:]", "_"))
    return finding(kept, pattern, F.col("severity"), F.format_string("%s read %dx in %s", "name", "flat", "function"), {"count": F.col("flat"), "worst": F.col("worst")})


def unheld_clocks(facts: DataFrame) -> DataFrame:
    """path, func, name of bodies whose readings of the frame clock must not share one value.

    Such bodies yield (a coroutine call), run a while or repeat, return on some path before the
    clock is first read, measure their own time, or read it on some paths only.
    """
    key = ["path", "func"]
    reads = of(facts, "call").filter((F.col("name") == "time_global") & (F.size("args") == 0)).groupBy(*key).agg(F.min("lo").alias("first"), F.min(F.when(F.size("chain") == 0, F.col("lo"))).alias("sure"))
    yields = of(facts, "call").filter(F.col("name").startswith("coroutine.")).select(*key)
    loops = of(facts, "loop").filter(F.col("name").isin("while", "repeat")).select(*key)
    early = of(facts, "leave").filter(F.size("chain") > 0).select(*key, "lo").join(reads, key).filter(F.col("lo") < F.coalesce("sure", "first")).select(*key)
    # Only a stamp that was taken before the difference measures the body's own time; one taken after it is a throttle.
    held = of(facts, "assign").filter(more("value") == "time_global()").select(*key, "name", F.col("lo").alias("taken"))
    timed = of(facts, "elapsed").select(*key, "name", "lo").join(held, [*key, "name"]).filter("taken < lo").select(*key)
    some = reads.filter("sure IS NULL").select(*key)
    bad = yields.unionByName(loops).unionByName(early).unionByName(timed).unionByName(some).distinct()
    return bad.select(*key, F.lit("time_global").alias("name"))


def trips(line: Column) -> Column:
    """How often a `for` with literal bounds runs, else null."""
    number = r"(-?\d+)"
    shape = rf"^\s*for\s+\w+\s*=\s*{number}\s*,\s*{number}\s*(?:,\s*{number}\s*)?do\b"
    part = lambda i: F.expr("null") if i is None else F.regexp_extract(line, shape, i)
    step = F.coalesce(F.nullif(part(3), F.lit("")).cast("long"), F.lit(1).cast("long"))
    first, last = F.nullif(part(1), F.lit("")).cast("long"), F.nullif(part(2), F.lit("")).cast("long")
    return F.when(step != 0, F.greatest(F.lit(0), F.floor((last - first) / step) + 1))


@rule
def concatenation_in_loops(facts):
    """s = s .. x in a loop; safe to rewrite in a loop of its own right after the empty local, in the same scope."""
    sites = of(facts, "self_concat").withColumn("first", F.row_number().over(Window.partitionBy("path", "scope", "name").orderBy("lo")))
    sites = sites.filter("first = 1").withColumn("loop_line", more("loop_line").cast("int")).withColumn("outer", more("outer").cast("int"))
    empty = of(facts, "assign").filter(more("local").isNotNull() & more("value").isin(*EMPTY_TEXTS) & (F.col("depth") == 0)).select("path", "name", F.col("scope").alias("outer"), F.col("line").alias("init"))
    near = sites.join(empty, ["path", "name", "outer"], "left").withColumn("init", F.when((F.col("init") < F.col("loop_line")) & (F.col("init") >= F.col("loop_line") - 3) & (F.col("depth") == 1), F.col("init")))
    one = near.groupBy("path", "line", "name", "lo", "hi", "loop_line", "depth").agg(F.max("init").alias("init"))
    return finding(one, "string_concat_in_loop", "YELLOW", F.concat("name", F.lit(" grows in a loop")), {"variable": F.col("name"), "safe": F.col("init").isNotNull(), "loop_line": F.col("loop_line")})


@rule
def debug_output(facts):
    """Calls of debug functions; math.log is none."""
    calls = of(facts, "call").filter(more("func").isin(*DEBUG) & ~F.col("name").startswith("math."))
    return finding(calls, "debug_statement", "DEBUG", F.concat(F.lit("debug call of "), more("func")), {"function": more("func")})


@rule
def global_writes(facts, module_level: bool = False):
    """A name's writes in a script, grouped: in functions without a definition at the script's top (a forgotten local?); with `module_level` also those of the script's own globals."""
    own = of(facts, "module_name").select("path", "name").distinct().withColumn("own", F.lit(True))
    writes = of(facts, "global_write").filter(~F.col("name").startswith("_") & (F.upper("name") != F.col("name"))).join(own, ["path", "name"], "left")
    accidental = (F.col("func") >= 0) & F.col("own").isNull()
    grouped = writes.withColumn("accidental", accidental).groupBy("path", "name", "accidental").agg(F.min("line").alias("line"), F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("line")).alias("lines"))
    if not module_level:
        grouped = grouped.filter("accidental")
    pattern = F.when(F.col("accidental"), "global_write").otherwise("module_global_write")
    shown = F.concat_ws(", ", F.slice("lines", 1, 8))
    return finding(grouped, pattern, "RED", F.concat("name", F.lit(" written on lines "), shown), {"count": F.col("n"), "lines": F.to_json("lines")})


@rule
def dead_code(facts):
    """Statements after a return or break, and bodies under a literal false or nil."""
    after = finding(of(facts, "dead"), F.concat(F.lit("dead_code_after_"), F.col("name")), "GREEN", F.format_string("lines %d to %d are never reached", "line", "last"), {"statements": more("count")})
    never = of(facts, "constant").filter(more("value").isin("false", "nil") & ((F.col("name") == "while") | more("branches").isNull()))
    return after.unionByName(finding(never, F.concat(F.lit("dead_code_"), F.col("name"), F.lit("_false")), "GREEN", F.format_string("lines %d to %d never run", "line", "last"), {"end": F.col("last")}))


@rule
def needless_else(facts):
    """An else after a body that always returns or breaks."""
    return finding(of(facts, "needless_else"), "unnecessary_else", "YELLOW", F.lit("else after return or break"), {"if_line": more("if_line")})


@rule
def constant_conditions(facts):
    """if or while on a literal that counts as true; `while true` is meant."""
    rows = of(facts, "constant").filter(more("value").isin("true", "number", "string") & ~((F.col("name") == "while") & (more("value") == "true")))
    return finding(rows, "constant_condition", "YELLOW", F.concat_ws(" ", "name", F.lit("on a literal"), more("value")), {"where": F.col("name")})


@rule
def unused_locals(facts):
    """Locals that nothing reads; loop variables, parameters and registered callbacks aside."""
    never = of(facts, "local").filter((more("reads") == "0") & more("what").isin("variable", "function"))
    registered = of(facts, "register").select("path", "name").distinct()
    left = never.join(registered, ["path", "name"], "left_anti").filter((more("what") == "variable") | ~F.col("name").isin(*HOT, *PER_FRAME))
    return finding(left, F.concat(F.lit("unused_local_"), more("what")), "YELLOW", F.concat("name", F.lit(" is never read in "), more("within")), {"name": F.col("name")})


@rule
def distances(facts):
    """distance_to against a number: the square needs no root."""
    square = F.pow(more("threshold").cast("double"), F.lit(2.0))
    text = F.when(square == F.floor(square), F.floor(square).cast("string")).otherwise(F.regexp_replace(F.format_string("%.6g", square), r"\.?0+$", ""))
    return finding(of(facts, "distance"), "distance_to_comparison", "GREEN", F.concat("name", F.lit(":distance_to_sqr("), more("target"), F.lit(") "), more("op"), F.lit(" "), text), {"squared": text, "op": more("op")})


def aborting_sites(facts: DataFrame) -> DataFrame:
    """path, func, line, chain, reason: what ends a compiled trace, by exact name, by name and arguments, by namespace, by global, by method; and concatenations, and closures made in loops."""
    calls = of(facts, "call").filter(more("bound").isNull() & more("method").isNull())
    many = F.lit(False)
    for name, least in ABORTING_FROM.items():
        many = many | (F.col("name") == name) & (F.size("args") >= least)
    reason = (
        F.when(F.col("name").isin(*ABORTING), F.concat(F.lit("library: "), "name"))
        .when(many, F.concat(F.lit("library, by arguments: "), "name"))
        .when(more("module").isin(*ENGINE_SPACES) | more("module").isNull() & F.col("name").isin(*ENGINE_GLOBALS), F.concat(F.lit("engine: "), "name"))
    )
    named = calls.select("path", "func", "line", "chain", reason.alias("reason")).filter("reason IS NOT NULL")
    other = facts.filter(F.col("kind").isin("join", "closure")).select("path", "func", "line", "chain", F.when(F.col("kind") == "join", "concatenation").otherwise("closure in a loop").alias("reason"))
    methods = of(facts, "call").filter(more("method").isNotNull() & (more("func").isin(*ENGINE_METHODS) | more("module").isin(*ENGINE_SPACES))).select("path", "func", "line", "chain", F.concat(F.lit("engine: :"), more("func")).alias("reason"))
    return named.unionByName(other).unionByName(methods).filter("func >= 0")


def body_modes(facts: DataFrame) -> DataFrame:
    """Every body's mode: compiled without aborting sites, interpreted with one on every path, else mixed; reasons by frequency, distinct lines."""
    sites = aborting_sites(facts)
    by_reason = sites.groupBy("path", "func", "reason").agg(F.count(F.lit(1)).alias("n")).groupBy("path", "func").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("minus"), "reason"))), lambda x: x["reason"]).alias("reasons"))
    totals = sites.groupBy("path", "func").agg(F.count(F.lit(1)).alias("sites"), F.bool_or(F.size("chain") == 0).alias("always"), F.sort_array(F.collect_set("line")).alias("lines"))
    joined = functions(facts).join(totals, ["path", "func"], "left").join(by_reason, ["path", "func"], "left")
    mode = F.when(F.col("sites").isNull(), "compiled").when(F.col("always"), "interpreted").otherwise("mixed")
    return joined.withColumn("mode", mode).withColumn("sites", F.coalesce("sites", F.lit(0)))


@rule
def trace_modes(facts):
    """Bodies that run every frame and can't be compiled as a whole."""
    rows = body_modes(facts).filter("frame AND mode != 'compiled'").withColumn("line", F.col("start"))
    return finding(rows, "jit_mode", "RED", F.concat("function", F.lit(" runs "), "mode", F.lit(": "), F.concat_ws(", ", F.slice("reasons", 1, 3))), {"mode": F.col("mode"), "sites": F.col("sites")})


@rule
def per_frame_callbacks(facts):
    """Bodies that run every frame: loops, dear calls, and library functions called twice or more without a local."""
    frame = functions(facts).filter("frame")
    bodies = frame.select("path", "func")
    calls = of(facts, "call").join(bodies, ["path", "func"], "left_semi")
    dear = calls.filter(F.col("name").isin(*DEAR) | more("func").isin(*DEAR)).groupBy("path", "func").agg(F.count(F.lit(1)).alias("dear"))
    cacheable = F.col("name").isin(*CACHEABLE) | more("module").isin(*CACHEABLE_OF)
    twice = calls.filter(cacheable & more("alias").isNull()).groupBy("path", "func", "name").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").groupBy("path", "func").agg(F.count(F.lit(1)).alias("uncached"))
    deep = facts.join(bodies, ["path", "func"], "left_semi").groupBy("path", "func").agg(F.max("depth").alias("loops"))
    joined = frame
    for part in (dear, twice, deep):
        joined = joined.join(part, ["path", "func"], "left")
    joined = joined.fillna(0, ["dear", "uncached", "loops"]).withColumn("line", F.col("start"))
    severity = F.when((F.col("dear") > 0) | (F.col("loops") > 0), "RED").when(F.col("uncached") > 0, "YELLOW").otherwise("DEBUG")
    return finding(joined, "per_frame_callback", severity, F.concat("function", F.lit(" runs every frame")), {"dear": F.col("dear"), "uncached": F.col("uncached"), "loops": F.col("loops") > 0})


@rule
def appends(facts):
    """table.insert(t, v) is t[#t + 1] = v, unless a local name of table.insert would be left without a reader."""
    calls = of(facts, "call").filter((F.col("name") == "table.insert") & (F.size("args") == 2))
    by_alias = calls.filter(more("alias").isNotNull()).groupBy("path", more("alias").alias("alias")).agg(F.count(F.lit(1)).alias("n"))
    reads = of(facts, "local").groupBy("path", F.col("name").alias("alias")).agg(F.sum(more("reads").cast("long")).alias("reads"))
    orphaned = by_alias.join(reads, ["path", "alias"]).filter("n >= reads").select("path", "alias")
    left = calls.withColumn("alias", more("alias")).join(orphaned, ["path", "alias"], "left_anti")
    t = F.col("args")[0]
    return finding(left, "table_insert_append", "GREEN", F.concat(t, F.lit("[#"), t, F.lit(" + 1] = "), F.col("args")[1]), {"table": t, "value": F.col("args")[1]})


@rule
def nil_accesses(facts):
    """Uses of a local that may be nil, with no test on the way; safe to wrap on the next line, if nothing else uses it."""
    rows = of(facts, "nil_access")
    return finding(rows, "potential_nil_access", "YELLOW", F.concat("name", F.lit(" from "), more("source"), F.lit(" is used without a test")), {"source": more("source"), "safe": more("safe").isNotNull(), "others": more("others")})


def findings(facts: DataFrame, rules: list[str] | None = None) -> DataFrame:
    """All findings of the named rules (of all rules); `facts` should be a stored table, as every rule reads it."""
    parts = [RULES[r](facts) for r in rules or RULES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
