"""Facts of a whole program: modules, what they export, and which function each call means.

A script is a module named after its file. A function at its top that is not local is reachable as
`module.name` from everywhere and as `name` in its own file; those of the special modules are global.
A dotted name is only known under itself. The first definition wins (by path, then by place);
whether there were others is kept. Everything is joins by name, so no script's table goes to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import graphs as G
from .facts import HOT, PER_FRAME, PER_FRAME_METHODS
from .rules import of

#: Modules whose functions are global.
SPECIAL = ("_g", "_g_patches")


def module(path: Column) -> Column:
    """The module of a script's path: the file's name without its ending, in lower case."""
    return F.lower(F.regexp_replace(F.element_at(F.split(path, r"[/\\]"), -1), r"\.[^.]*$", ""))


def functions(b: DataFrame) -> DataFrame:
    """node, path, module, name, line, top, open: every function; open ones at the top can be called by others."""
    rows = of(b, "function").select("path", "name", "line", F.col("lo").alias("at"), F.col("func").alias("within"), (F.col("use") == "open").alias("open"))
    return rows.select(F.concat_ws("#", "path", "at").alias("node"), "path", module(F.col("path")).alias("module"), "name", "line", "at", (F.col("within") < 0).alias("top"), "open")


def exports(b: DataFrame) -> DataFrame:
    """module, path, name, node, definitions: of each module's names the first definition, and how many there are.

    Of several files of one module's name the first by path is the module.
    """
    fs = functions(b).filter("top AND open AND name IS NOT NULL AND NOT contains(name, ':')")
    owner = functions(b).groupBy("module").agg(F.min("path").alias("path"))
    first = F.min_by("node", F.struct("path", "at"))
    return fs.join(owner, ["module", "path"]).groupBy("module", "path", "name").agg(first.alias("node"), F.count(F.lit(1)).alias("definitions"))


def global_functions(b: DataFrame, special: tuple[str, ...] = SPECIAL) -> DataFrame:
    """name, node, definitions: what the special modules define is called by its name alone."""
    rows = exports(b).filter(F.col("module").isin(*special) & ~F.col("name").contains("."))
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, special)), F.col("module")), F.lit(0))
    return rows.groupBy("name").agg(F.min_by("node", rank).alias("node"), F.sum("definitions").alias("definitions"))


def called(b: DataFrame) -> DataFrame:
    """src, path, form (bare, qualified, method, value), name, n: what each function calls; calls at a script's top run once and are left out."""
    plain = of(b, "call").filter("func >= 0").select("path", "func", F.when(F.col("name").isNull(), "value").when(F.col("name").contains("."), "qualified").otherwise("bare").alias("form"), "name")
    methods = of(b, "invoke").filter("func >= 0").select("path", "func", F.lit("method").alias("form"), "name")
    return plain.unionByName(methods).groupBy(F.concat_ws("#", "path", "func").alias("src"), "path", "form", "name").agg(F.count(F.lit(1)).alias("n"))


def call_edges(b: DataFrame, special: tuple[str, ...] = SPECIAL) -> DataFrame:
    """src, name, n, dst, kind, ambiguous: the calls with the function they mean.

    Kinds: same-file (a function of the file's top, local or not, also under a dotted name), global,
    module, and what can't be told: method, value (a computed one), unresolved.
    """
    calls = called(b)
    own = functions(b).filter("top AND name IS NOT NULL AND NOT contains(name, ':')").groupBy("path", "name").agg(F.min_by("node", "at").alias("here"), F.count(F.lit(1)).alias("own_defs"))
    shared = global_functions(b, special).select("name", F.col("node").alias("shared"), F.col("definitions").alias("shared_defs"))
    other = exports(b).filter(~F.col("name").contains(".")).select(F.concat_ws(".", "module", "name").alias("qualified"), F.col("node").alias("there"), F.col("definitions").alias("other_defs"))
    # Modules are told without regard to case, their functions with it.
    spelled = F.concat_ws(".", F.lower(F.substring_index("name", ".", 1)), F.expr("substr(name, instr(name, '.') + 1)"))
    met = calls.withColumn("qualified", F.when(F.col("form") == "qualified", spelled)).join(own, ["path", "name"], "left").join(shared, "name", "left").join(other, "qualified", "left")
    known = F.col("form").isin("bare", "qualified")
    kind = (
        F.when(F.col("form") == "method", "method").when(F.col("form") == "value", "value").when(known & F.col("here").isNotNull(), "same-file")
        .when((F.col("form") == "bare") & F.col("shared").isNotNull(), "global").when(F.col("there").isNotNull(), "module").otherwise("unresolved")
    )
    dst = F.when(kind == "same-file", F.col("here")).when(kind == "global", F.col("shared")).when(kind == "module", F.col("there"))
    defs = F.when(kind == "same-file", F.col("own_defs")).when(kind == "global", F.col("shared_defs")).when(kind == "module", F.col("other_defs"))
    return met.select("src", "name", "n", dst.alias("dst"), kind.alias("kind"), F.coalesce(defs > 1, F.lit(False)).alias("ambiguous"))


def frame_seeds(b: DataFrame) -> DataFrame:
    """node, origin: functions that run every frame by their name, or that are registered for such an event."""
    fs = functions(b)
    last = F.regexp_extract("name", r"([^.:]*)$", 1)
    frame = F.col("name").contains(":") & last.isin(*PER_FRAME_METHODS) | last.isin(*PER_FRAME) | last.endswith("_on_update") & ~last.contains("first_update")
    registered = of(b, "register").filter(F.col("use").isin(*PER_FRAME)).select("path", "name")
    return G.seeds(fs.filter(frame).select("node"), fs.filter("top").join(registered, ["path", "name"], "left_semi").select("node"))


def frame_reach(b: DataFrame, hops: int, kinds: list[str] | None = None) -> DataFrame:
    """node, hop, via: what runs every frame within so many calls."""
    edges = call_edges(b).filter("dst IS NOT NULL").select("src", "dst", "kind")
    return G.reach(frame_seeds(b).select("node"), edges, hops, kinds)


def unused_exports(b: DataFrame, special: tuple[str, ...] = SPECIAL) -> DataFrame:
    """path, module, name, node: open functions that nothing in any script names.

    A use is the bare name in the own file (anywhere for the special modules), `module.name` anywhere,
    or a registration; callbacks that the engine calls by name are in use.
    """
    made = exports(b).filter(~F.col("name").contains(".") & ~F.col("name").isin(*HOT, *PER_FRAME))
    bare = of(b, "use").filter("decl = -1 AND use != 'written'").select("path", "name").distinct()
    registered = of(b, "register").select("path", "name").distinct()
    fields = of(b, "field").select(F.lower(F.substring_index("name", ".", 1)).alias("module"), F.get(F.split("name", r"\."), F.lit(1)).alias("name")).distinct()
    left = made.join(bare.unionByName(registered), ["path", "name"], "left_anti").join(fields, ["module", "name"], "left_anti")
    everywhere = bare.select("name").distinct().withColumn("__used", F.lit(True))
    left = left.join(everywhere, "name", "left").filter(~(F.col("module").isin(*special) & F.col("__used").isNotNull()))
    return left.select("path", "module", "name", "node")
