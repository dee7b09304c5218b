"""Censuses over code facts: listeners that change their own event, repeated reads, debug calls and what their removal risks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rules as R
from .program import functions
from .rules import more, of

_QUOTES = "\"'"


def self_churn(facts: DataFrame, b: DataFrame) -> DataFrame:
    """path, event, listener, line, op: listeners that register or unregister for the event they are registered for.

    The listener is a function at the top of the same script; the call stands in its body. Intervals
    meet by script and event first, so only calls for that event are looked into.
    """
    registered = of(b, "register").select("path", F.col("name").alias("listener"), F.col("use").alias("event")).distinct()
    bodies = of(b, "function").filter("func < 0").select("path", F.col("name").alias("listener"), F.col("lo").alias("from"), F.col("hi").alias("to"))
    calls = of(facts, "call").filter(F.col("name").isin("RegisterScriptCallback", "UnregisterScriptCallback") & (F.size("args") > 0))
    op = F.when(F.col("name").startswith("Un"), "unregister").otherwise("register")
    changes = calls.select("path", F.btrim(F.col("args")[0], F.lit(_QUOTES)).alias("event"), "line", "lo", op.alias("op"))
    met = registered.join(bodies, ["path", "listener"]).join(changes, ["path", "event"]).filter("lo >= `from` AND lo < `to`")
    return met.select("path", "event", "listener", "line", "op").distinct()


def churn_blind_spots(facts: DataFrame, b: DataFrame) -> DataFrame:
    """registrations, inline, unresolved: all registrations, those of a function written in place, and those whose listener the script doesn't define at its top."""
    calls = of(facts, "call").filter((F.col("name") == "RegisterScriptCallback") & (F.size("args") > 1)).select("path", F.col("args")[1].alias("listener"), F.col("kinds")[1].alias("kind"))
    known = functions(b).filter("top").select("path", F.col("name").alias("listener")).distinct().withColumn("known", F.lit(True))
    rows = calls.join(known, ["path", "listener"], "left")
    inline = F.col("kind") == "function"
    return rows.agg(F.count(F.lit(1)).alias("registrations"), F.count_if(inline).alias("inline"), F.count_if(~inline & F.col("known").isNull()).alias("unresolved"))


def repeat_census(facts: DataFrame, least: int = 3) -> DataFrame:
    """name, mode, sites, bodies, often, per_frame: reads that a local could hold, by the mode of their body.

    bodies have a site, often at least `least`; per_frame of these run every frame. Bodies that assign
    what they read are left out.
    """
    calls = of(facts, "call").filter((F.size("args") == 0) & F.col("name").isin(*R.REPEATED_CALLS) & (F.col("func") >= 0))
    reads = of(facts, "index").filter(F.col("name").isin(*R.REPEATED_INDEXES) & (F.col("func") >= 0))
    sites = calls.select("path", "func", "name").unionByName(reads.select("path", "func", "name"))
    by_body = sites.groupBy("path", "func", "name").agg(F.count(F.lit(1)).alias("n"))
    assigned = of(facts, "assign").select("path", "func", "name").distinct()
    modes = R.body_modes(facts).select("path", "func", "mode", "frame")
    kept = by_body.join(assigned, ["path", "func", "name"], "left_anti").join(modes, ["path", "func"])
    often = F.col("n") >= least
    return kept.groupBy("name", "mode").agg(F.sum("n").alias("sites"), F.count(F.lit(1)).alias("bodies"), F.count_if(often).alias("often"), F.count_if(often & F.col("frame")).alias("per_frame"))


def debug_census(facts: DataFrame) -> DataFrame:
    """what, value, n: debug calls by function, by shape (with literals only, with calls, with concatenations), by place (a statement or not) and by body (per frame or not)."""
    calls = of(facts, "call").filter(more("func").isin(*R.DEBUG) & ~F.col("name").startswith("math."))
    bodies = R.functions(facts).select("path", "func", "frame")
    rows = calls.join(bodies, ["path", "func"], "left")
    has = lambda *kinds: F.exists("kinds", lambda k: k.isin(*kinds))
    shape = F.when(F.size("kinds") == 0, "none").when(has("call", "invoke"), "call").when(F.exists("args", lambda a: a.contains("..")), "join").when(F.forall("kinds", lambda k: k.isin("string", "number", "true", "false", "nil")), "literal").otherwise("values")
    facets = {"function": more("func"), "shape": shape, "place": F.when(more("statement").isNotNull(), "statement").otherwise("value"), "body": F.when(F.col("frame"), "per frame").otherwise("other")}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("what"), v.alias("value")) for k, v in facets.items()])).alias("f")
    return rows.select(each).select("f.*").groupBy("what", "value").agg(F.count(F.lit(1)).alias("n"))


#: Calls without an effect of their own.
PURE = ("tostring", "tonumber", "type", "select", "unpack", "pairs", "ipairs", "string.format", "string.sub", "string.len", "string.upper", "string.lower", "table.concat", "math.floor", "math.ceil", "math.abs", "math.max", "math.min")


def debug_risks(facts: DataFrame) -> DataFrame:
    """path, line, function, effects, sole: debug calls that are statements, with what their removal would change.

    effects: calls among the arguments that may do something (null if none). sole: the call is the only
    one of its branch, so that removing it leaves the branch empty.
    """
    calls = of(facts, "call")
    debug = calls.filter(more("func").isin(*R.DEBUG) & ~F.col("name").startswith("math.") & more("statement").isNotNull()).select("path", "line", "func", "lo", "hi", more("func").alias("function"), "chain")
    inner = calls.filter(~F.col("name").isin(*PURE) & ~more("func").isin(*R.DEBUG)).select("path", F.col("name").alias("inner"), F.col("lo").alias("at"))
    met = debug.join(inner, "path").filter("at > lo AND at < hi").groupBy("path", "lo").agg(F.concat_ws(", ", F.sort_array(F.collect_set("inner"))).alias("effects"))  # of one call
    company = facts.filter(F.col("kind").isin("call", "assign", "leave", "scope", "loop")).select("path", "func", "chain", F.col("lo").alias("other"))
    others = debug.filter(F.size("chain") > 0).select("path", "func", "chain", "lo", "hi").join(company, ["path", "func", "chain"]).filter("other < lo OR other >= hi").select("path", "lo").distinct().withColumn("kept", F.lit(True))
    rows = debug.join(met, ["path", "lo"], "left").join(others, ["path", "lo"], "left")
    return rows.select("path", "line", "function", "effects", ((F.size("chain") > 0) & F.col("kept").isNull()).alias("sole"))
