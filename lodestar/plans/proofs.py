"""Queries of the rules and edits that need proofs, over scripts written from the supplier table with hits and near misses by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import stored
from ..scripts import proofs as P
from ..scripts.bindings import stored_bindings
from ..scripts.edits import rewrite
from ..scripts.facts import stored_facts
from ..scripts.gate import captures
from ..scripts.program import call_edges, frame_reach, unused_exports
from .catalog import query


def scripts(suppliers: DataFrame) -> DataFrame:
    """path, text; a, b and loops are the supplier's key modulo 6, 4 and 40."""
    k = F.col("s_suppkey")
    a, b, loops = k % 6, k % 4, k % 40
    of = lambda n, *texts: F.element_at(F.array(*map(F.lit, texts)), n.cast("int") + 1)
    odd = lambda yes, no: F.when(a % 2 == 1, yes).otherwise(no)
    lines: list[str | Column] = [
        "local M = {}", "function M.walk(x)", F.concat(F.lit("  local t = "), of(b, "{}", "{1, 2}", "{x}", "{a = 1}")),
        F.concat(F.lit("  "), of(a, "t[#t+1] = 1", "go(t)", "t[5] = 1", "t[#t+1] = 1", "table.insert(t, 2)", "t[#t+1] = 1")), "  local s = 0",
        F.concat(F.lit("  for _, v in pairs(t) do "), F.when(a == 3, "t[#t+1] = v").otherwise("s = s + v"), F.lit(" end")), F.when(a == 5, '  return string.format("%d", s)').otherwise("  return s"), "end",
        "function M.build(n)", "  local out = {}", F.concat(F.lit("  for i = 1, "), loops.cast("string"), F.lit(" do")), odd("    table.insert(out, i)", "    out[#out+1] = i"),
        F.concat(F.lit("    "), of(b, "n = i", "go(out)", "n = i", "if #out > 3 then break end")), "  end", "  return out", "end",
        "function M.place(acc)", "  for i = 1, 5 do", "    local p = vector():set(i, i, i)", F.concat(F.lit("    "), of(b, "acc = acc + p.x", "keep(p)", "acc = p:distance_to(acc)", "M.p = p")), "  end", "  return acc", "end",
        "function M:update()", F.concat(F.lit("  local once = "), odd("nil", "false")), "  if self.x and not once then", "    go()", F.concat(F.lit("    once = "), F.when(b == 3, "false").otherwise("true")), "  end",
        F.when(b == 1, "  return once").otherwise("  go()"), "end",
        "function M.join(list)", '  local text = ""', F.concat(F.lit("  for i = 1, "), (loops + 10).cast("string"), F.lit(" do")), '    text = text .. list[i] .. ","', F.when(b == 2, "    note(text)").otherwise("    go()"), "  end", "  return text", "end",
    ]
    return suppliers.select(F.concat(F.lit("script_"), k.cast("string")).alias("path"), F.array_join(F.array(*[F.lit(x) if isinstance(x, str) else x for x in lines]), "\n").alias("text"))


_S = "(SELECT 'script_' || s_suppkey AS path, s_suppkey % 6 AS a, s_suppkey % 4 AS b, s_suppkey % 40 AS loops FROM supplier) s"


@query(f"""SELECT path, 'pairs_to_ipairs' AS pattern, CASE WHEN a = 5 THEN 'RED' ELSE 'GREEN' END AS severity, 6::INT AS line FROM {_S} WHERE b IN (0, 1) AND a IN (0, 4, 5)
    UNION ALL SELECT path, 'append_loop_counter', 'YELLOW', 11 FROM {_S} WHERE b IN (0, 2) AND loops >= 20
    UNION ALL SELECT path, 'vector_alloc_in_loop', CASE WHEN b IN (0, 2) THEN 'YELLOW' ELSE 'RED' END, 19 FROM {_S}
    UNION ALL SELECT path, 'once_latch_local_to_function', 'RED', 25 FROM {_S} WHERE b IN (0, 2)""")
def proven_findings(t):
    s = scripts(t("supplier"))
    return P.proven_findings(stored_facts(s), stored_bindings(s)).select("path", "pattern", "severity", "line")


@query(f"""SELECT path, 't' AS name, b IN (0, 1) AND a IN (0, 3, 4, 5) AS sequence FROM {_S}""")
def table_shapes(t):
    """Which locals are sequences: `t` of the first function (`out` is returned, so it is none)."""
    b = stored_bindings(scripts(t("supplier")))
    tables = P.locals_of(b).filter("name = 't'").select("path", "decl", "name")
    return tables.join(P.sequences(b).select("path", "decl", F.lit(True).alias("found")), ["path", "decl"], "left").select("path", "name", F.coalesce("found", F.lit(False)).alias("sequence"))


_COUNTS, _PARTS, _GREEN = "(b IN (0, 2) AND loops >= 20)", "(b <> 2 AND loops >= 20)", "(b IN (0, 1) AND a IN (0, 4))"
_FIXED = f"""concat_ws(chr(10), 'local M = {{}}', 'function M.walk(x)', '  local t = ' || ['{{}}', '{{1, 2}}', '{{x}}', '{{a = 1}}'][b + 1],
    '  ' || ['t[#t+1] = 1', 'go(t)', 't[5] = 1', 't[#t+1] = 1', 't[#t+1] = 2', 't[#t+1] = 1'][a + 1], '  local s = 0',
    '  for _, v in ' || CASE WHEN {_GREEN} THEN 'ipairs' ELSE 'pairs' END || '(t) do ' || CASE WHEN a = 3 THEN 't[#t+1] = v' ELSE 's = s + v' END || ' end',
    CASE WHEN a = 5 THEN '  return string.format("%d", s)' ELSE '  return s' END, 'end',
    'function M.build(n)', '  local out = {{}}', CASE WHEN {_COUNTS} THEN '  local out_n = 0' END, '  for i = 1, ' || loops || ' do', CASE WHEN {_COUNTS} THEN '    out_n = out_n + 1; out[out_n] = i' ELSE '    out[#out+1] = i' END,
    '    ' || ['n = i', 'go(out)', 'n = i', 'if #out > 3 then break end'][b + 1], '  end', '  return out', 'end',
    'function M.place(acc)', CASE WHEN b IN (0, 2) THEN '  local _v = vector()' END, '  for i = 1, 5 do', '    local p = ' || CASE WHEN b IN (0, 2) THEN '_v' ELSE 'vector()' END || ':set(i, i, i)',
    '    ' || ['acc = acc + p.x', 'keep(p)', 'acc = p:distance_to(acc)', 'M.p = p'][b + 1], '  end', '  return acc', 'end',
    'function M:update()', '  local once = ' || CASE WHEN a % 2 = 1 THEN 'nil' ELSE 'false' END, '  if self.x and not once then', '    go()', '    once = ' || CASE WHEN b = 3 THEN 'false' ELSE 'true' END, '  end',
    CASE WHEN b = 1 THEN '  return once' ELSE '  go()' END, 'end',
    'function M.join(list)', CASE WHEN {_PARTS} THEN '  local _text_parts, _text_n = {{}}, 0' ELSE '  local text = ""' END, '  for i = 1, ' || (loops + 10) || ' do',
    CASE WHEN {_PARTS} THEN '    _text_n = _text_n + 1; _text_parts[_text_n] = list[i] .. ","' ELSE '    text = text .. list[i] .. ","' END, CASE WHEN b = 2 THEN '    note(text)' ELSE '    go()' END, '  end',
    CASE WHEN {_PARTS} THEN '  local text = table.concat(_text_parts, "", 1, _text_n)' END, '  return text', 'end')"""


def _proven(s: DataFrame) -> DataFrame:
    return rewrite(s, P.proven_edits(s, stored_facts(s), stored_bindings(s), yellow=True))


@query(f"SELECT path, 35 AS line, 'text' AS variable, {_PARTS} AS safe FROM {_S}")
def safe_concatenations(t):
    """Texts that grow in a loop, with those that may be put together after it."""
    s = scripts(t("supplier"))
    d = F.col("detail")
    return P.concatenation_in_loops(stored_facts(s), stored_bindings(s)).select("path", "line", d["variable"].alias("variable"), (d["safe"] == "true").alias("safe"))


@query(f"SELECT path, {_FIXED} AS text, 0 AS dropped FROM {_S}")
def proven_rewrites(t):
    """Counters, scratch vectors, parts of texts and ipairs where they are proven, everything else as it was."""
    return _proven(scripts(t("supplier"))).select("path", "text", "dropped")


@query(f"SELECT path, 0 AS edits, sha256({_FIXED}) AS digest FROM {_S}")
def proven_fixpoint(t):
    """What was rewritten is at rest: no edits in a second pass."""
    once = stored(_proven(scripts(t("supplier"))).select("path", "text"))
    return _proven(once).select("path", F.col("applied").alias("edits"), F.sha2("text", 256).alias("digest"))


_EDITED = "(SELECT 'script_' || s_suppkey AS path, s_suppkey % 5 AS c FROM supplier) s"


@query(f"""SELECT path, ['actor', 'fresh', 'n', 'shared', 'late'][c + 1] AS name, [4, 0, 3, 5, 0][c + 1]::INT AS line FROM {_EDITED} WHERE c IN (0, 2, 3)""")
def planted_captures(t):
    """A local put in at the start of a body: over a parameter, a new name, over a name in a replaced call, over a global, over what is declared later only."""
    c = F.col("s_suppkey") % 5
    text = "function f(actor, n)\n  go(n)\n  local x = actor\n  x = shared\n  local late = 1\n  return late\nend"
    files = t("supplier").select(F.concat(F.lit("script_"), F.col("s_suppkey").cast("string")).alias("path"), F.lit(text).alias("text"))
    name = F.element_at(F.array(*map(F.lit, ("actor", "fresh", "n", "shared", "late"))), c.cast("int") + 1)
    place, call = text.index("  go(n)"), text.index("go(n)")
    both = F.array(F.struct(F.lit(place).alias("start"), F.lit(place).alias("end"), F.concat(F.lit("  local "), name, F.lit(" = 0\n")).alias("text")), F.struct(F.lit(call).alias("start"), F.lit(call + 5).alias("end"), F.lit("run(n)").alias("text")))
    made = t("supplier").select(F.concat(F.lit("script_"), F.col("s_suppkey").cast("string")).alias("path"), F.explode(both).alias("e"))
    edits = made.select("path", "e.start", "e.end", "e.text", F.lit(0).alias("priority"), F.lit(None).cast("string").alias("grp"), F.lit(False).alias("enabler"), F.lit(False).alias("atomic"))
    return captures(files, stored(rewrite(files, edits))).select("path", "name", "line")


@query(f"SELECT path, 0::BIGINT AS captures FROM {_S}")
def own_captures(t):
    """Names that the proven rewritings capture, a script (none)."""
    s = scripts(t("supplier"))
    found = captures(s, stored(_proven(s))).groupBy("path").agg(F.count(F.lit(1)).alias("captures"))
    return s.select("path").join(found, "path", "left").fillna(0, ["captures"])


def program(t) -> DataFrame:
    """path, text: a module a supplier that calls the next one, and two special modules with a function a nation."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey").cast("string")
    path = lambda m: F.concat(F.lit("gamedata/scripts/"), m, F.lit(".script"))
    lines = F.array(
        F.lit("local function own() return 1 end"),
        F.concat(F.lit("function start() own(); Mod_"), (k + 1).cast("string"), F.lit(".start(); shared_"), n, F.lit("(); missing(); obj:go(); shared_"), n, F.lit("() end")),
        F.lit("function spare() end"), F.when(k % 10 == 0, "function actor_on_update() start() end").otherwise("local kept = spare"))
    mods = t("supplier").select(path(F.concat(F.lit("mod_"), k.cast("string"))).alias("path"), F.array_join(lines, "\n").alias("text"))
    key = F.col("n_nationkey").cast("string")
    one = t("nation").select(F.concat(F.lit("function shared_"), key, F.lit("() end")).alias("line"), "n_nationkey")
    special = one.withColumn("path", path(F.lit("_g"))).unionByName(one.filter("n_nationkey < 5").withColumn("path", path(F.lit("_g_patches"))))
    return mods.unionByName(special.groupBy("path").agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("text")))  # a line a nation


_P = "(SELECT s_suppkey AS k, s_nationkey AS n, s_suppkey - 1 IN (SELECT s_suppkey FROM supplier) AS below, s_suppkey - 2 IN (SELECT s_suppkey FROM supplier) AS below2, s_suppkey + 1 IN (SELECT s_suppkey FROM supplier) AS next, 'gamedata/scripts/mod_' || s_suppkey || '.script' AS path FROM supplier) s"


@query(f"""SELECT kind, count(*) AS edges, sum(n)::BIGINT AS calls, count(*) FILTER (ambiguous) AS ambiguous FROM (
    SELECT 'same-file' AS kind, 1 AS n, false AS ambiguous FROM {_P} UNION ALL SELECT 'same-file', 1, false FROM {_P} WHERE k % 10 = 0
    UNION ALL SELECT CASE WHEN next THEN 'module' ELSE 'unresolved' END, 1, false FROM {_P} UNION ALL SELECT 'global', 2, n < 5 FROM {_P}
    UNION ALL SELECT 'unresolved', 1, false FROM {_P} UNION ALL SELECT 'method', 1, false FROM {_P}) GROUP BY kind""")
def program_calls(t):
    """How the calls of all scripts are resolved."""
    edges = call_edges(stored_bindings(program(t)))
    return edges.groupBy("kind").agg(F.count(F.lit(1)).alias("edges"), F.sum("n").alias("calls"), F.count_if("ambiguous").alias("ambiguous"))


@query(f"""WITH p AS (FROM {_P}), g AS (SELECT 'g' || n AS node, min(hop) AS hop FROM (SELECT n, 2 AS hop FROM p WHERE k % 10 = 0 UNION ALL SELECT n, 3 FROM p WHERE k % 10 = 1 AND below) GROUP BY 1),
    r AS (SELECT 'u' || k AS node, 0 AS hop FROM p WHERE k % 10 = 0 UNION ALL SELECT 's' || k, 1 FROM p WHERE k % 10 = 0 UNION ALL SELECT 'o' || k, 2 FROM p WHERE k % 10 = 0
        UNION ALL SELECT 's' || k, 2 FROM p WHERE k % 10 = 1 AND below UNION ALL SELECT 'o' || k, 3 FROM p WHERE k % 10 = 1 AND below UNION ALL SELECT 's' || k, 3 FROM p WHERE k % 10 = 2 AND below2 UNION ALL FROM g)
    SELECT hop, count(*) AS nodes FROM r GROUP BY hop""")
def program_reach(t):
    """What runs every frame, by hops over the calls of all scripts."""
    return frame_reach(stored_bindings(program(t)), 3).groupBy("hop").agg(F.count(F.lit(1)).alias("nodes"))


@query(f"""SELECT path, 'spare' AS name FROM {_P} WHERE k % 10 = 0 UNION ALL SELECT path, 'start' FROM {_P} WHERE k % 10 <> 0 AND NOT below
    UNION ALL SELECT 'gamedata/scripts/_g.script', 'shared_' || n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)
    UNION ALL SELECT 'gamedata/scripts/_g_patches.script', 'shared_' || n_nationkey FROM nation WHERE n_nationkey < 5 AND n_nationkey NOT IN (SELECT s_nationkey FROM supplier)""")
def unused_functions(t):
    """Functions that no script names."""
    return unused_exports(stored_bindings(program(t))).select("path", "name")


def readers(suppliers: DataFrame) -> DataFrame:
    """path, text: bodies that read the same thing again and again, by the supplier's key modulo 6 (a) and 4 (b)."""
    k = F.col("s_suppkey")
    a, b = k % 6, k % 4
    of = lambda n, *texts: F.element_at(F.array(*map(F.lit, texts)), n.cast("int") + 1)
    lines = [
        "function M.clock(n)", F.concat(F.lit("  "), of(b, "if n then return end", "n = 1", "n = 2", "while n do n = go() end")), "  if time_global() - last < 250 then return end", "  last = time_global()", "end",
        "function M.actor(n)", "  n = 1", F.concat(F.lit("  "), of(a, "go(db.actor)", "if n then go(db.actor) end", "db.actor = n; go(db.actor)", "go(db.actor)", "for i = 1, n do go(db.actor) end", "go(db.actor)")),
        "  db.actor:go(db.actor, db.actor)", "end",
        "function M.ids(o, n)", F.concat(F.lit("  "), of(b, "n = o:id()", "n = o and o:id()", "if n then n = o:id() end", "o = n; n = o:id()")), "  go(o:id(), o:id())", "  return o:id()", "end",
    ]
    return suppliers.select(F.concat(F.lit("script_"), k.cast("string")).alias("path"), F.array_join(F.array(*[F.lit(x) if isinstance(x, str) else x for x in lines]), "\n").alias("text"))


_HELD = """concat_ws(chr(10), 'function M.clock(n)', '  ' || ['if n then return end', 'n = 1', 'n = 2', 'while n do n = go() end'][b + 1],
    CASE WHEN b IN (1, 2) THEN '  local tg = time_global()' END, CASE WHEN b IN (1, 2) THEN '  if tg - last < 250 then return end' ELSE '  if time_global() - last < 250 then return end' END,
    CASE WHEN b IN (1, 2) THEN '  last = tg' ELSE '  last = time_global()' END, 'end',
    'function M.actor(n)', CASE WHEN a IN (1, 4) THEN '  local actor = db.actor' END, '  n = 1', CASE WHEN a IN (0, 3, 5) THEN '  local actor = db.actor' END,
    '  ' || ['go(actor)', 'if n then go(actor) end', 'db.actor = n; go(db.actor)', 'go(actor)', 'for i = 1, n do go(actor) end', 'go(actor)'][a + 1],
    CASE WHEN a = 2 THEN '  db.actor:go(db.actor, db.actor)' ELSE '  actor:go(actor, actor)' END, 'end',
    'function M.ids(o, n)', CASE WHEN b = 0 THEN '  local o_id = o:id()' END,
    '  ' || CASE b WHEN 0 THEN 'n = o_id' WHEN 1 THEN 'n = o and o:id()' WHEN 2 THEN 'if n then n = o:id() end' ELSE 'o = n; n = o:id()' END,
    CASE WHEN b = 0 THEN '  go(o_id, o_id)' ELSE '  go(o:id(), o:id())' END, CASE WHEN b = 0 THEN '  return o_id' ELSE '  return o:id()' END, 'end')"""


@query(f"SELECT path, {_HELD} AS text FROM {_S}")
def held_reads(t):
    """Repeated reads through a local that dominates them; near misses stay as they were."""
    s = readers(t("supplier"))
    return rewrite(s, P.hold_edits(s, stored_facts(s), stored_bindings(s))).select("path", "text")
