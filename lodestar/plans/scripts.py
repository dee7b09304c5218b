"""Queries over scripts written from the supplier table: a script a supplier, whose hits and near misses follow from its key.

What a rule has to find is stated in SQL over the same table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scripts import edits as E
from ..scripts import rules as R
from ..scratch import stored
from ..scripts.facts import extract, spread_out, stored_facts
from .catalog import ORACLE_SQL, query


def _times(text: str, n: Column) -> Column:
    return F.repeat(F.lit(text), n.cast("int"))


def scripts(suppliers: DataFrame) -> DataFrame:
    """path, text; k is the supplier's key, n its nation."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey").cast("string")
    a, b = k % 6, k % 4
    pick = lambda *texts: F.element_at(F.array(*[t if isinstance(t, Column) else F.lit(t) for t in texts]), b.cast("int") + 1)
    lines = [
        F.lit("local M = {}"),
        F.concat(F.lit("local total = "), n),
        F.concat(F.lit("seen = "), pick("total", "1", "1", "1")),
        F.lit("function M.measure(list, pos, s)"),
        F.lit("  local n = table.getn(list) + string.len(s)"),
        F.concat(F.lit("  "), F.when(b == 3, _times("alife():go(); ", a)).otherwise(_times("alife():object(n); ", a))),
        F.lit("  if n > 3 then alife() else alife(); alife() end"),
        F.concat(F.lit('  if string.find(s, "'), pick("w", "a.b", "w", "w"), n, F.lit('") then return n end')),
        F.concat(F.lit("  local p = math.pow(n, "), pick("2", "0.5", "5", "3"), F.lit(") + n ^ "), F.when(a < 3, "2").otherwise("7")),
        F.concat(F.lit("  if pos:distance_to(list[1]) < "), n, F.lit('.5 then print(n) else return "a" .. \'b\' end')),
        F.lit("  if not (n == p) then return p else n = 0 end"),
        F.concat(F.lit("  while "), pick("n < 1", "n < 1", "false", "n < 1"), F.lit(" do n = n + 1 end")),
        F.concat(F.lit("  if "), pick("n", "n", "n", "1"), F.lit(" then last_"), n, F.lit(" = n end")),
        F.concat(F.lit('  local text = ""; for i = 1, '), (k % 40).cast("string"), F.lit(' do text = text .. "x" end; s = s .. text')),
        F.lit("  table.insert(list, p); list[1] = s"),
        F.lit("  do return p end"),
        F.lit("end"),
        F.lit("function M:update()"),
        F.concat(F.lit("  "), _times("math.floor(self.x); ", a), _times("self.object:id(); ", b + 2)),
        F.concat(F.lit("  "), pick("for q, v in pairs(self) do break M.x = 1 end", "if self.x then print(1) end", "local q = 1", "self.object = nil")),
        F.lit("end"),
        F.lit("function M.look(id)"),
        F.lit("  local o = level.object_by_id(id)"),
        F.concat(F.lit("  "), pick("o:go()", "if o then o:go() end", "local x = o:go()", "if not o then return end o:go()")),
        F.concat(F.lit("  f("), F.when(a < 3, "time_global(), ").otherwise(""), F.lit("time_global())")),
        F.lit("end"),
        F.lit("return M"),
    ]
    return suppliers.select(F.concat(F.lit("script_"), k.cast("string")).alias("path"), F.array_join(F.array(*lines), "\n").alias("text"))


def _rows(t, rule: str) -> DataFrame:
    return R.RULES[rule](stored_facts(scripts(t("supplier")))).select("path", "pattern", "severity", "line")


_S = "(SELECT 'script_' || s_suppkey AS path, s_suppkey % 6 AS a, s_suppkey % 4 AS b, s_suppkey % 40 AS loops, s_nationkey::BIGINT AS n FROM supplier) s"


def _hits(*hits: tuple) -> str:
    """SQL of (pattern, severity, line, condition) over the suppliers."""
    return " UNION ALL ".join(f"SELECT path, {p} AS pattern, '{s}' AS severity, {line}::INT AS line FROM {_S} WHERE {c}" for p, s, line, c in hits)


@query(_hits(("'table_getn'", "GREEN", 5, "true"), ("'string_len'", "GREEN", 5, "true")))
def rule_lengths(t):
    return _rows(t, "lengths")


@query(_hits(("'math_pow_simple'", "GREEN", 9, "b <> 2")))
def rule_powers(t):
    return _rows(t, "powers")


@query(_hits(("'pow_op_simple'", "GREEN", 9, "a < 3")))
def rule_power_operators(t):
    return _rows(t, "power_operators")


@query(_hits(("'string_literal_concat'", "GREEN", 10, "true")))
def rule_literal_concatenation(t):
    return _rows(t, "literal_concatenation")


@query(_hits(("'string_find_plain'", "GREEN", 8, "b <> 1")))
def rule_plain_find(t):
    return _rows(t, "plain_find")


@query(_hits(("'redundant_not_eq'", "GREEN", 11, "true")))
def rule_negated_equality(t):
    return _rows(t, "negated_equality")


@query(f"SELECT path, 'uncached_globals_summary' AS pattern, 'GREEN' AS severity, 18 AS line, '{{\"math.floor\":' || a || '}}' AS globals FROM {_S} WHERE a >= 4")
def rule_uncached_globals(t):
    return R.RULES["uncached_globals"](stored_facts(scripts(t("supplier")))).select("path", "pattern", "severity", "line", F.col("detail")["globals"].alias("globals"))


@query(f"""SELECT path, 'repeated_alife' AS pattern, 'GREEN' AS severity, CASE WHEN a = 0 THEN 7 ELSE 6 END AS line, a + 3 AS calls, a + 2 AS worst FROM {_S} WHERE a >= 2 AND b <> 3
    UNION ALL SELECT path, 'repeated_self_object_id()', 'GREEN', 19, 4, 4 FROM {_S} WHERE b = 2 UNION ALL SELECT path, 'repeated_time_global', 'GREEN', 25, 2, 2 FROM {_S} WHERE a < 3 AND b <> 3""")
def rule_repeated(t):
    d = F.col("detail")
    return R.RULES["repeated"](stored_facts(scripts(t("supplier")))).select("path", "pattern", "severity", "line", d["count"].cast("long").alias("calls"), d["worst"].cast("long").alias("worst"))


@query(f"SELECT path, 'string_concat_in_loop' AS pattern, 'YELLOW' AS severity, 14 AS line, 'text' AS variable, false AS safe, loops AS trips FROM {_S}")
def rule_concatenation_in_loops(t):
    source = scripts(t("supplier"))
    found = R.RULES["concatenation_in_loops"](stored_facts(source)).join(source, "path")
    header = F.concat(F.lit("for"), F.substring_index(F.split("text", "\n")[F.col("line") - 1], "for", -1))
    return found.select("path", "pattern", "severity", "line", F.col("detail")["variable"].alias("variable"), (F.col("detail")["safe"] == "true").alias("safe"), R.trips(header).cast("long").alias("trips"))


@query(_hits(("'debug_statement'", "DEBUG", 10, "true"), ("'debug_statement'", "DEBUG", 20, "b = 1")))
def rule_debug_output(t):
    return _rows(t, "debug_output")


@query(_hits(("'module_global_write'", "RED", 3, "true"), ("'global_write'", "RED", 13, "true")))
def rule_global_writes(t):
    return R.global_writes(stored_facts(scripts(t("supplier"))), module_level=True).select("path", "pattern", "severity", "line")


@query(_hits(("'dead_code_while_false'", "GREEN", 12, "b = 2"), ("'dead_code_after_break'", "GREEN", 20, "b = 0")))
def rule_dead_code(t):
    return _rows(t, "dead_code")


@query(_hits(("'unnecessary_else'", "YELLOW", 11, "true")))
def rule_needless_else(t):
    return _rows(t, "needless_else")


@query(_hits(("'constant_condition'", "YELLOW", 13, "b = 3")))
def rule_constant_conditions(t):
    return _rows(t, "constant_conditions")


@query(_hits(("'unused_local_variable'", "YELLOW", 2, "b <> 0"), ("'unused_local_variable'", "YELLOW", 20, "b = 2"), ("'unused_local_variable'", "YELLOW", 24, "b = 2")))
def rule_unused_locals(t):
    return _rows(t, "unused_locals")


@query(f"SELECT path, 'distance_to_comparison' AS pattern, 'GREEN' AS severity, 10 AS line, (n * n + n) || '.25' AS squared FROM {_S}")
def rule_distances(t):
    return R.RULES["distances"](stored_facts(scripts(t("supplier")))).select("path", "pattern", "severity", "line", F.col("detail")["squared"].alias("squared"))


@query(f"SELECT path, 'jit_mode' AS pattern, 'RED' AS severity, 18 AS line, 'interpreted' AS mode FROM {_S}")
def rule_trace_modes(t):
    return R.RULES["trace_modes"](stored_facts(scripts(t("supplier")))).select("path", "pattern", "severity", "line", F.col("detail")["mode"].alias("mode"))


@query(_hits(("'per_frame_callback'", "RED", 18, "b = 0"), ("'per_frame_callback'", "YELLOW", 18, "b <> 0 AND a >= 2"), ("'per_frame_callback'", "DEBUG", 18, "b <> 0 AND a < 2")))
def rule_per_frame_callbacks(t):
    return _rows(t, "per_frame_callbacks")


@query(_hits(("'table_insert_append'", "GREEN", 15, "true")))
def rule_appends(t):
    return _rows(t, "appends")


@query(f"""SELECT path, unnest(['M.measure', 'M.look', 'M:update']) AS function, 'interpreted' AS mode FROM {_S}""")
def body_modes(t):
    return R.body_modes(stored_facts(scripts(t("supplier")))).select("path", "function", "mode")


@query(f"""SELECT path, count(*) AS facts, count(*) FILTER (kind = 'scope') AS functions FROM (SELECT path, unnest(['scope', 'scope', 'scope']) AS kind FROM {_S}) GROUP BY path""")
def script_functions(t):
    return extract(spread_out(scripts(t("supplier")))).filter("kind = 'scope'").groupBy("path").agg(F.count(F.lit(1)).alias("facts"), F.count_if(F.col("kind") == "scope").alias("functions"))


@query(f"SELECT 'script_' || s_suppkey AS path, 'parse' AS what FROM supplier WHERE s_suppkey % 3 = 0")
def script_failures(t):
    """Every third script is cut off in the middle; its failure is one row, the others give facts."""
    s = scripts(t("supplier"))
    cut = F.when(F.regexp_extract("path", r"(\d+)", 1).cast("long") % 3 == 0, F.substring_index("text", "end", 2)).otherwise(F.col("text"))
    return extract(spread_out(s.withColumn("text", cut))).filter("kind = 'failure'").select("path", F.col("name").alias("what"))


_FIXED = r"""concat_ws(chr(10), 'local M = {}', 'local total = ' || n, 'seen = ' || CASE b WHEN 0 THEN 'total' ELSE '1' END, 'function M.measure(list, pos, s)',
    '  local n = #list + #s', '  ' || repeat(CASE WHEN b = 3 THEN 'alife():go(); ' ELSE 'alife():object(n); ' END, a::INT), '  if n > 3 then alife() else alife(); alife() end',
    '  if string.find(s, "' || CASE b WHEN 1 THEN 'a.b' ELSE 'w' END || n || '"' || CASE b WHEN 1 THEN '' ELSE ', 1, true' END || ') then return n end',
    '  local p = ' || CASE b WHEN 0 THEN '(n*n)' WHEN 1 THEN 'math.sqrt(n)' WHEN 2 THEN 'math.pow(n, 5)' ELSE '(n*n*n)' END || ' + ' || CASE WHEN a < 3 THEN '(n*n)' ELSE 'n ^ 7' END,
    '  if pos:distance_to_sqr(list[1]) < ' || (n * n + n) || '.25 then print(n) else return "ab" end', '  if n ~= p then return p else n = 0 end',
    '  while ' || CASE b WHEN 2 THEN 'false' ELSE 'n < 1' END || ' do n = n + 1 end', '  if ' || CASE b WHEN 3 THEN '1' ELSE 'n' END || ' then last_' || n || ' = n end',
    '  local text = ""; for i = 1, ' || loops || ' do text = text .. "x" end; s = s .. text', '  list[#list+1] = p; list[1] = s', '  do return p end', 'end', 'function M:update()',
    '  ' || repeat('math.floor(self.x); ', a::INT) || repeat('self.object:id(); ', b::INT + 2),
    '  ' || CASE b WHEN 0 THEN 'for q, v in pairs(self) do break M.x = 1 end' WHEN 1 THEN 'if self.x then print(1) end' WHEN 2 THEN 'local q = 1' ELSE 'self.object = nil' END, 'end', 'function M.look(id)', '  local o = level.object_by_id(id)',
    '  ' || CASE b WHEN 0 THEN 'o:go()' WHEN 1 THEN 'if o then o:go() end' WHEN 2 THEN 'local x = o:go()' ELSE 'if not o then return end o:go()' END, '  f(' || CASE WHEN a < 3 THEN 'time_global(), ' ELSE '' END || 'time_global())', 'end', 'return M')"""


@query(f"SELECT path, {_FIXED} AS text, 0 AS dropped FROM {_S}")
def script_rewrites(t):
    s = scripts(t("supplier"))
    return E.rewrite(s, E.edits_of(stored_facts(s))).select("path", "text", "dropped")


@query(f"SELECT path, 0 AS edits, sha256({_FIXED}) AS digest FROM {_S}")
def rewrite_fixpoint(t):
    """The edits left after a pass (none), and the digest after a second."""
    s = scripts(t("supplier"))
    once = stored(E.rewrite(s, E.edits_of(stored_facts(s))).select("path", "text"))
    twice = E.rewrite(once, E.edits_of(stored_facts(once)))
    return twice.select("path", F.col("applied").alias("edits"), F.sha2("text", 256).alias("digest"))


@query(f"""SELECT path, 'cached' AS kind, a AS calls FROM {_S} WHERE a >= 4""")
def rewrite_caches(t):
    """Calls that go through a local after the cache edits."""
    s = scripts(t("supplier"))
    made = E.rewrite(s, E.edits_of(stored_facts(s), ("cache",)))
    return made.filter("applied > 0").select("path", F.lit("cached").alias("kind"), (F.size(F.split("text", r"c_math_floor\(")) - 1).cast("long").alias("calls"))


@query(f"SELECT path, 'potential_nil_access' AS pattern, 'YELLOW' AS severity, 24 AS line, 'level.object_by_id' AS source, b = 0 AS safe FROM {_S} WHERE b IN (0, 2)")
def rule_nil_accesses(t):
    d = F.col("detail")
    return R.RULES["nil_accesses"](stored_facts(scripts(t("supplier")))).select("path", "pattern", "severity", "line", d["source"].alias("source"), (d["safe"] == "true").alias("safe"))


@query(f"SELECT path, '  if o then o:go() end' AS line, 1 AS applied FROM {_S} WHERE b = 0")
def rewrite_guards(t):
    s = scripts(t("supplier"))
    made = E.rewrite(s, E.edits_of(stored_facts(s), ("guard",)))
    return made.filter("applied > 0").select("path", F.split("text", "\n")[23].alias("line"), "applied")


@query(f"SELECT path, n_lines, commented, gone FROM (SELECT path, 27::INT AS n_lines, CASE b WHEN 1 THEN 2 ELSE 1 END::INT AS commented, CASE WHEN b IN (0, 2) THEN 1 ELSE 0 END::INT AS gone FROM {_S})")
def rewrite_cleanups(t):
    """Debug calls become comments, dead code goes, lines stay."""
    s = scripts(t("supplier"))
    made = E.rewrite(s, E.edits_of(stored_facts(s), ("debug", "dead")))
    commented = (F.size(F.split("text", r"--\[==\[")) - 1).alias("commented")
    return made.select("path", F.size(F.split("text", "\n")).alias("n_lines"), commented, (F.col("applied") - commented).cast("int").alias("gone"))


_ALL = [name for name in ORACLE_SQL if name.startswith("rule_")]


@query(" UNION ALL ".join(f"SELECT path, pattern, severity, line FROM ({ORACLE_SQL[name]}) WHERE pattern <> 'module_global_write'" for name in _ALL))
def all_findings(t):
    """Every rule over every script, from facts that are parsed and written once."""
    return R.findings(stored_facts(scripts(t("supplier")))).select("path", "pattern", "severity", "line")


@query("""SELECT p_partkey::VARCHAR AS path, CASE WHEN p_size % 3 = 0 THEN '<[' || upper(p_name) || ']>' WHEN p_size % 3 = 1 THEN 'f(' || upper(p_name) || ')+' ELSE '<[' || upper(p_name) || ']>' END AS text,
    CASE WHEN p_size % 3 = 0 THEN 2 WHEN p_size % 3 = 1 THEN 2 ELSE 1 END AS applied, CASE WHEN p_size % 3 = 0 THEN 1 WHEN p_size % 3 = 1 THEN 1 ELSE 3 END AS dropped FROM part""")
def edit_admission(t):
    """Text f(name): an inner edit wrapped by a container, with an insertion that has no place left in it (size % 3 = 0), overlapped in part (1), or of an atomic group with a lost member (2)."""
    name, kind, n = F.col("p_name"), F.col("p_size") % 3, F.length("p_name")
    files = t("part").select(F.col("p_partkey").cast("string").alias("path"), F.concat(F.lit("f("), name, F.lit(")")).alias("text"))
    e = lambda start, end, text, priority=0, grp=None, enabler=False, atomic=False: F.struct(
        F.lit(start).cast("int").alias("start") if isinstance(start, int) else start.cast("int").alias("start"), end.cast("int").alias("end"), text.alias("text"), F.lit(priority).alias("priority"),
        F.lit(grp).cast("string").alias("grp"), F.lit(enabler).alias("enabler"), F.lit(atomic).alias("atomic"))
    inner = e(2, 2 + n, F.upper(name), 5)
    wrap = e(0, 3 + n, F.concat(F.lit("<["), name, F.lit("]>")))
    wrapped = F.array(inner, wrap, e(2 + n, 2 + n, F.lit("+"), 1))
    partly = F.array(inner, e(0, 2 + n - 1, F.lit("lost")), e(3 + n, 3 + n, F.lit("+"), 1))
    group = F.array(e(2, 2 + n, F.upper(name), 5, "g", False, True), e(2 + n - 1, 3 + n, F.lit("!"), 4, "g", False, True), wrap, e(0, F.lit(0), F.lit("local x "), 9, "g", True, False))
    edits = F.when(kind == 0, wrapped).when(kind == 1, partly).otherwise(group)
    rows = t("part").select(F.col("p_partkey").cast("string").alias("path"), F.explode(edits).alias("e")).select("path", "e.*")
    return E.rewrite(files, rows).drop("pieces")
