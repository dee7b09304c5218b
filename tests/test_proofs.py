"""Rules and edits with proofs: own snippets, each a file, hits and near misses."""

import re

import pytest

from lodestar.scripts import proofs as P
from lodestar.scripts.bindings import stored_bindings
from lodestar.scripts.edits import rewrite
from lodestar.scripts.facts import stored_facts


def body(*lines: str, head: str = "function run(n, src)", before: str = "") -> str:
    return "\n".join([*([before] if before else []), head, *("  " + line for line in lines), "end", ""])


def walk(*lines: str, start: str = "{}", after: str = "return s", before: str = "") -> str:
    return body(f"local t = {start}", *lines, "local s = 0", "for _, v in pairs(t) do s = s + v end", after, before=before)


SEQUENCES = {
    "appended": (walk("t[#t+1] = 4"), "GREEN compiled"),
    "inserted": (walk("table.insert(t, 4)"), "GREEN compiled"),
    "constants": (walk(start="{1, 'x', true}"), "GREEN compiled"),
    "element_read": (walk("t[#t+1] = 4", "n = t[1] + #t"), "GREEN compiled"),
    "variable_element": (walk(start="{n, 2}"), None),
    "keyed": (walk(start="{k = 1}"), None),
    "field_written": (walk("t[#t+1] = 4", "t.name = 1"), None),
    "hole": (walk("t[7] = 4"), None),
    "handed_on": (walk("keep(t)"), None),
    "length_first": (walk("t[1+#t] = 4"), None),
    "alias_of_insert": (walk("ins(t, 4)", before="local ins = table.insert"), None),
    "returned": (walk("t[#t+1] = 4", after="return t"), None),
    "compared": (walk("if t == src then n = 1 end"), None),
    "captured": (walk("local f = function() t.x = 1 end"), None),
    "rebound": (walk("t = src"), None),
    "grows_inside": (body("local t = {}", "for _, v in pairs(t) do t[#t+1] = v end"), None),
    "grows_before_only": (body("local t = {}", "for i = 1, 3 do t[#t+1] = i end", "local s = 0", "for _, v in pairs(t) do s = s + v end"), "GREEN compiled"),
    "global": (body("for _, v in pairs(things) do n = v end"), None),
    "parameter": (body("for _, v in pairs(src) do n = v end"), None),
    "other_scope": (body("if n then local t = {} end", "for _, v in pairs(t) do n = v end"), None),
    "method_called": (walk("t:sort()"), None),
    "interpreted": (walk("t[#t+1] = 1", after='return string.format("%d", s)'), "RED interpreted"),
    "unknown_call": (walk("t[#t+1] = 1", "if other.thing(n) then n = 1 end"), "RED undecidable"),
    "unknown_method": (walk("t[#t+1] = 1", "n = src:own_helper()"), "RED undecidable"),
    "engine_method": (walk("t[#t+1] = 1", "n = src:section_name()"), "RED interpreted"),
    "second_walk": (walk("t[#t+1] = 1", "for _, v in pairs(src) do n = v end"), "RED interpreted"),
    "branch_only": (walk("t[#t+1] = 1", 'if n then n = string.format("%d", n) end'), "RED mixed"),
    "top_level": ("local t = {1, 2}\nlocal s = 0\nfor _, v in pairs(t) do s = s + v end\n", "RED unknown"),
}


def loop(*lines: str, start: str = "{}", head: str = "for i = 1, n do", between: tuple = (), after: str = "return out") -> str:
    return body(f"local out = {start}", *between, head, *("  " + line for line in lines), "end", after)


COUNTERS = {
    "append": (loop("out[#out+1] = i * 2"), "0 1 true"),
    "append_reversed": (loop("out[1+#out] = i"), "0 1 false"),
    "insert": (loop("table.insert(out, i * 2)"), "0 1 true"),
    "two_branches": (loop("if i > 2 then out[#out+1] = 1 else table.insert(out, 2) end"), "0 2 true"),
    "may_be_nil": (loop("out[#out+1] = v", head="for _, v in pairs(src) do"), "0 1 false"),
    "started": (loop("out[#out+1] = i * 2", between=("out[#out+1] = 'head'",)), "#out 1 true"),
    "array": (loop("out[#out+1] = i * 2", start="{n, 2}"), "#out 1 true"),
    "long": (loop("out[#out+1] = 1", head="for i = 1, 20 do"), "0 1 true"),
    "short": (loop("out[#out+1] = 1", head="for i = 1, 19 do"), None),
    "short_step": (loop("out[#out+1] = 1", head="for i = 40, 1, -4 do"), None),
    "passed": (loop("out[#out+1] = i", "use(out)"), None),
    "at_place": (loop("table.insert(out, 1, i)"), None),
    "captured": (loop("local f = function() out[#out+1] = i end"), None),
    "removed": (loop("out[#out+1] = i", "table.remove(out)"), None),
    "length_read": (loop("out[#out+1] = i", "if #out > 3 then break end"), None),
    "other_write": (loop("out[#out+1] = i", "out[1] = 0"), None),
    "aliased": (loop("out[#out+1] = i", "local other = out"), None),
    "rebound": (loop("out = {}", "out[#out+1] = i"), None),
    "shadowed": (loop("local out = {}", "out[#out+1] = i"), None),
    "keyed": (loop("out[#out+1] = i", start="{mode = 1}"), None),
    "hole": (loop("out[#out+1] = i", start="{[2] = 1}"), None),
    "no_local": (body("for i = 1, n do", "  src[#src+1] = i", "end"), None),
    "outer_block": (body("local out = {}", "if n then", "  for i = 1, n do out[#out+1] = i end", "end"), None),
    "in_header": (loop("out[#out+1] = 1", head="while #out < n do"), None),
    "touched_before": (loop("out[#out+1] = i", between=("use(out)",)), None),
    "read_back": (loop("out[#out+1] = #out"), None),
    "value_used": (loop("n = table.insert(out, i)"), None),
}


def vec(*lines: str, before: tuple = ()) -> str:
    return body(*before, "for i = 1, 3 do", *("  " + line for line in lines), "end")


VECTORS = {
    "fields_read": (vec("local p = vector():set(i, i, i)", "n = n + p.x"), ["YELLOW"]),
    "statement": (vec("vector():set(i, 0, 0)"), ["YELLOW"]),
    "copied": (vec("src:play_at_pos(vector():set(i, 0, 0))"), ["YELLOW"]),
    "two": (vec("local p = vector():set(i, 0, 0)", "local q = vector():set(0, i, 0)", "n = p.x + q.y"), ["YELLOW", "YELLOW"]),
    "nested": (vec("for j = 1, 3 do", "  local p = vector():set(i, j, 0)", "  n = p.x * p.y", "end"), ["YELLOW"]),
    "own_method": (vec("local p = vector():set(i, 0, 0)", "n = p:distance_to_sqr(p)"), ["YELLOW"]),
    "stored": (vec("src[i] = vector():set(i, 0, 0)"), ["RED"]),
    "stored_by_local": (vec("local p = vector():set(i, 0, 0)", "src[i] = p"), ["RED"]),
    "returned": (vec("if i == 2 then return vector():set(i, 0, 0) end"), ["RED"]),
    "captured": (vec("local p = vector():set(i, 0, 0)", "src[i] = function() return p.x end"), ["RED"]),
    "function_argument": (vec("keep(src, vector():set(i, 0, 0))"), ["RED"]),
    "other_method": (vec("src:keep(vector():set(i, 0, 0))"), ["RED"]),
    "upvalue": (vec("last = vector():set(i, 0, 0)"), ["RED"]),
    "field_written": (vec("local p = vector():set(i, 0, 0)", "p.x = 1"), ["RED"]),
    "closure_in_loop": (vec("local g = function()", "  for j = 1, 2 do", "    local p = vector():set(i, 0, 0)", "    n = p.x", "  end", "end"), ["RED"]),
    "without_set": (vec("local p = vector()", "n = p.x"), ["RED"]),
    "outside": (body("local p = vector():set(1, 2, 3)", "return p.x"), []),
}


def latch(*lines: str, start: str = "false", head: str = "function actor_on_update()", before: str = "") -> str:
    return body(f"local done = {start}", *lines, head=head, before=before)


GUARD = ("if not done then", "  work()", "  done = true", "end")
LATCHES = {
    "plain": (latch(*GUARD), "true"),
    "cold": (latch(*GUARD, head="function on_game_start()"), "false"),
    "mirrored": (latch("if done then", "  work()", "  done = false", "end", start="true"), "true"),
    "nil": (latch(*GUARD, start="nil"), "true"),
    "and_other": (latch("if ready and not done then", *GUARD[1:]), "true"),
    "do_block": (latch("do", *GUARD, "end"), "true"),
    "method": (latch(*GUARD, head="function binder:update(delta)"), "true"),
    "top": ("local done = false\n" + "\n".join(GUARD) + "\n", None),
    "module_flag": (body(*GUARD, before="local done = false"), None),
    "loop": (latch("for i = 1, 3 do", *GUARD, "end"), None),
    "break_out": (latch("while not done do", "  if go() then", "    work()", "    done = true", "  end", "end"), None),
    "read_again": (latch(*GUARD, "return done"), None),
    "captured": (latch("if not done then", "  register(function() done = true end)", "  done = true", "end"), None),
    "computed": (latch("if helmet() then", "  work()", "  done = true", "end", "if n and done then", "  go()", "end"), None),
    "two_guards": (latch(*GUARD, "if not done then", "  go()", "end"), None),
    "else": (latch(*GUARD[:-1], "else", "  go()", "end"), None),
    "elseif": (latch(*GUARD[:-1], "elseif n then", "  go()", "end"), None),
    "flip_only": (latch("if not done then", "  done = true", "end"), None),
    "no_flip": (latch("if not done then", "  work()", "  done = compute()", "end"), None),
    "same_constant": (latch("if not done then", "  work()", "  done = false", "end"), None),
    "not_last": (latch("if not done then", "  done = true", "  work()", "end"), None),
    "two_targets": (latch("if not done then", "  work()", "  done, n = true, true", "end"), None),
    "declared_again": (latch(*GUARD, "local done = 1"), None),
}


def text(*lines: str, head: str = "for i = 1, n do", start: str = '""', between: tuple = (), after: str = "return s") -> str:
    return body(f"local s = {start}", *between, head, *("  " + line for line in lines), "end", after)


TEXTS = {
    "grows": (text("s = s .. i"), True),
    "long_chain": (text('s = s .. i .. ","'), True),
    "two_sites": (text("s = s .. i", "s = s .. n"), True),
    "long": (text("s = s .. i", head="for i = 1, 30 do"), True),
    "short": (text("s = s .. i", head="for i = 1, 29 do"), False),
    "read": (text("s = s .. i", "log(s)"), None),
    "read_in_value": (text("s = s .. #s"), None),
    "read_by_call": (text("s = s .. f(s)"), None),
    "captured": (text("s = s .. i", "g = function() return s end"), None),
    "reset": (text("s = s .. i", 's = ""'), None),
    "not_empty": (text("s = s .. i", start='"x"'), None),
    "used_between": (text("s = s .. i", between=("log(s)",)), None),
    "one_line": (body('local s = ""', "for i = 1, n do s = s .. i end", "return s"), None),
    "prepended": (text("s = i .. s"), None),
    "in_header": (text("s = s .. 1", head="while #s < n do"), None),
    "other_block": (body('local s = ""', "if n then", "  for i = 1, n do", "    s = s .. i", "  end", "end"), None),
}
ALL = {f"{kind}/{k}": v[0] for kind, cases in (("walk", SEQUENCES), ("count", COUNTERS), ("vector", VECTORS), ("latch", LATCHES), ("text", TEXTS)) for k, v in cases.items()}


@pytest.fixture(scope="module")
def read(spark):
    files = spark.createDataFrame([*ALL.items(), ("broken", "function ("), ("nothing", None)], "path string, text string")
    facts, b = stored_facts(files), stored_bindings(files)
    return files, facts, b


@pytest.fixture(scope="module")
def found(read):
    _, facts, b = read
    return [r.asDict() for r in P.proven_findings(facts, b).collect()]


def of(found, path, pattern):
    return [r for r in found if r["path"] == path and r["pattern"] == pattern]


def test_sequences(found):
    for k, (_, want) in SEQUENCES.items():
        got = of(found, f"walk/{k}", "pairs_to_ipairs")
        assert [f"{r['severity']} {r['detail']['mode']}" for r in got] == ([want] if want else []), k


def test_counters(found):
    for k, (_, want) in COUNTERS.items():
        got = of(found, f"count/{k}", "append_loop_counter")
        assert [f"{r['detail']['seed']} {r['detail']['sites']} {r['detail']['all_non_nil']}" for r in got] == ([want] if want else []), k


def test_vectors(found):
    for k, (_, want) in VECTORS.items():
        assert sorted(r["severity"] for r in of(found, f"vector/{k}", "vector_alloc_in_loop")) == want, k


def test_latches(found):
    for k, (_, want) in LATCHES.items():
        assert [r["detail"]["frame"] for r in of(found, f"latch/{k}", "once_latch_local_to_function")] == ([want] if want else []), k


def test_texts(read):
    got = {r.path: r.pays for r in P.grown_texts(read[2]).collect()}
    for k, (_, want) in TEXTS.items():
        assert got.get(f"text/{k}") == want, k


def test_concatenations_are_safe_only_by_proof(read):
    _, facts, b = read
    got = {r.path: r.detail["safe"] for r in P.concatenation_in_loops(facts, b).collect()}
    for k, (_, want) in TEXTS.items():
        if f"text/{k}" in got:
            assert (got[f"text/{k}"] == "true") == bool(want), k
    assert sum(v == "true" for v in got.values()) == sum(bool(w) for _, w in TEXTS.values())


def test_rewrites(spark, read):
    files, facts, b = read
    once = {r.path: r for r in rewrite(files, P.proven_edits(files, facts, b, yellow=True)).collect()}
    assert "ipairs(t)" in once["walk/appended"].text and "ipairs" not in once["walk/interpreted"].text
    assert "  local out_n = 0\n  for i" in once["count/insert"].text and "out_n = out_n + 1; out[out_n] = i * 2" in once["count/insert"].text
    assert "out[#out+1] = i" in once["count/shadowed"].text
    assert "  local _v = vector()\n  local _v_1 = vector()\n  for" in once["vector/two"].text.replace("_v_1 = vector()\n  local _v = vector()", "_v = vector()\n  local _v_1 = vector()")
    nested = once["vector/nested"].text
    assert nested.index("local _v = vector()") < nested.index("for i") and "local p = _v:set(i, j, 0)" in nested
    assert 'local _s_parts, _s_n = {}, 0' in once["text/long_chain"].text and '_s_parts[_s_n] = i .. ","' in once["text/long_chain"].text and 'local s = table.concat(_s_parts, "", 1, _s_n)' in once["text/long_chain"].text
    for path in ("text/short", "latch/plain", "vector/stored", "broken"):
        assert once[path].text == ALL.get(path, "function ("), path
    # At rest, and everything still parses.
    again = spark.createDataFrame([(p, r.text) for p, r in once.items()], "path string, text string")
    facts2, b2 = stored_facts(again), stored_bindings(again)
    assert {r.path for r in facts2.filter("kind = 'failure'").collect()} == {"broken"}
    assert [r.path for r in rewrite(again, P.proven_edits(again, facts2, b2, yellow=True)).collect() if r.applied] == []


def test_names_are_free(spark):
    src = loop("out[#out+1] = i").replace("return out", "local out_n, out_n_1 = 1, 2\n  return out")
    alias = "local ins = table.insert\n" + loop("ins(out, i)")
    both = "local ins = table.insert\n" + loop("ins(out, i)", after="ins(src, 1)")
    files = spark.createDataFrame([("taken", src), ("orphan", alias), ("read", both)], "path string, text string")
    facts, b = stored_facts(files), stored_bindings(files)
    got = {r.path: r.text for r in rewrite(files, P.arbitrated(facts, files, b)).collect()}
    assert "local out_n_2 = 0" in got["taken"] and "out_n_2 = out_n_2 + 1; out[out_n_2] = i" in got["taken"]
    assert got["orphan"] == alias  # the alias would be left without a reader
    assert re.search(r"out\[out_n\] = i", got["read"]) and "ins(src, 1)" in got["read"]
