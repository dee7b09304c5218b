"""Held reads, the capture gate, whole programs, censuses: own scripts, each with what has to be found."""

import random

import pytest
from pyspark.sql import functions as F

from lodestar.scripts import censuses as S
from lodestar.scripts import edits as E
from lodestar.scripts import gate as G
from lodestar.scripts import program as W
from lodestar.scripts import proofs as P
from lodestar.scripts import rules as R
from lodestar.scripts.bindings import bindings_of, stored_bindings
from lodestar.scripts.facts import stored_facts


def files_of(spark, scripts: dict):
    return spark.createDataFrame(list(scripts.items()), "path string, text string")


HELD = {
    "plain": ("function f()\n  go(db.actor)\n  go(db.actor, db.actor, db.actor)\nend", "function f()\n  local actor = db.actor\n  go(actor)\n  go(actor, actor, actor)\nend"),
    "receiver": ("function f()\n  db.actor:a()\n  db.actor:b()\n  db.actor:c()\n  return db.actor\nend", "function f()\n  local actor = db.actor\n  actor:a()\n  actor:b()\n  actor:c()\n  return actor\nend"),
    "three": ("function f()\n  go(db.actor, db.actor, db.actor)\nend", None),
    "branch": ("function f(n)\n  n = 1\n  if n then go(db.actor) end\n  go(db.actor, db.actor, db.actor)\nend", "function f(n)\n  local actor = db.actor\n  n = 1\n  if n then go(actor) end\n  go(actor, actor, actor)\nend"),
    "one_branch": ("function f(n)\n  if n then\n    go(db.actor)\n    go(db.actor, db.actor, db.actor)\n  end\nend", "function f(n)\n  if n then\n    local actor = db.actor\n    go(actor)\n    go(actor, actor, actor)\n  end\nend"),
    "loop": ("function f(n)\n  for i = 1, n do\n    go(db.actor)\n    go(db.actor, db.actor, db.actor)\n  end\nend", "function f(n)\n  for i = 1, n do\n    local actor = db.actor\n    go(actor)\n    go(actor, actor, actor)\n  end\nend"),
    "rebound": ("function f(n)\n  go(db.actor)\n  db.actor = n\n  go(db.actor, db.actor, db.actor)\nend", None),
    "field_write": ("function f(n)\n  go(db.actor)\n  db.actor.x = n\n  go(db.actor, db.actor)\nend", "function f(n)\n  local actor = db.actor\n  go(actor)\n  actor.x = n\n  go(actor, actor)\nend"),
    "taken_name": ("function f(actor)\n  go(db.actor, actor)\n  go(db.actor, db.actor, db.actor)\nend", "function f(actor)\n  local actor_1 = db.actor\n  go(actor_1, actor)\n  go(actor_1, actor_1, actor_1)\nend"),
    "multiline": ("function f(n)\n  go(n,\n    db.actor,\n    db.actor)\n  go(db.actor, db.actor)\nend", "function f(n)\n  local actor = db.actor\n  go(n,\n    actor,\n    actor)\n  go(actor, actor)\nend"),
    "while_test": ("function f(n)\n  while go(db.actor) do n = 1 end\n  go(db.actor, db.actor, db.actor)\nend", None),
    "not_at_line": ("function f(n) go(db.actor, db.actor, db.actor, db.actor) end", None),
    "getter": ("function f(o)\n  go(o:id())\n  go(o:id(), o:id(), o:id())\nend", "function f(o)\n  local o_id = o:id()\n  go(o_id)\n  go(o_id, o_id, o_id)\nend"),
    "getter_of_field": ("function f(self)\n  go(self.object:id())\n  go(self.object:id(), self.object:id(), self.object:id())\nend", "function f(self)\n  local self_object_id = self.object:id()\n  go(self_object_id)\n  go(self_object_id, self_object_id, self_object_id)\nend"),
    "getter_guarded": ("function f(o)\n  go(o and o:id())\n  go(o:id(), o:id(), o:id())\nend", None),
    "getter_in_branch": ("function f(o)\n  if o then go(o:id()) end\n  go(o:id(), o:id(), o:id())\nend", None),
    "getter_yellow": ("function f(o)\n  go(o:profile_name(), o:profile_name())\n  go(o:profile_name(), o:profile_name())\nend", None),
    "unwarned_chain": ("function f(n)\n  alife():create(n)\n  go(alife(), alife(), alife())\nend", None),
    "warned_chain": ("function f(n)\n  alife():object(n)\n  go(alife(), alife(), alife())\nend", "function f(n)\n  local sim = alife()\n  sim:object(n)\n  go(sim, sim, sim)\nend"),
    "throttle": ("function f()\n  if time_global() - last < 250 then return end\n  last = time_global()\nend", "function f()\n  local tg = time_global()\n  if tg - last < 250 then return end\n  last = tg\nend"),
    "own_time": ("function f()\n  local t = time_global()\n  go()\n  log(time_global() - t)\nend", None),
    "closures": ("function f()\n  go(function()\n    go(db.actor)\n    go(db.actor, db.actor, db.actor)\n  end)\nend", "function f()\n  go(function()\n    local actor = db.actor\n    go(actor)\n    go(actor, actor, actor)\n  end)\nend"),
}


def test_held_reads(spark):
    files = files_of(spark, {k: v[0] for k, v in HELD.items()})
    facts, b = stored_facts(files), stored_bindings(files)
    rewritten = E.rewrite(files, P.hold_edits(files, facts, b))
    got = {r.path: r.text for r in rewritten.collect()}
    for k, (before, after) in HELD.items():
        assert got[k] == (after or before), k
    again = files_of(spark, got)
    assert P.hold_edits(again, stored_facts(again), stored_bindings(again)).count() == 0
    yellow = {r.path: r.text for r in E.rewrite(files, P.hold_edits(files, facts, b, ("GREEN", "YELLOW"))).collect()}
    assert "local o_profile = o:profile_name()" in yellow["getter_yellow"]
    assert G.captures(files, rewritten).count() == 0


SOURCE = "function f(actor, n)\n  go(n)\n  local x = actor\n  x = shared\n  local late = 1\n  return late\nend\n"
EDITS = {  # name: (edits of start, end, text; captured names)
    "parameter": ([(21, 21, "  local actor = 0\n")], {"actor"}),
    "fresh": ([(21, 21, "  local fresh = 0\n")], set()),
    "global": ([(21, 21, "  local shared = 0\n")], {"shared"}),
    "later_declared": ([(21, 21, "  local late = 0\n")], set()),
    "after_its_use": ([(SOURCE.index("  return"), SOURCE.index("  return"), "  local n = 0\n")], set()),
    "in_a_piece": ([(21, 21, "  local n = 0\n"), (23, 28, "run(n)")], {"n"}),
    "moved": ([(SOURCE.index("  local late"), SOURCE.index("  return"), ""), (SOURCE.index("  return"), SOURCE.index("  return"), "  local late = 2\n")], set()),
    "other_block": ([(21, 21, "  do local actor = 0 end\n")], set()),
    "no_edit": ([], set()),
}


def test_capture_gate(spark):
    assert SOURCE[21:23] == "  " and SOURCE[23:28] == "go(n)"
    files = files_of(spark, dict.fromkeys(EDITS, SOURCE))
    rows = [(k, s, e, t, 0, None, False, False) for k, (es, _) in EDITS.items() for s, e, t in es]
    made = E.rewrite(files, spark.createDataFrame(rows, "path string, start int, end int, text string, priority int, grp string, enabler boolean, atomic boolean"))
    got: dict = {k: set() for k in EDITS}
    for r in G.captures(files, made).collect():
        got[r.path].add(r.name)
    assert got == {k: v for k, (_, v) in EDITS.items()}
    kept = {r.path: (r.text, r.applied) for r in G.gated(files, made).collect()}
    assert kept["parameter"] == (SOURCE, 0) and "fresh" in kept["fresh"][0]


PROGRAM = {
    "a/_g.script": "function shout() end\nlocal function hidden() end\nfunction both() end",
    "a/_g_patches.script": "function both() end",
    "a/Logic.script": "function run() step() shout() both() hidden() LOGIC.run() other.go() other.gone() none.x() end\nlocal function step() end\nfunction step2() step() end\ncmd = {}\nfunction cmd.alive() end\nhandler = function() cmd.alive() end",
    "b/other.script": "function go() local f = Logic.step2 end\nfunction go() end\nfunction actor_on_update() go() end\nRegisterScriptCallback('npc_on_update', seen)\nfunction seen() obj:call() (f or g)() end",
    "z/other.script": "function gone() end",
    "broken.script": "function (",
}


def test_program(spark):
    b = stored_bindings(files_of(spark, PROGRAM))
    names = {r.node: f"{r.path.split('/')[-1].split('.')[0]}.{r.name}" for r in W.functions(b).collect()}
    edges = {(names[r.src], r.name): (names.get(r.dst), r.kind, r.ambiguous) for r in W.call_edges(b).collect()}
    want = {
        "step": ("Logic.step", "same-file", False), "shout": ("_g.shout", "global", False), "both": ("_g.both", "global", True), "hidden": (None, "unresolved", False),
        "LOGIC.run": ("Logic.run", "module", False), "other.go": ("other.go", "module", True), "other.gone": (None, "unresolved", False), "none.x": (None, "unresolved", False),
    }
    assert {k[1]: v for k, v in edges.items() if k[0] == "Logic.run"} == want
    assert edges["Logic.handler", "cmd.alive"] == ("Logic.cmd.alive", "same-file", False)
    assert {v[1] for k, v in edges.items() if k[0] == "other.seen"} == {"method", "value"}
    assert {names[r.node]: r.origin for r in W.frame_seeds(b).collect()} == {"other.actor_on_update": "name", "other.seen": "registration"}
    assert {names[r.node]: r.hop for r in W.frame_reach(b, 2).collect()} == {"other.actor_on_update": 0, "other.seen": 0, "other.go": 1}
    assert {r["name"] for r in W.unused_exports(b).collect()} == {"handler"}


def test_bindings_of_odd_scripts():
    assert bindings_of("")[:1] == [] and bindings_of("function (")[0][0] == "failure"
    rows = bindings_of("local a = a\nlocal function a() return a end\nrepeat local z = 1 until z\nfor a = a, 2 do go(a) end")
    uses = [(r[1], r[2]) for r in rows if r[0] == "use" and r[1] in "az"]
    places = [r[2] for r in rows if r[0] == "declare"]
    assert uses[0] == ("a", -1) and uses[1] == ("a", places[1]) and uses[2] == ("z", places[2]) and uses[3] == ("a", places[1]) and uses[4] == ("a", places[3])


def test_censuses(spark):
    src = 'function hear()\n  UnregisterScriptCallback("x", hear)\nend\nRegisterScriptCallback("x", hear)\nRegisterScriptCallback("y", hear)\nRegisterScriptCallback("x", function() end)\nif DEV then\n  log("a")\nend\n'
    files = files_of(spark, {"s": src, "t": "printf(go() .. 1)"})
    facts, b = stored_facts(files), stored_bindings(files)
    assert [(r.event, r.line, r.op) for r in S.self_churn(facts, b).collect()] == [("x", 2, "unregister")]
    assert [tuple(r) for r in S.churn_blind_spots(facts, b).collect()] == [(3, 1, 0)]
    assert {(r.path, r.line): (r.effects, r.sole) for r in S.debug_risks(facts).collect()} == {("s", 8): (None, True), ("t", 1): ("go", False)}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_admission_against_a_plain_search(seed):
    """Held spans found by bisection are those that a scan of all held ones finds: the text is the same for any order of equal edits."""
    rng = random.Random(seed)
    source = "".join(rng.choice("abcdefgh") for _ in range(300))
    edits = []
    for k in range(120):
        a = rng.randrange(300)
        z = min(300, a + rng.choice([0, 1, 2, 5, 30]))
        text = rng.choice(["X", source[a:z] + "!", f"<{source[a:z]}>"])
        edits.append((a, z, text, rng.choice([0, 0, 5]), rng.choice([None, None, f"g{k % 7}"]), a == z and rng.random() < 0.3, rng.random() < 0.3))
    text, applied, dropped, pieces = E.spliced(source, [E.Edit(*e) for e in edits])
    assert applied + dropped == len(edits)
    # What is between the pieces is the source, shifted.
    at = to = 0
    for s, e, ts, te in pieces:
        assert source[at:s] == text[to:ts] and s >= at
        at, to = e, te
    assert source[at:] == text[to:]


def test_module_level_writes_are_on_request(spark):
    facts = stored_facts(files_of(spark, {"s": "seen = 1\nfunction f() lost = 2 end"}))
    assert [r.pattern for r in R.global_writes(facts).collect()] == ["global_write"]
    assert sorted(r.pattern for r in R.global_writes(facts, module_level=True).collect()) == ["global_write", "module_global_write"]
    assert R.findings(facts).filter(F.col("pattern") == "module_global_write").count() == 0
