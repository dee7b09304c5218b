"""Code facts of scripts: one walk over each syntax tree, a row a fact, by an Arrow-batched function.

A script is read by itself, so its facts are bounded by its length and files are spread freely over
tasks. A text that can't be parsed gives one row of kind `failure`; the others are not affected.

Kinds: scope, call, index, assign, global_write, module_name, local, concat, self_concat, not_eq, pow,
dead, constant, needless_else, distance, closure, join (a concatenation), register, loop, leave (a
return), elapsed (a difference of clock readings), nil_access, failure.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import stored
from .syntax import Node, SyntaxFault, parse

SCHEMA = (
    "path string, kind string, line int, last int, lo int, hi int, scope int, func int, name string, args array<string>, "
    "kinds array<string>, chain array<struct<fork:int,branch:int>>, depth int, more map<string,string>"
)
_CHAIN = pa.list_(pa.struct([("fork", pa.int32()), ("branch", pa.int32())]))
_ARROW = pa.schema(
    [("path", pa.string()), ("kind", pa.string()), *[(c, pa.int32()) for c in ("line", "last", "lo", "hi", "scope", "func")], ("name", pa.string()),
     ("args", pa.list_(pa.string())), ("kinds", pa.list_(pa.string())), ("chain", _CHAIN), ("depth", pa.int32()), ("more", pa.map_(pa.string(), pa.string()))]
)

#: Callbacks that the engine calls once a frame, and method names that mean the same.
PER_FRAME = ("actor_on_update", "npc_on_update", "monster_on_update", "physic_object_on_update", "squad_on_update", "hud_update")
PER_FRAME_METHODS = ("update", "Update")
#: Callbacks that run often.
HOT = (
    "actor_on_update", "actor_on_first_update", "npc_on_update", "monster_on_update", "on_key_press", "on_key_release", "on_key_hold",
    "actor_on_weapon_fired", "actor_on_hud_animation_end", "on_before_hit", "on_hit", "physic_object_on_hit_callback", "npc_on_before_hit",
    "monster_on_before_hit", "npc_on_hit_callback", "monster_on_hit_callback", "actor_on_feel_touch", "actor_on_item_take",
    "actor_on_item_drop", "actor_on_item_use",
)

#: What may give nil, by name, by method, or as a property.
MAY_BE_NIL = frozenset(
    """level.object_by_id level.get_target_obj level.get_target_element level.get_target_pos level.vertex_position level.get_view_entity alife
    alife().object alife():object alife().story_object alife():story_object alife().actor alife():actor :parent :best_enemy :best_item :best_danger
    :best_weapon :best_cover :active_item :active_detector :object :get_enemy :get_corpse :get_current_outfit :item_in_slot :get_helicopter :get_car
    :get_campfire :get_artefact :get_physics_shell :spawn_ini :motivation_action_manager :get_current_holder :get_old_holder :memory_position
    :get_dest_enemy :bone_id :bone_position :bone_direction db.actor db.storage get_story_object get_object_by_name""".split()
)


def proven(test: Node, holds: bool) -> frozenset[str]:
    """Names that are not nil where a test holds, or where it does not."""
    if test.kind == "paren":
        return proven(test.inner, holds)
    if test.kind == "unary" and test.op == "not":
        return proven(test.operand, not holds)
    if test.kind == "name":
        return frozenset([test.id]) if holds else frozenset()
    if test.kind == "binary" and test.op == ("and" if holds else "or"):
        return proven(test.left, holds) | proven(test.right, holds)
    if test.kind == "binary" and test.op == ("~=" if holds else "==") and test.right.kind == "nil" and test.left.kind == "name":
        return frozenset([test.left.id])
    return frozenset()


def per_frame(name: str, method: bool) -> bool:
    """Whether a function of that name runs every frame."""
    if method and name in PER_FRAME_METHODS:
        return True
    return name in PER_FRAME or name.endswith("_on_update") and "first_update" not in name


class _Variable:
    __slots__ = ("name", "what", "line", "reads", "alias", "source", "since", "scope", "lines")

    def __init__(self, name: str, what: str, line: int, alias: str | None = None):
        self.name, self.what, self.line, self.alias, self.reads = name, what, line, alias, 0
        self.source, self.since, self.scope, self.lines = None, 0, None, []


class _Scope:
    __slots__ = ("id", "parent", "kind", "name", "line", "last", "func", "variables", "depth")

    def __init__(self, ident, parent, kind, name, node):
        self.id, self.parent, self.kind, self.name, self.line, self.last = ident, parent, kind, name, node.line, node.last
        self.func = ident if kind == "function" else parent.func if parent else -1
        self.depth = 0 if kind == "function" or parent is None else parent.depth + (kind == "loop")
        self.variables: dict[str, _Variable] = {}


class Reader:
    """The facts of one script."""

    def __init__(self, text: str):
        self.text, self.rows, self.scopes, self.chain, self.forks = text, [], [], (), 0
        self.scope: _Scope | None = None
        self.declared: list[tuple[_Scope, _Variable]] = []
        self.safe: frozenset[_Variable] = frozenset()
        self.at: Node | None = None
        self.accesses: list[tuple] = []

    def read(self) -> list[tuple]:
        tree = parse(self.text)
        self.enter("global", "<global>", tree)
        self.block(tree, False)
        self.leave()
        for v, node, at, scope, chain, since, source, home in self.accesses:
            others = sorted({x for x in v.lines if x > since and x != node.line})
            alone = at is not None and at.kind == "do_call" and at.line == at.last
            span = {"text": self.of(at), "at_lo": str(at.lo), "at_hi": str(at.hi)} if alone else {}
            self.chain = chain
            safe = alone and node.line == since + 1 and home is scope and not others
            self.add("nil_access", node, scope=scope, name=v.name, source=source, assign_line=str(since), others=",".join(map(str, others)), safe="1" if safe else None, **span)
        self.chain = ()
        for scope, v in self.declared:
            self.add("local", None, scope=scope, line=v.line, name=v.name, what=v.what, reads=str(v.reads), within=scope.name)
        return self.rows

    def of(self, node: Node) -> str:
        return self.text[node.lo : node.hi]

    def add(self, kind: str, node: Node | None, name: str | None = None, args=(), kinds=(), scope: _Scope | None = None, line: int | None = None, **more: str) -> None:
        scope = scope or self.scope
        where = (node.line, node.last, node.lo, node.hi) if node is not None else (line, line, None, None)
        chain = [{"fork": a, "branch": b} for a, b in self.chain]
        self.rows.append((kind, *where, scope.id, scope.func, name, list(args), list(kinds), chain, scope.depth, [(k, v) for k, v in more.items() if v is not None]))

    # -- scopes and names

    def enter(self, kind: str, name: str, node: Node) -> None:
        self.scope = _Scope(len(self.scopes), self.scope, kind, name, node)
        self.scopes.append(self.scope)
        if kind == "loop":
            self.add("loop", node, name=name)

    def leave(self) -> None:
        self.scope = self.scope.parent

    def declare(self, name: str, what: str, line: int, alias: str | None = None) -> _Variable:
        v = _Variable(name, what, line, alias)
        self.scope.variables[name] = v
        self.declared.append((self.scope, v))
        return v

    def holds(self, v: _Variable, value: Node | None, line: int) -> None:
        """What a variable holds from here on: where it came from, if that may be nil."""
        self.safe -= {v}
        full = None
        if value is not None and value.kind == "call":
            full = self.dotted(value.of) or self.of(value.of)
        elif value is not None and value.kind == "invoke":
            full = f"{self.of(value.of)}:{value.key.id}" if f"{self.of(value.of)}:{value.key.id}" in MAY_BE_NIL else f":{value.key.id}"
        elif value is not None and value.kind == "index":
            full = self.of(value)
        v.source, v.since, v.scope = (full if full in MAY_BE_NIL else None), line, self.scope

    def knowing(self, names: frozenset[str]) -> frozenset[_Variable]:
        return self.safe | {v for v in map(self.find, names) if v}

    def access(self, node: Node, of: Node) -> None:
        v = self.find(of.id) if of.kind == "name" else None
        if v and v.source and v not in self.safe:
            self.accesses.append((v, node, self.at, self.scope, self.chain, v.since, v.source, v.scope))

    def find(self, name: str) -> _Variable | None:
        s = self.scope
        while s:
            if name in s.variables:
                return s.variables[name]
            s = s.parent
        return None

    def dotted(self, node: Node) -> str | None:
        """a.b.c of plain names, else None."""
        if node.kind == "name":
            return node.id
        if node.kind == "index" and node.dotted:
            left = self.dotted(node.of)
            return left and f"{left}.{node.key.id}"
        return None

    # -- statements

    def block(self, block: Node, in_loop: bool) -> None:
        body, before = block.body, self.safe
        for i, s in enumerate(body):
            if s.kind == "return" or s.kind == "break" and in_loop:
                rest = body[i + 1 :]
                if rest:
                    dead = Node("dead", rest[0].lo, rest[-1].hi, rest[0].line, rest[-1].last)
                    self.add("dead", dead, name=s.kind, count=str(len(rest)))
            self.statement(s, in_loop)
            if s.kind == "if" and len(s.tests) == 1 and s.orelse is None and s.tests[0][1].body and s.tests[0][1].body[-1].kind in ("return", "break"):
                self.safe = self.knowing(proven(s.tests[0][0], False))
        self.safe &= before

    def inner(self, kind: str, name: str, block: Node, in_loop: bool, names=()) -> None:
        self.enter(kind, name, block)
        for n in names:
            self.declare(n.id, "loop", n.line)
        self.block(block, in_loop)
        self.leave()

    def statement(self, s: Node, in_loop: bool) -> None:
        kind, self.at = s.kind, s
        if kind == "local":
            for v in s.values:
                self.expression(v)
            for i, n in enumerate(s.names):
                value = s.values[i] if i < len(s.values) else None
                self.assigned(n, value, True)
                alias = self.dotted(value) if value is not None else None
                known = self.find(alias.partition(".")[0]) if alias else None
                v = self.declare(n.id, "variable", n.line, None if known and not known.alias else known.alias if known else alias)
                self.holds(v, value, n.line)
        elif kind == "assign":
            for v in s.values:
                self.expression(v)
            for i, t in enumerate(s.targets):
                value = s.values[i] if i < len(s.values) else None
                self.assigned(t, value, False)
                if t.kind == "name":
                    known = self.find(t.id)
                    if known:
                        known.alias = None
                        self.holds(known, value, t.line)
                        self.self_concat(t, value)
                    else:
                        self.self_concat(t, value)
                        self.add("global_write", t, name=t.id)
                        if self.scope.func < 0:
                            self.add("module_name", t, name=t.id)
                else:
                    self.expression(t.of)
                    if not t.dotted:
                        self.expression(t.key)
        elif kind == "do_call":
            self.expression(s.call, statement=True)
        elif kind == "do":
            self.inner("block", "do", s.body, in_loop)
        elif kind == "while":
            self.constant("while", s.test, s, False)
            self.expression(s.test)
            before, self.safe = self.safe, self.knowing(proven(s.test, True))
            self.inner("loop", "while", s.body, True)
            self.safe = before & self.safe | before
        elif kind == "repeat":
            self.enter("loop", "repeat", s)
            self.block(s.body, True)
            self.expression(s.test)  # the test sees the body's names
            self.leave()
        elif kind == "for_number":
            for b in s.bounds:
                self.expression(b)
            self.loop(s, "for")
        elif kind == "for_in":
            for b in s.iterators:
                self.expression(b)
            self.loop(s, "for in")
        elif kind == "if":
            self.branches(s, in_loop)
        elif kind == "function":
            self.function(s)
        elif kind == "return":
            for v in s.values:
                self.expression(v)
            self.add("leave", s)

    def loop(self, s: Node, name: str) -> None:
        self.enter("loop", name, s)
        for n in s.names:
            self.declare(n.id, "loop", n.line)
        self.block(s.body, True)
        self.leave()

    def branches(self, s: Node, in_loop: bool) -> None:
        fork, outer = self.forks, self.chain
        self.forks += 1
        first = s.tests[0]
        self.constant("if", first[0], s, len(s.tests) > 1 or s.orelse is not None)
        ends = lambda b: bool(b.body) and b.body[-1].kind in ("return", "break")
        if len(s.tests) == 1 and s.orelse is not None and ends(first[1]):
            self.add("needless_else", None, line=s.else_line, if_line=str(s.line))
        before = self.safe
        for i, (test, body) in enumerate(s.tests):
            if i:
                self.chain = (*outer, (fork, i))
            self.expression(test)
            self.chain = (*outer, (fork, i))
            failed = self.safe
            self.safe = self.knowing(proven(test, True))
            self.inner("block", "if" if not i else "elseif", body, in_loop)
            self.safe = failed
            self.safe = self.knowing(proven(test, False))
        if s.orelse is not None:
            self.chain = (*outer, (fork, -1))
            self.inner("block", "else", s.orelse, in_loop)
        self.chain, self.safe = outer, before

    def constant(self, where: str, test: Node, s: Node, branches: bool) -> None:
        if test.kind in ("nil", "false", "true", "number", "string"):
            self.add("constant", s, name=where, value=test.kind, branches="1" if branches else None)

    def assigned(self, target: Node, value: Node | None, local: bool) -> None:
        text = None if value is None else self.of(value)
        self.add("assign", target, name=self.of(target), value=text, value_kind=value.kind if value is not None else None, local="1" if local else None)

    def self_concat(self, target: Node, value: Node | None) -> None:
        """x = x .. y inside a loop."""
        left = value
        while left is not None and left.kind == "binary" and left.op == "..":
            left = left.left
        s = self.scope
        while s and s.kind not in ("loop", "function"):
            s = s.parent
        if left is not None and left is not value and left.kind == "name" and left.id == target.id and s and s.kind == "loop":
            self.add("self_concat", target, name=target.id, loop=str(s.id), loop_line=str(s.line), loop_last=str(s.last), outer=str(s.parent.id))

    def function(self, s: Node) -> None:
        name = "<anonymous>" if s.target is None else self.of(s.target) + (f":{s.method.id}" if s.method else "")
        if s.local:
            self.declare(s.target.id, "function", s.line)
        elif s.target is not None and s.target.kind == "name":
            known = self.find(s.target.id)
            if known:
                known.reads += 1
            elif s.method is None:
                if self.scope.func < 0:
                    self.add("module_name", s.target, name=s.target.id)
        if s.target is not None and s.target.kind == "index":
            self.expression(s.target.of)
        if self.scope.depth:
            self.add("closure", s, name=name)
        outer, self.chain, safe, self.safe = self.chain, (), self.safe, frozenset()
        at, holder = self.scope, self.at
        self.enter("function", name, s)
        last = name.rpartition(":")[2].rpartition(".")[2]
        more = {"parent": str(at.id), "body": str(s.body.lo), "frame": "1" if s.target is not None and per_frame(last, s.method is not None) else None, "hot": "1" if last in HOT else None}
        self.add("scope", s, name=name, args=[n.id for n in s.names if n.kind == "name"], **more)
        if s.method:
            self.declare("self", "parameter", s.line)
        for n in s.names:
            if n.kind == "name":
                self.declare(n.id, "parameter", n.line)
        self.block(s.body, False)
        self.leave()
        self.chain, self.safe, self.at = outer, safe, holder

    # -- expressions

    def expression(self, e: Node, statement: bool = False, in_concat: bool = False) -> None:
        kind = e.kind
        if kind == "name":
            v = self.find(e.id)
            if v:
                v.reads += 1
                v.lines.append(e.line)
        elif kind in ("call", "invoke"):
            self.call(e, statement)
        elif kind == "index":
            full = self.dotted(e)
            if full and not self.find(full.partition(".")[0]):
                self.add("index", e, name=full)
            self.access(e, e.of)
            self.expression(e.of)
            if not e.dotted:
                self.expression(e.key)
        elif kind == "function":
            self.function(e)
        elif kind == "table":
            for key, value in e.fields:
                if key is not None and key.kind != "name":
                    self.expression(key)
                self.expression(value)
        elif kind == "paren":
            self.expression(e.inner)
        elif kind == "unary":
            inner = e.operand.inner if e.operand.kind == "paren" else None
            if e.op == "not" and inner is not None and inner.kind == "binary" and inner.op in ("==", "~="):
                self.add("not_eq", e, name=inner.op, left=self.of(inner.left), right=self.of(inner.right))
            self.expression(e.operand)
        elif kind == "binary":
            self.binary(e, in_concat)

    def binary(self, e: Node, in_concat: bool) -> None:
        if e.op == "..":
            if not in_concat:
                leaves, stack = [], [e]
                while stack:
                    x = stack.pop()
                    if x.kind == "binary" and x.op == "..":
                        stack += [x.right, x.left]
                    else:
                        leaves.append(x)
                if all(x.kind == "string" for x in leaves):
                    self.add("concat", e, text="".join(x.value for x in leaves))
                self.add("join", e)
            self.expression(e.left, in_concat=True)
            self.expression(e.right, in_concat=True)
            return
        if e.op == "^" and e.right.kind == "number":
            self.add("pow", e, name=self.of(e.left), base=e.left.kind, negative="1" if e.left.kind == "unary" and e.left.op == "-" else None, exponent=_number(e.right.value))
        elif e.op in ("<", ">", "<=", ">="):
            for near, far, op in ((e.left, e.right, e.op), (e.right, e.left, {"<": ">", ">": "<", "<=": ">=", ">=": "<="}[e.op])):
                if near.kind == "invoke" and near.key.id == "distance_to" and far.kind == "number":
                    target = self.of(near.args[0]) if near.args else ""
                    spans = {"method_lo": near.key.lo, "method_hi": near.key.hi, "number_lo": far.lo, "number_hi": far.hi}
                    self.add("distance", e, name=self.of(near.of), target=target, op=op, threshold=_number(far.value), **{k: str(v) for k, v in spans.items()})
                    break
        if e.op == "-" and e.left.kind == "call" and self.of(e.left) == "time_global()" and e.right.kind == "name":
            self.add("elapsed", e, name=e.right.id)
        self.expression(e.left)
        before = self.safe
        if e.op in ("and", "or"):
            self.safe = self.knowing(proven(e.left, e.op == "and"))
        self.expression(e.right)
        self.safe = before

    def call(self, e: Node, statement: bool) -> None:
        args = [self.of(a) for a in e.args]
        more = {"statement": "1" if statement else None}
        if e.kind == "invoke":
            receiver = self.of(e.of)
            full, func, module = f"{receiver}:{e.key.id}", e.key.id, receiver
            self.access(e, e.of)
            more |= {"method": "1", "callee_lo": str(e.of.lo), "callee_hi": str(e.key.hi)}
        else:
            full = self.dotted(e.of) or self.of(e.of)
            first = full.partition(".")[0]
            v = self.find(first)
            if v and v.alias:
                more["alias"] = full
                full = v.alias + full[len(first) :]
            elif v:
                more["bound"] = "1"
            module, _, func = full.rpartition(".")
            more |= {"callee_lo": str(e.of.lo), "callee_hi": str(e.of.hi)}
        first = e.args[0] if e.args else None
        negative = first is not None and first.kind == "unary" and first.op == "-"
        numbers = ",".join(_number(a.value) if a.kind == "number" else "" for a in e.args)
        strings = next((a.value for a in e.args[1:2] if a.kind == "string"), None)
        self.add("call", e, name=full, args=args, kinds=[a.kind for a in e.args], func=func, module=module or None, negative="1" if negative else None, numbers=numbers, second=strings, **more)
        if full == "RegisterScriptCallback" and len(e.args) > 1:
            self.add("register", e, name=self.of(e.args[1]), event=e.args[0].value if e.args[0].kind == "string" else args[0])
        self.expression(e.of)
        for a in e.args:
            self.expression(a)


def _number(x: float) -> str:
    return str(int(x)) if x == int(x) else repr(x)


def facts_of(text: str) -> list[tuple]:
    """Facts of a script, or one of kind `failure` with its kind and message."""
    try:
        return Reader(text).read()
    except (SyntaxFault, RecursionError) as e:
        what = "parse" if isinstance(e, SyntaxFault) else "nesting"
        return [("failure", None, None, None, None, None, None, what, [], [], [], None, [("message", str(e))])]


#: Characters of scripts that one task reads: a core parses about 150 KB a second.
TASK_CHARACTERS = 4 << 20


def spread_out(files: DataFrame, text: str = "text") -> DataFrame:
    """The files dealt to tasks of about TASK_CHARACTERS, and to as many as run at a time at least: few splits of input hold many scripts."""
    total = files.agg(F.sum(F.length(text)).alias("n")).first().n or 0
    return files.repartition(max(files.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_CHARACTERS)))


def stored_facts(files: DataFrame) -> DataFrame:
    """Facts of all scripts, parsed once and written to the shared folder; sorted by kind in each file, so that a reader of one kind skips the others' row groups."""
    return stored(extract(spread_out(files)).sortWithinPartitions("kind", "path"))


#: Texts (of so many characters at most) that a task keeps the rows of: files are shipped by many mods, and a copy is not parsed again.
KEPT_TEXTS, KEPT_CHARACTERS = 256, 1 << 14
#: Rows that are handed on together.
BATCH_ROWS = 8192


def parsed(files: DataFrame, read: Callable[[str], list[tuple]], arrow: pa.Schema, schema: str) -> DataFrame:
    """The rows that `read` gives of each script (path, text), after its path; a null text is an empty one."""

    def columns_of(text: str) -> list[pa.Array] | None:
        rows = read(text)
        return [pa.array(c, f.type) for c, f in zip(map(list, zip(*rows, strict=True)), list(arrow)[1:], strict=True)] if rows else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = lru_cache(KEPT_TEXTS)(columns_of)
        ready: list[pa.RecordBatch] = []
        for batch in batches:
            for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                columns = (kept if len(t or "") <= KEPT_CHARACTERS else columns_of)(t or "")
                if columns:
                    ready.append(pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(p, pa.string()), len(columns[0])), *columns], schema=arrow))
                    if sum(map(len, ready)) >= BATCH_ROWS:
                        yield from pa.Table.from_batches(ready).combine_chunks().to_batches()
                        ready = []
        if ready:
            yield from pa.Table.from_batches(ready).combine_chunks().to_batches()

    return files.mapInArrow(run, schema)


def extract(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Facts of all scripts (path, text); a null text is an empty one. What reads them more than once should take `stored_facts`."""
    return parsed(files.select(path, text), facts_of, _ARROW, SCHEMA)
