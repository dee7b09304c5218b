"""Which declaration each name of a script means and what is done with it there: a row a mention.

A declaration is told by the place of its name, so rows of one script can be joined by it; -1 is a
global. Functions are told by their own place (-1 the script's top). Proofs about a variable are
aggregations and anti joins over its mentions.

Kinds: declare (use says local, parameter, loop, function, self), use, field (`a.b` of a global a), loop,
if, function, call, invoke, register, alloc (a `vector()`), failure. Uses: read (of an element or field), stored (an element written), append
(`t[#t + 1] = v`), insert (`table.insert(t, v)`), length, iterated (`pairs(t)`), called, receiver
(`t:m()`), passed (to a function), handed (to a method), written, grown (`s = s .. x`), plain.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from ..scratch import stored
from .facts import parsed, spread_out
from .syntax import Node, SyntaxFault, parse

SCHEMA = (
    "path string, kind string, name string, decl int, func int, home int, use string, line int, last int, lo int, hi int, "
    "block int, at_lo int, at_hi int, loops array<int>, more map<string,string>"
)
_INT = ("decl", "func", "home", "line", "last", "lo", "hi", "block", "at_lo", "at_hi")
_ARROW = pa.schema(
    [("path", pa.string()), ("kind", pa.string()), ("name", pa.string()), *[(c, pa.int32()) for c in _INT[:3]], ("use", pa.string()), *[(c, pa.int32()) for c in _INT[3:]],
     ("loops", pa.list_(pa.int32())), ("more", pa.map_(pa.string(), pa.string()))]
)
_CONSTANTS = ("number", "string", "true", "false")


class _Variable:
    __slots__ = ("at", "home", "alias")

    def __init__(self, at: int, home: int, alias: str | None = None):
        self.at, self.home, self.alias = at, home, alias


def _made(value: Node | None) -> str | None:
    """What a variable starts with."""
    if value is None:
        return None
    if value.kind == "table":
        if not value.fields:
            return "empty"
        if any(key is not None for key, _ in value.fields):
            return "keyed"
        return "literal" if all(v.kind in _CONSTANTS for _, v in value.fields) else "array"
    if value.kind == "string" and not value.value:
        return "empty_text"
    return value.kind


class Binder:
    """Rows of one script."""

    def __init__(self, text: str):
        self.text, self.rows = text, []
        self.scopes: list[dict[str, _Variable]] = [{}]
        self.func, self.block_at, self.loops, self.blocked, self.test = -1, -1, (), False, None
        self.nest: tuple[str, ...] = ()  # block:statement from the function's body to here
        self.again = False  # in a test that is read in every round
        self.at: Node | None = None

    def read(self) -> list[tuple]:
        self.block(parse(self.text))
        return self.rows

    def of(self, node: Node) -> str:
        return self.text[node.lo : node.hi]

    def add(self, kind: str, node: Node, name: str | None, use: str | None = None, decl: int = -1, home: int = -1, **more) -> None:
        at = self.at or node
        if kind in ("call", "invoke", "field"):
            more |= {"nest": " ".join(self.nest), "again": "1" if self.again else None}
        pairs = [(k, str(v)) for k, v in more.items() if v is not None]
        self.rows.append((kind, name, decl, self.func, home, use, node.line, node.last, node.lo, node.hi, self.block_at, at.lo, at.hi, list(self.loops), pairs))

    def find(self, name: str) -> _Variable | None:
        return next((s[name] for s in reversed(self.scopes) if name in s), None)

    def declare(self, node: Node, use: str, name: str | None = None, alias: str | None = None, **more) -> None:
        name = name or node.id
        # A method's self has no place of its own: it takes that of the function, less one for the method's name.
        at = node.lo if use != "self" else -2 - node.lo
        self.scopes[-1][name] = _Variable(at, self.func, alias)
        self.add("declare", node, name, use, at, self.func, **more)

    def mention(self, node: Node, use: str, **more) -> None:
        v = self.find(node.id)
        self.add("use", node, node.id, use, v.at if v else -1, v.home if v else -1, test=self.test, **more)

    def some(self, node: Node, use: str, **more) -> None:
        """A mention if the node is a name, else its parts."""
        if node.kind == "name":
            self.mention(node, use, **more)
        else:
            self.expression(node)

    def full(self, node: Node) -> str | None:
        """a.b.c, with an alias of a library function in its place; None for anything else."""
        if node.kind == "name":
            v = self.find(node.id)
            return node.id if v is None else v.alias
        if node.kind == "index" and node.dotted:
            left = self.full(node.of)
            return left and f"{left}.{node.key.id}"
        return None

    # -- statements

    def block(self, node: Node) -> None:
        outer, self.block_at = self.block_at, node.lo
        self.scopes.append({})
        for s in node.body:
            self.statement(s)
        self.scopes.pop()
        self.block_at = outer

    def statement(self, s: Node) -> None:
        outer, self.at, self.nest = (self.at, self.nest), s, (*self.nest, f"{self.block_at}:{s.lo}")
        getattr(self, f"on_{s.kind}", self.others)(s)
        self.at, self.nest = outer

    def others(self, s: Node) -> None:
        pass

    def on_local(self, s: Node) -> None:
        for v in s.values:
            if v.kind == "function":
                self.function(v, s.names[0].id if len(s.names) == 1 else None, True)
            elif self.scratch(v):
                self.vector(v, "local", s.names[0].lo if len(s.names) == 1 and len(s.values) == 1 else None)
            else:
                self.expression(v)
        single = len(s.names) == 1 and len(s.values) == 1
        for i, n in enumerate(s.names):
            value = s.values[i] if i < len(s.values) else None
            alias = self.full(value) if value is not None and value.kind in ("name", "index") else None
            self.declare(n, "local", alias=alias, made=_made(value), single="1" if single else None, count=len(s.names))

    def on_assign(self, s: Node) -> None:
        single = len(s.targets) == 1 and len(s.values) == 1
        target, value = s.targets[0], s.values[0] if s.values else None
        order = self.append_order(target) if single else None
        tail = self.grown(target, value) if single else None
        if order:
            self.mention(target.of, "append", order=order, value_lo=value.lo, value_hi=value.hi, value=value.kind, statement="1")
            self.expression(value)
            return
        if tail is not None:
            self.mention(target, "grown", value_lo=tail, value_hi=value.hi, statement="1")
            self.chain(value, skip=True)
            return
        for v in s.values:
            if v.kind == "function" and single:
                self.function(v, self.of(target), target.kind == "name" and self.find(target.id) is not None)
            else:
                self.expression(v)
        for i, t in enumerate(s.targets):
            own = s.values[i] if i < len(s.values) else None
            if t.kind == "name":
                self.mention(t, "written", single="1" if single else None, value=own.kind if own is not None else None)
            else:
                self.some(t.of, "stored")
                if not t.dotted:
                    self.expression(t.key)

    def append_order(self, t: Node) -> str | None:
        if t.kind != "index" or t.dotted or t.of.kind != "name" or t.key.kind != "binary" or t.key.op != "+":
            return None
        length = lambda e: e.kind == "unary" and e.op == "#" and e.operand.kind == "name" and e.operand.id == t.of.id
        one = lambda e: e.kind == "number" and e.value == 1
        if length(t.key.left) and one(t.key.right):
            return "after"
        return "before" if one(t.key.left) and length(t.key.right) else None

    def grown(self, target: Node, value: Node) -> int | None:
        """Of `s = s .. a .. b`: where `a .. b` begins."""
        if target.kind != "name" or value.kind != "binary" or value.op != "..":
            return None
        left, top = value, value
        while left.kind == "binary" and left.op == "..":
            left, top = left.left, left
        return top.right.lo if left.kind == "name" and left.id == target.id else None

    def chain(self, e: Node, skip: bool = False) -> None:
        """The operands of a concatenation, without the first."""
        while e.kind == "binary" and e.op == "..":
            self.expression(e.right)
            e = e.left
        if not skip:
            self.expression(e)

    def on_do_call(self, s: Node) -> None:
        c = s.call
        if self.scratch(c):
            self.vector(c, "statement")
        else:
            self.expression(c, statement=True)

    def on_do(self, s: Node) -> None:
        self.block(s.body)

    def on_if(self, s: Node) -> None:
        body = s.tests[0][1].body
        last = body[-1].lo if body else None
        self.add("if", s, None, tests=len(s.tests), orelse="1" if s.orelse is not None else None, count=len(body), tail=last)
        for i, (test, body) in enumerate(s.tests):
            outer, self.test = self.test, s.lo if not i else None
            self.expression(test)
            self.test = outer
            self.block(body)
        if s.orelse is not None:
            self.block(s.orelse)

    def loop_row(self, s: Node, name: str, trips: int | None = None) -> None:
        line_lo = self.text.rfind("\n", 0, s.lo) + 1
        before = self.text[line_lo : s.lo]
        own = not before.strip()
        after = self.text[s.hi : (self.text.find("\n", s.hi) + 1 or len(self.text) + 1) - 1]
        self.add("loop", s, name, trips=trips, line_lo=line_lo if own else None, indent=before if own else None, ends_line="1" if not after.strip() else None)

    def inside(self, s: Node, work) -> None:
        outer, self.loops = self.loops, (*self.loops, s.lo)
        work()
        self.loops = outer

    def on_while(self, s: Node) -> None:
        self.loop_row(s, "while")
        outer, self.again = self.again, True
        self.expression(s.test)
        self.again = outer
        self.inside(s, lambda: self.block(s.body))

    def on_repeat(self, s: Node) -> None:
        self.loop_row(s, "repeat")

        def work():
            outer, self.block_at = self.block_at, s.body.lo
            self.scopes.append({})
            for x in s.body.body:
                self.statement(x)
            before, self.again = self.again, True
            self.expression(s.test)  # the test sees the body's names
            self.again = before
            self.scopes.pop()
            self.block_at = outer

        self.inside(s, work)

    def counted(self, s: Node, name: str, header: list[Node], trips: int | None) -> None:
        self.loop_row(s, name, trips)
        alone = header[0] if name == "for in" and len(header) == 1 else None
        for h in header:
            self.expression(h, header=s.lo if h is alone else None)

        def work():
            self.scopes.append({})
            for n in s.names:
                self.declare(n, "loop")
            self.block(s.body)
            self.scopes.pop()

        self.inside(s, work)

    def on_for_number(self, s: Node) -> None:
        numbers = [b.value if b.kind == "number" else -b.operand.value if b.kind == "unary" and b.op == "-" and b.operand.kind == "number" else None for b in s.bounds]
        step = numbers[2] if len(numbers) > 2 else 1
        trips = None if None in numbers or not step else max(0, int((numbers[1] - numbers[0]) // step) + 1)
        self.counted(s, "for", s.bounds, trips)

    def on_for_in(self, s: Node) -> None:
        self.counted(s, "for in", s.iterators, None)

    def on_function(self, s: Node) -> None:
        self.function(s)

    def on_return(self, s: Node) -> None:
        for v in s.values:
            self.expression(v)

    def function(self, s: Node, given: str | None = None, private: bool = False) -> None:
        own = given or (None if s.target is None else self.of(s.target) + (f":{s.method.id}" if s.method else ""))
        bound = s.target is not None and s.target.kind == "name" and not s.local and self.find(s.target.id) is not None
        self.add("function", s, own, "local" if s.local or private or bound else "open")
        if s.local:
            self.declare(s.target, "function")
        elif s.target is not None and s.target.kind == "name":
            self.mention(s.target, "written" if s.method is None else "stored", value="function")
        elif s.target is not None:
            self.some(s.target.of, "stored")
        outer = self.func, self.loops, self.blocked, self.test, self.nest, self.again
        self.func, self.blocked, self.loops, self.test, self.nest, self.again = s.lo, self.blocked or bool(self.loops), (), None, (), False
        self.scopes.append({})
        if s.method:
            self.declare(s, "self", "self")
        for n in s.names:
            if n.kind == "name":
                self.declare(n, "parameter")
        self.block(s.body)
        self.scopes.pop()
        self.func, self.loops, self.blocked, self.test, self.nest, self.again = outer

    # -- expressions

    def expression(self, e: Node, statement: bool = False, header: int | None = None) -> None:
        kind = e.kind
        if kind == "name":
            self.mention(e, "plain")
        elif kind == "index":
            full = self.full(e)
            if full and self.of(e) == full:
                self.add("field", e, full)
            self.some(e.of, "read")
            if not e.dotted:
                self.expression(e.key)
        elif kind == "call":
            self.on_call(e, statement, header)
        elif kind == "invoke":
            self.add("invoke", e, e.key.id, receiver=self.of(e.of), args=len(e.args))
            self.some(e.of, "receiver", method=e.key.id)
            for a in e.args:
                if self.scratch(a):
                    self.vector(a, "handed", method=e.key.id)
                else:
                    self.some(a, "handed", method=e.key.id)
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
            self.some(e.operand, "length" if e.op == "#" else "plain")
        elif kind == "binary":
            self.expression(e.left)
            self.expression(e.right)

    def on_call(self, e: Node, statement: bool, header: int | None) -> None:
        full, args = self.full(e.of), e.args
        if full == "vector" and not args:
            self.vector(e, None)
            return
        own = e.of.id if full is None and e.of.kind == "name" else None  # a local that is called
        self.add("call", e, full or own, "local" if own else None, args=len(args), direct="1" if self.of(e.of) == full else None)
        if full == "RegisterScriptCallback" and len(args) > 1:
            self.add("register", e, self.of(args[1]), args[0].value if args[0].kind == "string" else self.of(args[0]))
        direct = self.of(e.of) == full
        self.some(e.of, "called")
        for i, a in enumerate(args):
            if a.kind != "name":
                self.expression(a)
            elif full in ("pairs", "ipairs") and len(args) == 1:
                self.mention(a, "iterated", callee=full, header=header, callee_lo=e.of.lo, callee_hi=e.of.hi)
            elif full == "table.insert" and len(args) == 2 and i == 0:
                alias = None if direct else self.of(e.of)
                self.mention(a, "insert", statement="1" if statement else None, alias=alias, value_lo=args[1].lo, value_hi=args[1].hi, value=args[1].kind, order="after")
            else:
                self.mention(a, "passed", callee=full)

    def scratch(self, e: Node) -> bool:
        """`vector():set(...)`."""
        inner = e.of if e.kind == "invoke" and e.key.id == "set" else None
        return inner is not None and inner.kind == "call" and not inner.args and self.full(inner.of) == "vector"

    def vector(self, e: Node, shape: str | None, decl: int | None = None, method: str | None = None) -> None:
        call = e.of if e.kind == "invoke" else e
        self.add("alloc", call, "vector", shape, decl if decl is not None else -1, self.func, method=method, blocked="1" if self.blocked else None)
        self.some(call.of, "called")
        if e.kind == "invoke":
            self.add("invoke", e, e.key.id)
            for a in e.args:
                self.some(a, "handed", method=e.key.id)


def bindings_of(text: str) -> list[tuple]:
    try:
        return Binder(text).read()
    except (SyntaxFault, RecursionError):
        return [("failure", None, -1, -1, -1, None, None, None, None, None, None, None, None, [], [])]


def bindings(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Mentions of all scripts (path, text); a null text is an empty one, one that can't be parsed is a row of kind `failure`."""
    return parsed(files.select(path, text), bindings_of, _ARROW, SCHEMA)


def stored_bindings(files: DataFrame) -> DataFrame:
    """`bindings`, parsed once and written to the shared folder."""
    return stored(bindings(spread_out(files)).sortWithinPartitions("kind", "path"))
