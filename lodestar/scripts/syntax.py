"""Lexer and recursive-descent parser of the Lua 5.1 grammar; every node knows its place in the text."""

from __future__ import annotations

import re

KEYWORDS = frozenset("and break do else elseif end false for function if in local nil not or repeat return then true until while".split())

_TOKEN = re.compile(
    r"""(?P<space>\s+)
    |(?P<comment>--(?:\[(?P<c>=*)\[[\s\S]*?(?:\](?P=c)\]|\Z)|[^\n]*))
    |(?P<long>\[(?P<l>=*)\[[\s\S]*?\](?P=l)\])
    |(?P<string>"(?:\\[\s\S]|[^"\\\n])*"|'(?:\\[\s\S]|[^'\\\n])*')
    |(?P<number>0[xX][0-9a-fA-F]+|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)
    |(?P<name>[^\W\d]\w*)
    |(?P<op>\.\.\.|\.\.|==|~=|<=|>=|[-+*/%^\#<>=(){}\[\];:,.])""",
    re.VERBOSE,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "a": "\a", "b": "\b", "f": "\f", "v": "\v", "\n": "\n"}
#: Left and right binding powers.
BINARY = {
    "or": (1, 1), "and": (2, 2), "<": (3, 3), ">": (3, 3), "<=": (3, 3), ">=": (3, 3), "~=": (3, 3), "==": (3, 3),
    "..": (5, 4), "+": (6, 6), "-": (6, 6), "*": (7, 7), "/": (7, 7), "%": (7, 7), "^": (10, 9),
}
UNARY = 8


class SyntaxFault(ValueError):
    """A text that is no script: the line and what was found."""

    def __init__(self, line: int, found: str):
        super().__init__(f"line {line}: unexpected {found}")


class Node:
    """kind, lo and hi (characters, hi exclusive), line and last line, and the fields of its kind."""

    __slots__ = ("kind", "lo", "hi", "line", "last", "f")

    def __init__(self, kind: str, lo: int, hi: int, line: int, last: int, **fields):
        self.kind, self.lo, self.hi, self.line, self.last, self.f = kind, lo, hi, line, last, fields

    def __getattr__(self, name: str):
        try:
            return self.f[name]
        except KeyError:
            raise AttributeError(name) from None

    def children(self):
        """The nodes right below this one, in the order of the text."""
        for v in self.f.values():
            if isinstance(v, Node):
                yield v
            elif isinstance(v, (list, tuple)):
                for x in v:
                    if isinstance(x, Node):
                        yield x
                    elif isinstance(x, tuple):
                        yield from (y for y in x if isinstance(y, Node))

    def walk(self):
        """This node and all below it."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(reversed(list(node.children())))


def tokens(text: str) -> list[tuple[str, str, int, int, int]]:
    """(type, text, lo, hi, line) of everything but space and comments, and an end mark."""
    out, at, line = [], 0, 1
    if text.startswith("#"):  # a first line for the shell
        at = text.find("\n") if "\n" in text else len(text)
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise SyntaxFault(line, repr(text[at]))
        kind, value = m.lastgroup, m.group()
        if kind in ("c", "l"):
            kind = "comment" if m.group("comment") is not None else "long"
        if kind not in ("space", "comment"):
            out.append(("keyword" if value in KEYWORDS else kind, value, at, m.end(), line))
        line += value.count("\n")
        at = m.end()
    out.append(("end", "end of text", len(text), len(text), line))
    return out


def string_value(literal: str) -> str:
    """What a string literal stands for."""
    if literal[0] == "[":
        cut = literal.index("[", 1) + 1
        body = literal[cut:-cut]
        return body[1:] if body.startswith("\n") else body

    def one(m: re.Match) -> str:
        e = m.group(1)
        return chr(int(e)) if e.isdigit() else _ESCAPES.get(e, e)

    return re.sub(r"\\(\d{1,3}|[\s\S])", one, literal[1:-1])


class Parser:
    def __init__(self, text: str):
        self.text, self.tokens, self.at = text, tokens(text), 0

    @property
    def now(self) -> tuple:
        return self.tokens[self.at]

    def found(self, *values: str) -> bool:
        kind, value = self.now[:2]
        return value in values and kind in ("keyword", "op")

    def take(self, *values: str) -> tuple | None:
        if self.found(*values):
            self.at += 1
            return self.tokens[self.at - 1]
        return None

    def need(self, value: str) -> tuple:
        return self.take(value) or self.fail()

    def need_name(self) -> tuple:
        if self.now[0] != "name":
            self.fail()
        self.at += 1
        return self.tokens[self.at - 1]

    def fail(self):
        raise SyntaxFault(self.now[4], repr(self.now[1]))

    def node(self, kind: str, lo: int, line: int, **fields) -> Node:
        _, value, start, hi, last = self.tokens[self.at - 1]
        return Node(kind, lo, hi, line, last + value.count("\n"), **fields)

    def parse(self) -> Node:
        body = self.block()
        if self.now[0] != "end":
            self.fail()
        return body

    def block(self) -> Node:
        _, _, lo, _, line = self.now
        body = []
        while not (self.now[0] == "end" or self.found("end", "else", "elseif", "until")):
            if self.take(";"):
                continue
            body.append(self.statement())
        hi = body[-1].hi if body else lo
        return Node("block", lo, hi, line, body[-1].last if body else line, body=body)

    def statement(self) -> Node:
        _, value, lo, _, line = self.now
        method = getattr(self, f"on_{value}", None) if self.now[0] == "keyword" else None
        if method and value in ("if", "while", "do", "for", "repeat", "function", "local", "return", "break"):
            self.at += 1
            return method(lo, line)
        first = self.suffixed()
        if self.found("=", ","):
            targets = [first]
            while self.take(","):
                targets.append(self.suffixed())
            if any(t.kind not in ("name", "index") for t in targets):
                self.fail()
            self.need("=")
            values = self.expressions()
            return self.node("assign", lo, line, targets=targets, values=values)
        if first.kind not in ("call", "invoke"):
            self.fail()
        return self.node("do_call", lo, line, call=first)

    def on_if(self, lo: int, line: int) -> Node:
        tests, orelse, else_at = [], None, None
        tests.append((self.expression(), (self.need("then"), self.block())[1]))
        while self.take("elseif"):
            tests.append((self.expression(), (self.need("then"), self.block())[1]))
        mark = self.take("else")
        if mark:
            orelse, else_at = self.block(), mark[2]
        self.need("end")
        return self.node("if", lo, line, tests=tests, orelse=orelse, else_at=else_at, else_line=mark[4] if mark else None)

    def on_while(self, lo: int, line: int) -> Node:
        test = self.expression()
        self.need("do")
        body = self.block()
        self.need("end")
        return self.node("while", lo, line, test=test, body=body)

    def on_do(self, lo: int, line: int) -> Node:
        body = self.block()
        self.need("end")
        return self.node("do", lo, line, body=body)

    def on_repeat(self, lo: int, line: int) -> Node:
        body = self.block()
        self.need("until")
        test = self.expression()
        return self.node("repeat", lo, line, body=body, test=test)

    def on_for(self, lo: int, line: int) -> Node:
        names = [self.name()]
        if self.take("="):
            bounds = self.expressions()
            if not 2 <= len(bounds) <= 3:
                self.fail()
            self.need("do")
            body = self.block()
            self.need("end")
            return self.node("for_number", lo, line, names=names, bounds=bounds, body=body)
        while self.take(","):
            names.append(self.name())
        self.need("in")
        iterators = self.expressions()
        self.need("do")
        body = self.block()
        self.need("end")
        return self.node("for_in", lo, line, names=names, iterators=iterators, body=body)

    def on_function(self, lo: int, line: int) -> Node:
        target, method = self.name(), None
        while self.found(".", ":"):
            mark = self.take(".", ":")
            key = self.name()
            if mark[1] == ":":
                method = key
                break
            target = self.node("index", target.lo, target.line, of=target, key=key, dotted=True)
        return self.function(lo, line, target=target, method=method, statement=True)

    def on_local(self, lo: int, line: int) -> Node:
        if self.take("function"):
            name = self.name()
            return self.function(lo, line, target=name, local=True, statement=True)
        names = [self.name()]
        while self.take(","):
            names.append(self.name())
        values = self.expressions() if self.take("=") else []
        return self.node("local", lo, line, names=names, values=values)

    def on_return(self, lo: int, line: int) -> Node:
        ends = self.now[0] == "end" or self.found("end", "else", "elseif", "until", ";")
        values = [] if ends else self.expressions()
        return self.node("return", lo, line, values=values)

    def on_break(self, lo: int, line: int) -> Node:
        return self.node("break", lo, line)

    def function(self, lo: int, line: int, target: Node | None = None, method: Node | None = None, local: bool = False, statement: bool = False) -> Node:
        self.need("(")
        names = []
        while not self.found(")"):
            names.append(self.vararg() if self.found("...") else self.name())
            if not self.take(","):
                break
        self.need(")")
        body = self.block()
        self.need("end")
        return self.node("function", lo, line, target=target, method=method, local=local, statement=statement, names=names, body=body)

    def vararg(self) -> Node:
        _, _, lo, _, line = self.need("...")
        return self.node("vararg", lo, line)

    def name(self) -> Node:
        _, value, lo, _, line = self.need_name()
        return self.node("name", lo, line, id=value)

    def expressions(self) -> list[Node]:
        out = [self.expression()]
        while self.take(","):
            out.append(self.expression())
        return out

    def expression(self, least: int = 0) -> Node:
        kind, value, lo, _, line = self.now
        if kind in ("keyword", "op") and value in ("not", "-", "#"):
            self.at += 1
            operand = self.expression(UNARY)
            left = self.node("unary", lo, line, op=value, operand=operand)
        else:
            left = self.simple()
        while self.now[0] in ("keyword", "op") and self.now[1] in BINARY and BINARY[self.now[1]][0] > least:
            op = self.now[1]
            self.at += 1
            right = self.expression(BINARY[op][1])
            left = self.node("binary", left.lo, left.line, op=op, left=left, right=right)
        return left

    def simple(self) -> Node:
        kind, value, lo, _, line = self.now
        if kind == "number":
            self.at += 1
            number = float(int(value, 16)) if value[:2] in ("0x", "0X") else float(value)
            return self.node("number", lo, line, value=number)
        if kind in ("string", "long"):
            self.at += 1
            return self.node("string", lo, line, value=string_value(value))
        if kind == "keyword" and value in ("nil", "true", "false"):
            self.at += 1
            return self.node(value, lo, line)
        if self.found("..."):
            return self.vararg()
        if self.found("{"):
            return self.table()
        if self.take("function"):
            return self.function(lo, line)
        return self.suffixed()

    def table(self) -> Node:
        _, _, lo, _, line = self.need("{")
        fields = []
        while not self.found("}"):
            if self.take("["):
                key = self.expression()
                self.need("]")
                self.need("=")
                fields.append((key, self.expression()))
            elif self.now[0] == "name" and self.tokens[self.at + 1][:2] == ("op", "="):
                key = self.name()
                self.need("=")
                fields.append((key, self.expression()))
            else:
                fields.append((None, self.expression()))
            if not self.take(",", ";"):
                break
        self.need("}")
        return self.node("table", lo, line, fields=fields)

    def suffixed(self) -> Node:
        _, _, lo, _, line = self.now
        if self.take("("):
            inner = self.expression()
            self.need(")")
            out = self.node("paren", lo, line, inner=inner)
        else:
            out = self.name()
        while True:
            kind, value = self.now[:2]
            if self.take("."):
                key = self.name()
                out = self.node("index", lo, line, of=out, key=key, dotted=True)
            elif self.take("["):
                key = self.expression()
                self.need("]")
                out = self.node("index", lo, line, of=out, key=key, dotted=False)
            elif self.take(":"):
                key = self.name()
                args = self.arguments()
                out = self.node("invoke", lo, line, of=out, key=key, args=args)
            elif kind in ("string", "long") or self.found("(", "{"):
                args = self.arguments()
                out = self.node("call", lo, line, of=out, args=args)
            else:
                return out

    def arguments(self) -> list[Node]:
        if self.now[0] in ("string", "long"):
            return [self.simple()]
        if self.found("{"):
            return [self.table()]
        self.need("(")
        args = [] if self.found(")") else self.expressions()
        self.need(")")
        return args


def parse(text: str) -> Node:
    """The script's block; raises SyntaxFault, or RecursionError on nesting deeper than the interpreter allows."""
    return Parser(text).parse()
