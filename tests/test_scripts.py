"""Scripts: the parser, facts, rules and edits on hand-made texts."""

import pytest

from lodestar.scripts.edits import Edit, resolve
from lodestar.scripts.facts import facts_of
from lodestar.scripts.syntax import SyntaxFault, parse, string_value


@pytest.mark.parametrize(
    "text",
    [
        "", "#!/bin/lua\nreturn", "x = 1", "local a, b = f(), ...", "a.b['c']:d{1, 2; x = 3, [4] = 5}", "f'x' 'y'", "repeat local z = 1 until z", "for i = 1, 2, 3 do break end",
        "for k, v in pairs(t) do end", "while true do if x then break end end", "function a.b.c:d(...) return ... end", "local function f() return function() end end",
        "x = a or b and not c == d .. e + f * -g ^ h", "--[==[ long ]] ]==] x = [[\nlines]]", "x = 0xFF + 1e3 + .5 + 3.", "do ; end ; return 1", "(f or g)(1)", "x = #t", "return -- end",
    ],
)
def test_parses(text):
    parse(text)


@pytest.mark.parametrize("text", ["x = = 1", "if x then", "f(", "x + 1", "local 1 = 2", "for i = 1 do end", "'open", "a.1", "return return", "@"])
def test_faults_are_rows(text):
    with pytest.raises(SyntaxFault):
        parse(text)
    (row,) = facts_of(text)
    assert row[0] == "failure" and row[7] == "parse"


def test_nesting_is_a_row():
    assert facts_of("x = " + "(" * 100_000 + "1" + ")" * 100_000)[0][7] == "nesting"


def test_strings_and_precedence():
    assert string_value(r'"a\n\65\"\z"') == 'a\nA"z' and string_value("[[\nx]]") == "x"
    tree = parse("x = 1 + 2 * 3 ^ 4 ^ 5 .. 'a' .. 'b' == c").body[0].values[0]
    assert tree.op == "==" and tree.left.op == ".." and tree.left.right.op == ".."
    power = tree.left.left.right.right
    assert power.op == "^" and power.right.op == "^"


def found(text, kind):
    return [r for r in facts_of(text) if r[0] == kind]


def test_aliases_end_with_an_assignment():
    text = "local ins = table.insert\nins(t, 1)\nins = other\nins(t, 2)"
    assert [r[7] for r in found(text, "call")] == ["table.insert", "ins"]
    assert [r[7] for r in found("local table = x\ntable.insert(t, 1)", "call")] == ["x.insert"]


def test_branches():
    rows = found("if a() then b() elseif c() then d() else e() end", "call")
    assert [(r[7], [(x["fork"], x["branch"]) for x in r[10]]) for r in rows] == [("a", []), ("b", [(0, 0)]), ("c", [(0, 1)]), ("d", [(0, 1)]), ("e", [(0, -1)])]


def test_dead_code_needs_its_block():
    assert [r[7] for r in found("while x do break; f() end", "dead")] == ["break"]
    assert not found("if x then return end f()", "dead") and not found("do return end", "dead")


def test_shadowed_and_closed_over_locals():
    rows = {(r[1], r[7]): dict(r[12])["reads"] for r in found("local a = 1\nlocal function f()\n local a = 2\n return a\nend\nf()", "local")}
    assert rows[(1, "a")] == "0" and rows[(3, "a")] == "1" and rows[(2, "f")] == "1"


def made(text, *edits):
    return resolve(text, [Edit(*e) if isinstance(e, tuple) else e for e in edits])


def test_admission():
    assert made("abcdef") == ("abcdef", 0, 0)
    assert made("abcdef", (1, 2, "X"), (4, 5, "Y")) == ("aXcdYf", 2, 0)
    assert made("abcdef", (0, 4, "P", 1), (2, 6, "Q", 5)) == ("abQ", 1, 1)  # partly over each other: the first in rank
    assert made("f(a,b)", (2, 3, "A", 5), (0, 6, "g[a,b]")) == ("g[A,b]", 2, 0)  # wrapped, taken in
    assert made("f(a,a)", (2, 3, "A", 5), (0, 6, "g[a,a]"))[0] == "f(A,a)"  # the wrapped text occurs twice
    assert made("ab", (1, 1, "-"), (1, 1, "-"), (1, 1, "+", 3)) == ("a+-b", 2, 1)  # one insertion counts once
    assert made("f(x)", (3, 3, ", 1"), (0, 4, "g = (x) + 1")) == ("g = (x, 1) + 1", 2, 0)  # inside a replacement


def test_groups():
    lost = [Edit(0, 2, "A", 1, "g", False, True), Edit(3, 5, "B", 1, "g", False, True), Edit(4, 6, "C", 9)]
    assert resolve("abcdef", lost) == ("abcdC", 1, 2)
    alone = [Edit(0, 0, "local f = g;", 100, "c", True), Edit(2, 4, "", 200), Edit(2, 3, "f", 100, "c")]
    assert resolve("a g()", alone)[0] == "a )"  # an enabler goes with the last of its group
    inner = [Edit(1, 2, "I", 5), Edit(0, 3, "xbx", 1, "g", False, True), Edit(5, 6, "n", 0, "g", False, True), Edit(4, 6, "m", 7)]
    assert resolve("abcdef", inner)[0] == "aIcdm"  # what a lost group had taken in stays


@pytest.mark.parametrize(
    ("body", "uses"),
    [
        ("o:go()", 1), ("if o then o:go() end", 0), ("if o and o:go() then end", 0), ("if not o then return end o:go()", 0), ("if not o then f() end o:go()", 1), ("local y = o and o.x", 0),
        ("local y = not o or o.x", 0), ("if o == nil then return end o:go()", 0), ("if o ~= nil then o:go() else o:go() end", 1), ("o = f() o:go()", 0), ("if o then o = db.actor o:go() end", 1),
        ("while o do o:go() end", 0), ("f(o)", 0), ("if x then o:go() elseif o then o:go() end", 1), ("if o then end o:go()", 1), ("g = function() o:go() end", 1),
    ],
)
def test_nil_accesses(body, uses):
    assert len(found("local o = level.object_by_id(1) " + body, "nil_access")) == uses


def test_safe_nil_accesses():
    safe = lambda text: [dict(r[12]).get("safe") for r in found(text, "nil_access")]
    assert safe("local o = db.actor\no:go()") == ["1"] and safe("local o = db.actor\no:go()\no:stop()") == [None, None]
    assert safe("local o = db.actor\n\no:go()") == [None] and safe("local o = db.actor\nlocal x = o:go()") == [None] and safe("local o = db.actor\no:go()\nf(o)") == [None]
    assert not found("local o = other\no:go()", "nil_access") and [dict(r[12])["source"] for r in found("local o = x:parent()\no:go()", "nil_access")] == [":parent"]
