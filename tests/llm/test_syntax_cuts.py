"""Syntax verdicts: depth, modes, statements over lines, and cuts that change nothing."""

import random

import pytest
from test_syntax import BAD, BAD_TYPED, FILES, GOOD, MARKUP, REPORTS, TYPED

from codelode.llm import ecma, syntax

DEEP = {
    "else": "if (a) b;" + " else if (a) b;" * 5000, "condition": "x = " + "a ? b : " * 5000 + "c", "inner": "x = " + "a ? " * 5000 + "b" + ": c" * 5000, "arrow": "x = " + "a => " * 5000 + "b",
    "value": "a = " * 5000 + "b", "typeof": "typeof " * 5000 + "a", "brackets": "x = " + "[" * 20000 + "]" * 20000, "blocks": "{" * 5000 + "}" * 5000, "templates": "`${" * 3000 + "a" + "}`" * 3000,
    "elements": "x = " + "<a>" * 3000 + "</a>" * 3000, "new": "new " * 5000 + "a", "labels": "a: " * 5000 + "b",
}


@pytest.mark.parametrize("kind", DEEP)
def test_depth_is_no_fault(kind):
    assert ecma.valid(DEEP[kind], False, True)
    assert not ecma.valid(DEEP[kind] + "\nlet = = 3", False, True)


#: What script and module allow and refuse beyond the lists of the other tests.
FINE = [
    "[a.b, c[0], ...d.e] = x", "({a: b.c, d = 1, ...e.f} = x)", "for ([a, b] of c) {}", "for ({a = 1} of c) {}", "({a=1}) => a", "f(({a=1}) => a)", "[{a=1}, [b=2]] = x", "({a: {b=1}} = x)",
    "class A extends B { constructor() { super(); } m() { return super.m(); } x = super.y; static { super.z(); } }", "({ m() { return super.m() } })", "function F() { const g = () => new.target; }", "with (a) { b }",
    "<!-- page\nlet a = 1;\n--> end", "a ?? (b || c)", "a ?? b | c", "(-a) ** b", "2 ** -b", "x = a ? b : c = d", "x = a ? y => y : z => z", "for (var x = 1 in y) {}", "for (x.y of z) {}", "class A { constructor() {} static constructor() {} }", "x = a ? [y] = z : w",
]
WRONG = [
    "a ?? b || c", "a && b ?? c", "({a=1})", "f({a=1})", "super.x()", "new.target", "'use strict'; with(a){}", "08n", "for (const x = 1 of y){}", "class A { constructor(){} constructor(){} }", "[a+1] = b", "import a from 'b'; with (c) {}",
    "class A { m() { with (a) b } }", "function f() { super.x() }", "for (a + 1 of b) {}", "for (let a, b of c) {}", "-a ** b", "[f()] = x", "({a: 1} = x)", "({a}) = 1", "class A { get constructor() {} }", "x = a ? [y + 1] = z : w", "1 = [a] = b",
]


def test_targets_functions_and_modes():
    for t in FINE:
        assert syntax.judge(t, "js") is None, t
    for t in WRONG:
        assert syntax.judge(t, "js"), t


#: Statements that go on over a line that looks like the start of another.
GOES_ON = ["@Dec\nclass A {}", "@Dec()\nexport class A {}", "module.exports =\nfunction f() {}", "x = a ||\nfunction () {}", "export default\nfunction f() {}", "label:\nfunction f() {}", "export abstract\nclass A { abstract m(): void }"]
PYTHON = [
    "@a\n@b(1)\ndef f():\n    pass\nx = 1 + \\\ny\n", "if x:\n    a\n# note\nelse:\n    b\n", "'''doc'''\nfrom __future__ import annotations\nimport os\n", "x = (1,\n2)\ny = f'{d['k']}'\n", "x = '''\ndef f(:\n'''\n", "def f():\n    global a\n    a = 1\n",
    "x = 1\rdef f():\r    return 1\r", "if 1:\n    global q\n    q = 1\n", "try:\n    a\nexcept E:\n    b\nfinally:\n    c\n", "a = 1;b = 2\n", "class A:\n    x = [1,\n2]\n    def f(self): pass\n", "# only\n", "\x0cx = 1\n",
]
NO_PYTHON = ["x = 1\nfrom __future__ import annotations\n", "x = 1\nglobal x\n", "x = (1\ndef f():\n    pass\n", "from __future__ import nothing\n", "x = '''\n", "@a\nx = 1\n", "else:\n    a\n", "a = 1\n  b = 2\n", "x = 1 \\\n"]


@pytest.mark.parametrize("least", [1, 512])
def test_statements_over_lines(monkeypatch, least):
    monkeypatch.setattr(syntax, "LEAST_PIECE", least)
    for t in GOES_ON:
        assert syntax.judge(t, "ts") is None, t
    for t in PYTHON:
        compile(t, "t", "exec", dont_inherit=True)
        assert syntax.judge(t, "py") is None, t
    for t in NO_PYTHON:
        assert syntax.judge(t, "py"), t


LINES = [
    "x = 1", "def f():", "    return x", "class A:", "    pass", "if x:", "else:", "try:", "except:", "except E:", "finally:", "    global q", "global x", "@d", "x = (", ")", "'''", '"""', "# c", "", "from __future__ import annotations",
    "'doc'", "    yield", "await z", "async def g():", "    await z", "x = [1,", "]", "    break", "while x:", "f'{x}'", "x = 1 \\", "*a, b = c", "match x:", "    case 1: pass",
]


@pytest.mark.parametrize("least", [1, 20])
def test_python_as_the_compiler_says(monkeypatch, least):
    monkeypatch.setattr(syntax, "LEAST_PIECE", least)
    r = random.Random(7)
    valid = 0
    for _ in range(6000):
        text = "\n".join(r.choice(LINES) for _ in range(r.randrange(1, 7))) + r.choice(["", "\n"])
        try:
            compile(text, "t", "exec", dont_inherit=True)
            want = "none"
        except SyntaxError:
            want = "syntax"
        assert (syntax.judge(text, "py") or "none").startswith(want), text
        valid += want == "none"
    assert valid > 300


def test_long_files_are_cut(spark, rows):
    """The verdict of a text does not depend on its length."""
    script, python = "function f(a) {\n  return `${a}`;\n}\n" * 40_000, "def f(a):\n    return [a,\n1]\n" * 40_000
    assert min(len(script), len(python)) > syntax.LONG_CHARS
    good = {
        "ok.js": script, "element.jsx": script + "export const A = () => <p>it`s</p>;", "decorated.ts": script + "@Dec\nclass A {}\n" * 9, "ok.py": "'''doc'''\nfrom __future__ import annotations\n" + python,
        "text.py": python + "x = '''" + "def f(:\n" * 20_000 + "'''\n", "list.py": "x = [\n" + "1,\n" * 400_000 + "]\n", "tick.jsx": "const a = <p>one ` tick, /* and https://x.example</p>;\n" + script,
    }
    bad = {
        "open.js": script + "function g() {\n", "quote.js": script + "/* never closed", "middle.ts": script + "let = = 3\n" + script, "middle.py": python + "def g(:\n" + python,
        "late.py": python + "from __future__ import annotations\n" + python, "scope.py": python + "if x: return 1\n",
    }
    files = spark.createDataFrame([("r", p, t, "", "") for p, t in (good | bad).items()], FILES)
    assert rows(syntax.unparsable(files, spark.createDataFrame([], REPORTS))) == sorted(("r", p) for p in bad)


def test_cuts_anywhere_give_the_same(spark, rows):
    groups = {"js": GOOD + BAD + FINE + WRONG, "jsx": MARKUP, "ts": TYPED + BAD_TYPED + GOES_ON, "py": PYTHON + NO_PYTHON}
    texts = [(f"{i}.{e}", f"{a}\n{b}") for e, group in groups.items() for i, (a, b) in enumerate((a, b) for a in group for b in group[:3])]
    r = random.Random(5)
    texts += [(f"r{i}.py", "\n".join(r.choice(LINES) for _ in range(r.randrange(2, 9)))) for i in range(1500)]
    files = spark.createDataFrame([("r", p, t, "", "") for p, t in texts], FILES)
    want = rows(syntax.file_verdicts(files).select("path", "error"))
    cut = rows(syntax.file_verdicts(files, long_chars=8, size=12).select("path", "error"))
    assert [p for p, e in cut if e] == [p for p, e in want if e] and 300 < sum(e is not None for _, e in want) < len(want)
