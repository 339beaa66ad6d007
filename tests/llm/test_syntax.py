import random

import pytest

from codelode.llm import ecma, lexmap, syntax

GOOD = [
    "let x = 1;", "a = b / c / d", "const f = async (x) => { await g(x); }", "for (let i = 0; i < 3; i++) { if (i) continue; else break; }", "x = y ? (a) : (b) => c",
    "class A extends B { #p = 1; static s = 2; get x() { return this.#p; } async *gen() { yield 1; } constructor() { super(); } }", "label: for (;;) { break label; }", "export default function () {}",
    'import a, { b as c } from "x";', "var {a, b: [c, d = 2], ...rest} = q;", "({a, b: [c]} = q);", "do x++; while (x < 5)", "`a${b}c${`d${e}`}`", "x = /[/]\\/(/.test(y)",
    "switch (x) { case 1: a(); break; default: b(); }", "new Foo(1).bar?.[0]?.(x)", "x = {async foo() {}, get a() { return 1 }, [k]: 2, ...z}", "const x = 1\nconst y = 2", "function* g() { yield* x }",
    "a ||= b; c ??= d; e **= 2", "try { } catch { }", "var a = 1_000n, b = .5, c = 0xff, d = 1e-5", "#!/usr/bin/env node\nx()", "!function(a){for(var z=1;z--;)a.x(z)}(this,{});", "x = y\n++z", "await x", "1..toString()",
    "if (a) b\nelse c", "export * as ns from 'y'; export {a as b}; export const q = 1", "x = a ? b : c ? d : e", "", "// only a comment", "/* } */",
]
BAD = [
    "let = ", "const = 4;", "let 2nd = 1", "function f( {", "if (ready {", 'x = "abc', "a b", "return 1", "const x;", "class A { private x: number }", "function f(a: string) {}", "export interface X {}", "let x = {a b}", "} x", "`abc", "foo(",
    "/* x", "a = = b", "import x", "<<<<<<< HEAD\nx", "=======", "const f = (x) => { await x }", "break;", "1 = 2", "for (;;", "a ? b", "new", "{ export const a = 1 }", "if (a) const x = 1;", "x++ = 1", "let x: number = 1", "a as b", "`${a", "x = )",
]
TYPED = [
    "let x: number = 1;", "function f(a: string[], b?: number): Promise<Map<string, number[]>> { return null as any }", "interface A<T = {}> extends B<T>, C { a: string; b?: number; readonly c: Date[]; [k: string]: any; m(x: number): void; new (x): A }",
    "type X = A | B & C; type F = (a: number) => void; type M = { [K in keyof T]?: T[K] }; type C2 = T extends infer U ? U : never", 'enum E { A = 1, B, C = "x" }', "const f = <T,>(x: T): T => x;",
    "class A<T> implements B<T> { private readonly x: Map<string, number> = new Map(); constructor(private a: string, public b?: number) { super() } static s?: string; get q(): number { return 1 } }", "let y = z!.a!.b",
    'declare module "x" { export function f(): void; }', 'export type { A } from "b"; import type { C } from "d"', "function f(x: unknown): x is string { return true }", "abstract class Q { abstract x: number; protected abstract m(): void }", "const q = a < b && c > d",
    "foo<string>(x); new Map<string, Array<number>>()", "let u = x satisfies Y", "@Dec() class Z { @Input() a: string; @Out() m(@P() x) {} }", "let v = a ? (b): c => d : e", "function over(a: string): void; function over(a: any) {}", "for (const x of y as Z[]) {}", "declare const VERSION: string;",
]
BAD_TYPED = ["let x: = 1", "interface { a: b }", "interface A { a: string", "function f(a: string[], b: number", "type = 1 2", "enum { A }", "const x: number;"]
MARKUP = ['const a = <div className="x" {...p} onClick={() => f(1)}>text {b} <br/> <A.B/></div>;', "function X() { return (<><p>{a.map((x) => <li key={x}>{x}</li>)}</p></>); }"]


@pytest.mark.parametrize("text", GOOD)
def test_valid(text):
    assert ecma.valid(text, False, True) and ecma.valid(text, True, False)


@pytest.mark.parametrize("text", BAD)
def test_invalid(text):
    assert not ecma.valid(text, False, True)


def test_types_and_markup():
    for t in TYPED:
        assert ecma.valid(t, True, False), t
    for t in BAD_TYPED + BAD[:4]:
        assert not ecma.valid(t, True, False), t
    for t in MARKUP:
        assert ecma.valid(t, False, True), t
    for t in ("x = <div>", "x = <a></b>", "x = <a>{</a>"):
        assert not ecma.valid(t, False, True), t


@pytest.mark.parametrize("language", ["script", "python"])
def test_maps_combine_as_the_whole(language):
    r = random.Random(3)
    pieces = {"script": ["{", "}", "(", ")", "`a", "`", "'x'", "/* ", " */", "// c\n", "\n", "a ", "${", "[", "]"], "python": ["{", "}", "(", ")", "'''", '"""', "'x'", "# c\n", "\n", "a ", "[", "]"]}[language]
    same = 0
    for _ in range(400):
        parts = ["".join(r.choice(pieces) for _ in range(r.randrange(1, 8))) + "\n" for _ in range(3)]
        maps = [lexmap.chunk_map(p, language) for p in parts]
        left = lexmap.combine(lexmap.combine(maps[0], maps[1]), maps[2])
        right = lexmap.combine(maps[0], lexmap.combine(maps[1], maps[2]))
        assert left[lexmap.CODE] == right[lexmap.CODE] or None in (left[lexmap.CODE], right[lexmap.CODE])
        whole = lexmap.chunk_map("".join(parts), language)[lexmap.CODE]
        # a combined map may give up, but never disagrees
        if left[lexmap.CODE] is not None and whole is not None:
            same += 1
            assert left[lexmap.CODE] == whole
    assert same > 50


def test_chunks_rejoin():
    text = "".join(f"line {i}\n" for i in range(5000)) + "x" * 3000
    assert "".join(lexmap.cut(text, 1000)) == text and max(map(len, lexmap.cut(text, 1000))) <= 1000


FILES = "repository_id string, path string, content string, error string, language string"
REPORTS = "repository_id string, file_path string, language string, success boolean, error string, path string"


def test_files(spark, rows, monkeypatch):
    files = spark.createDataFrame([("r", p, c, "clash", "clash") for p, c in [
        ("a.py", "def f(:"), ("b.py", "x = 1\n"), ("b.py", "x = 1\n"), ("c.js", "let 2nd = 1;"), ("d.ts", "let x: number = 1;"), ("e.jsx", ""), ("f.py", None), ("g.py", None), ("h.txt", "def f(:"), (None, "("),
        ("i.PY", "print 'x'"), ("j.py", "   \n"), ("k.ts", "﻿let a = 1;\r\n"), ("l.py", "x = '\n"), ("m.tsx", None),
    ]], FILES)
    reports = spark.createDataFrame([
        ("r", "b.py", None, False, "Syntax error: invalid syntax", ""), ("r", "f.py", None, False, "Syntax error: '(' was never closed", ""), ("r", "g.py", None, False, "Unexpected error: worker lost", ""),
        ("r", "m.tsx", None, None, "Syntax error", ""), ("r", "m.tsx", None, True, None, ""), ("q", "g.py", None, False, "Syntax error", ""),
    ], REPORTS)
    want = [("r", p) for p in ("a.py", "c.js", "f.py", "i.PY", "l.py")]
    assert rows(syntax.unparsable(files, reports)) == sorted(want)
    rates = {r.language: (r.n_files, r.n_invalid) for r in syntax.syntax_rates(files, reports).collect()}
    assert rates == {"Python": (7, 4), "JavaScript": (2, 1), "TypeScript": (3, 0)}
    assert rows(syntax.unparsable(spark.createDataFrame([], FILES), spark.createDataFrame([], REPORTS))) == []


#: Texts that Python parses and refuses only when it makes code.
NO_CODE = [
    "if x:\n    return 1\n", "class A:\n    return 1\n", "def f():\n    await g()\n", "def f():\n    async for a in b:\n        pass\n", "def f():\n    async with a:\n        pass\n",
    "x = await f()\n", "x = yield\n", "if x: break\n", "if x: pass\nelse: break\n", "a = *b\n", "*a, *b = c\n", "try:\n    pass\nexcept:\n    pass\nexcept E:\n    pass\n",
]


@pytest.mark.parametrize("text", NO_CODE)
def test_python_without_code(text):
    assert syntax.judge(text, "py").startswith("syntax")


GOES_ON = ["module.exports =\nfunction f() {}", "x = a ||\nfunction f() {}", "export default\nfunction f(){}", "export\nconst x = 1", "import a from 'b'\nx =\nclass {}\nconst y = 2"]


def test_statements_go_on_over_lines():
    for t in GOES_ON:
        assert ecma.valid(t, False, True) and ecma.valid(t, True, False), t
    for t in ("@A()\nclass X {}", "import a from 'b'\n@A({x: 1})\nexport class X {}\nconst y = 1", "export abstract\nclass A { abstract m(): void }", "x = y as\nconst"):
        assert ecma.valid(t, True, False), t
    for t in ("x =\nconst y = 1", "export\nfunction f( {", "if (x)\nclass A {}", "const f = 1\nreturn"):
        assert not ecma.valid(t, False, True), t


def test_length_does_not_change_the_verdict(spark, rows):
    head = "const a = <p>one ` tick, /* and https://x.example</p>;\n"
    body = head + "const f = (x) => { return x; };\n" * 40_000
    assert len(body) > syntax.LONG_CHARS and syntax.judge(head, "jsx") is None
    files = spark.createDataFrame([("r", "short.jsx", head, "", ""), ("r", "long.jsx", body, "", ""), ("r", "open.jsx", body + "f(", "", ""), ("r", "open.py", "x = 1\n" * 200_000 + "f(\n", "", ""), ("r", "ok.py", "x = 1\n" * 200_000, "", "")], FILES)
    assert rows(syntax.unparsable(files, spark.createDataFrame([], REPORTS))) == [("r", "open.jsx"), ("r", "open.py")]
