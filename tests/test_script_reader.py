"""Declarations, imports, calls and routes of scripts, in texts that mislead patterns."""

import time

import pytest

from codelode.sources.script_reader import script_rows

TEXT = r"""import a, { b as c, type D } from "x";
import * as ns from 'y';
import type { T } from './t';
const e = require('e'), { f, g } = require("fg");
// import z from "no";
const s = "import q from 'no'";
export default async function* run(p: { a: string }, q = `x${call1(`n${deep()}`)}`): Promise<Map<string, { b: number }>> {
  const h = async (x: number): Promise<void> => { other(x); };
  return obj.method(p).chain?.(2);
}
function over(a: string): void;
function over(a: any) { new Foo(1); new ns.Bar(mk()); }
export class K<T extends { z: 1 }> extends Base implements I<T> {
  private readonly m = (a) => { arrowCall(); };
  constructor(private x: string) { super(x); this.init(); }
  get value(): { v: number } { return /[/]\/(function no() {/.test(y) ? 1 : 2; }
  async *gen<T>(a: T) { yield* x(); }
  abstract none(): void;
  #priv() {}
}
interface I<T> { a: T; f(x: number): void }
const one = x => x + 1, two = 3;
const obj2 = { short() { six(); }, async q() {} };
app.get('/a/:id', mw, handler);
router.post(`/b`, (req, res) => {});
router.put(`/c/${id}`, h);
x = "app.delete('/no', y)";
"""


def of(kind):
    return [r[1:] for r in script_rows(TEXT) if r[0] == kind]


def test_symbols():
    assert [(n, k, o, a, b) for n, k, o, a, b in of("symbol")] == [
        ("run", "function", None, 7, 10), ("h", "arrow_function", None, 8, 8), ("over", "function", None, 12, 12), ("K", "class", None, 13, 20), ("constructor", "method", "K", 15, 15),
        ("value", "method", "K", 16, 16), ("gen", "method", "K", 17, 17), ("#priv", "method", "K", 19, 19), ("I", "interface", None, 21, 21), ("one", "arrow_function", None, 22, 22),
    ]


def test_imports_calls_and_routes():
    assert [(m, n) for m, n, *_ in of("import")] == [("x", "a,b,D"), ("y", ""), ("./t", "T"), ("e", "e"), ("fg", "f,g")]
    assert [(c, f) for c, _, f, *_ in of("call")] == [
        ("call1", "run"), ("deep", "run"), ("other", "run"), ("method", "run"), ("chain", "run"), ("mk", "over"), ("arrowCall", None), ("init", None), ("test", None), ("x", None), ("six", None),
        ("get", None), ("post", None), ("put", None),
    ]
    assert [(h, r) for h, r, *_ in of("route")] == [("handler", "GET /a/:id"), (None, "POST /b")]


@pytest.mark.parametrize("text", ["", "`", "${", ")", "class", "class A {", "function f(", "const", "import", "import {", "app.get(", "a<b<c", "'it", "}}}", "import x from", "class A { f( }", "const a = require('b'"])
def test_broken_texts_end(text):
    script_rows(text)


@pytest.mark.parametrize("piece", ["x = a ? f(1) : ", "function f(a): ", "class A { f(a): ", "const a: ", "const f = <", "let a = b + \n", "import a ", "interface A<", "`${", "{ f(a) : ", "const a = (b) => {\n", "(", ")"])
def test_time_grows_with_the_text(piece):
    began = time.process_time()
    script_rows(piece * 4000)
    assert time.process_time() - began < 3
