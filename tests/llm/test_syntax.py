import ast
import glob
import json
import random
import re
import sysconfig
import tomllib
from datetime import datetime as dt

import pytest

from codeweft.llm import syntax
from codeweft.llm.chart import GRAMMARS, derives
from codeweft.llm.shapes import SEGMENTERS, distinct_segments, thin

FILE = "repo_id string, file_path string, content string, has_syntax_errors boolean, parsed_at timestamp_ntz, lang string, errors array<struct<message:string,node_type:string>>"


def edits(lang, text):
    return sum(not derives(s) for s in distinct_segments(lang, text))


GOOD = {
    "python": ["", "﻿x = 1", "\n\n# c\n", "def f(a, *b, c=1, **d) -> int:\n\treturn a if b else c\n", "x: int = 3; y = 4;\n", "@a.b(1)\nclass A(B, metaclass=M):\n    pass\nelse_ = 1\n",
               "for i, (a, *b) in c: print(i)\nelse: pass\n", "with (open(a) as f, g() as h):\n  x = [*f, {**h}]\n", "try:\n  a\nexcept (E, F) as e:\n  raise G from e\nfinally:\n  b\n", "match x:\n  case [1, y] if y: pass\n  case _: pass\n",
               "match = case = 1\nmatch.x(case)\n", "async def f():\n  async with a: await b\n  return [x async for x in y if not x]\n", "lambda *a, b=1: (yield)\n", "x = '''a\n\"'''\n", "a[1:2, ::3] = b'x' b'y'\n", "def f[T](x: T): ...\n", "if x:\n    y\r\nelse:\r\n    z\r\n", "x = (1 +\n  2)\n",
               "type X = int\ntype(x)\n", "del a, b[0]\nglobal c\nassert d, 'e'\nimport a.b as c, d\nfrom . import (e as f,)\nfrom .g import *\n", "print(x := 3, not y, -z ** -w)\n"],
    "javascript": ["", "const f = async ({a, b = 1}, ...c) => { await a?.b?.[c](d); };\n", "if (a) b(); else if (c) { d } else e()\n", "for (const x of y) z(x)\nfor (let i = 0, n = 3; i < n; i++) {}\nfor (k in o) ;\n",
                   "class A extends B.c { static x = 1; #p = 2\n constructor(a) { super(a) } get y() { return this.#p } static async *g() {} [k]() {} }\n", "x = a ? b : c ? d : e\n", "export default function () {}\nexport { a as b, c };\nimport d, { e as f } from './g'\nimport * as h from \"i\"\n",
                   "s = `a${b + `c${d}`}e`\n", "r = /[/({]\\/x/gi.test(y) / 2\n", "switch (a) { case 1: case 'b': c(); break; default: { d() } }\n", "try { a() } catch { b() } finally { c() }\n", "x = { a, b: 1, 'c': 2, [d]: 3, e() {}, get f() { return 1 }, async *g() {}, ...h, default: 4 }\n",
                   "a\n++b\n", "let a = 1\nlet b = a\n(function () {})()\n".replace("a\n(", "a;\n("), "!function(){}();(function(){}())\n", "do { x-- } while (x)\nlabel: for (;;) break label\n", "throw new Error('x' + y), z\n", "var a = function* () { yield* b }, c\n", "new A(new B).c\ndelete a.b, typeof c === 'd'\n", "// only )\n/* ( */\n"],
    "json": ["{}", "[1, -2.5e3, \"a\\n\\u00e9\", true, null, {\"a\": []}]", " 3 ", "﻿{\"a\": 1}"],
    "toml": ["", "a = 1\n[b.c]\nd = 'x' # y\n\"e f\" = [1,\n 2, # z\n]\n[[g]]\nh = {i = 1, j.k = \"l\"}\n[[g]]\nm = 2024-05-02T08:00:00\nn = \"\"\"o\n\"\"\"\np = +1_0.5e3\n", "a.b = true\r\nc = inf\r\n"],
}
BAD = {
    "python": ["def f(:\n  pass\n", "x = (1\n", "if x:\n", "  x\n y\n", "<<<<<<< HEAD\nx = 1\n=======\nx = 2\n>>>>>>> b\n", "a b\n", "x = 'a\n", '"""a', "1x = 2\n", "f(a=1, 2)\n", "return return\n", "for x y: pass\n", "try:\n  x\n", "class A:\nx = 1\n", "x ]\n", "{\n", "a = = b\n", "else:\n  x\n", "key: value: x\n", "@d\nx = 1\n", "f() = 1\n", "import\n", "x = 08\n"],
    "javascript": ["function f( {\n", "let x = ;\n", "if (a {}\n", "a b\n", "x = 'a\n", "class { m() { }\n", "<<<<<<< HEAD\na()\n=======\nb()\n>>>>>>> c\n", "def f(x):\n    return x\n", "const = 3\n", "for (;) {}\n", "x = {a: }\n", "`a${b`\n", "}\n", "return (\n", "import a b from 'c'\n", "a ? b\n", "/* open\n"],
    "json": ["", "{", "[1,]", "{'a': 1}", "{\"a\" 1}", "01", "\"a", "[1] 2", "{\"a\": NaN}", "nul", "[\"\t\"]"],
    "toml": ["a\n", "a =\n", "a = 1 2\n", "[a\n", "a = [1\n", "a = 'x\n", "a = 1\na = 2\n", "[t]\n[t]\n", "= 1\n", "a = truely\n", "a = 1\n<<<<<<< HEAD\nb = 1\n"],
}


MORE_GOOD = {
  "python": [
    "while (a or b) not in c: pass\nif (a)[b]: pass\nwhile [a][0]: pass\n",
    '(a) = 1\n', '(a, b) = 1\n', '((a, b)) = c\n', '[a, *b] = c\n', '(a): int = 1\n', 'for (a, b) in c: pass\n', 'for [a, *b], c in d: pass\n', 'with a as (b, c): pass\n',
    'with (a as b, c as d): pass\n', 'with (a, b): pass\n', 'with (a): pass\n', 'with (yield): pass\n', 'with (a) as b, c: pass\n', 'del (a, b), [c]\n', 'del (a)\n',
    '(a) += 1\n', 'a[0] += 1\na.b = 1\n(a.b) = 2\n', 'def f(a, /, b, *, c): pass\n', 'def f(a, b=1, /, c=2, *d, e, f=3, **g): pass\n', 'def f(*, a): pass\n',
    'def f(**k,): pass\n', 'def f(*a: *b): pass\n', 'lambda a, /, b=1, *c, d, **e: 0\n', 'lambda: 0\n', 'lambda *, a: 0\n', 'f(*a, b, *c, d=1, *e, **f, g=2, **h)\n',
    'f(a for a in b)\n', 'f(**a, b=1)\n', 'x = (*a,)\n', 'x = *a, b\n', 'print(*a)\n', 'x = f\'{a}{b!r:>{w}}{{}} {c=} {d["k"]}\'\n', "x = f'{a['b']}'\n",
    "x = f'''{\na\n}'''\n", "x = rf'\\d{a}'\n", "x = f'{x:%Y-%m-%d}'\n", 'x = f\'{a if b else c}\' \'d\' f"{e:{f}.{g}}"\n', "x = f'{lambda_}'\n", "x = f'{(lambda: 1)}'\n",
    "x = f'{a!r}'\nx = f'{a != b}'\nx = f'{a == b}'\n", 'x = f\'{"}"}\'\n', "x = '\\N{BULLET}'\n", "x = b'a' b'c'\n", 'if x:\n\ta\n\tb\n',
    "match x:\n  case 1+2j: pass\n  case -1: pass\n  case A.b | 'c': pass\n  case {'a': 1, **r}: pass\n  case P(x=0, y=[_, *r]): pass\n  case (1 | 2) as z if z > (0): pass\n  case [a as b, c]: pass\n  case str() | None: pass\n",
    'match (x):\n  case (1,\n    2): pass\n', 'match a, b:\n  case 1, *c: pass\n', 'match x:\n    case _:\n        pass\nmatch = 1\ncase(1)\n',
    'def f[T: int = str, *Ts, **P](a: T) -> T: ...\nclass A[T](B): pass\ntype X[T] = list[T]\n', 'a[b:=1]\na[*b]\na[1:2, *c]\na[:, None]\n', 'try:\n  a\nexcept* E: pass\n',
    'async def f():\n  async for x in y: pass\n  async with a as b, c: pass\n  await x\n', 'x = yield\n', 'def f(): return *a, b\n',
    "x = [a for a, in b]\nx = {a: b for a, b in c}\nx = {**a, 'b': 1}\nx = {*a, b}\n", '@a\n@b(c)\ndef f(): pass\n@(yield)\nclass A: pass\n', 'if a: b; c\nelse: d\n',
    'while a: break\nelse: pass\n', 'x = 1if a else 2\n', 'x = a if b else lambda: c\n', 'from .a import (b, c as d,)\nfrom ... import e\n', 'global a, b\n',
    'assert a, b\nraise A from b\nraise\n', 'x: int\nx.y: int = yield\n', "print(f'{x!r:^{width}.{precision}}')\n", 'x = 1\n', 'y\n', 'a = b = c\n',
    'a < b <= c != d is not e not in f\n', 'not a == b\n', '-a ** -b\n', 'x = a[1:2:3]\n', 'class A(metaclass=M, *b, **c): pass\n', "x = '''a\nb''' 'c'\n",
    'async def f(): return [x async for x in y]\n', 'x = (\n  1,\n  2\n)\n', "x = [\n'a'\n'b'\n]\n", 'f(x for x in y if z)\n', 'f(a)(b)[c].d\n', "print(a, end='')\n",
    'if (a := b): pass\n', '(a, b), c = d\n', '*a, b = c\n', 'for x in *a, b: pass\n', 'def f() -> (yield): pass\n', 'x = a or not b and c\n', 'with open(a) as f: pass\n',
    'x = 0x_ff + 1_000 + 1e-5 + .5 + 1. + 0o17 + 0b1 + 1j\n', 'def f(a, b, ): pass\n', 'lambda x=lambda: 1: x\n', '{1: 2, 3: 4,}\n', 'x = {}\n()\n[]\n', '() = x\n[] = y\n',
  ],
  "toml": [
    'a = 1979-05-27\nb = 07:32:00\nc = 1979-05-27T00:32:00.99-07:00\n', '[a.b.c]\nx = 1\n[a]\ny = 2\n[a.d]\n', '[[a]]\nb = 1\n[a.c]\nx = 1\n[[a]]\n[a.c]\nx = 2\n',
    'a.b = 1\na.c = 2\n', "3.14 = 'pi'\n", "'q' = 1\n", '[f]\na.c = 1\n[f.a.t]\ns = 1\n', 'x = {a.b = 1, a.c = 2}\n', 'x = [ [1], {a = 1}, ]\n', 'x = """a\\\n  b"""\n',
    "x = '''a''''\n", 'x = 0xDEADBEEF\ny = -inf\nz = 1e+5\n', '[ a . "b" ]\nx=1\n', '1234 = 1\ntrue = 2\n', 'x = 2000-02-29\n', 'x = "\\u00e9\\U0001F600"\n',
  ],
  "javascript": [
    'if (a) /x/.test(b)\n', 'do x(); while (y);\n', 'do x()\nwhile (y)\n', 'do { x() } while (y); z()\n', 'switch(a){case 1:b;break}\n', 'y = a++ / 2 / b;\n',
    'let async = 2;\n', 'x = class extends (a, b) {}\n', 'if (a) ; else ;\n', 'for (;;) ;\nwhile (a) ;\n',
    'for (const x of y) {}\nfor (const k in o) z()\nfor (let i = 0; i < 3; i++) {}\nfor (x.y of z) ;\nfor ([a, b] of c) ;\n',
    'const {a, b: {c = 1}, ...d} = e, [f, , g = 2] = h\n', '({a, b} = c);\n[a, b] = [b, a];\n', '({a = 1} = b);\n', 'x = a ?? b ?? c\nx = (a ?? b) || c\nx = a && b || c\n',
    'x = (-a) ** b\nx = a ** -b\nx = a ** b ** c\n', 'async () => {}\nasync x => x\nconst f = async (a) => await a\n', 'a = async\nasync()\nx.async = 1\n',
    "export const x = 1, y = 2\nexport async function f() {}\nexport class A {}\nexport default class extends B {}\nexport * from 'a'\nexport * as b from 'c'\nexport { d }\n",
    "import a, { b as c } from 'd'\nimport e, * as f from 'g'\nimport 'h'\nimport i from 'j' with { type: 'json' }\nimport { default as k } from 'l'\n",
    'export default async function () {}\n', 'export default { a: 1 }\n', 'export default (a) => a\n', "x = import('a')\ny = import.meta.url\n",
    "class A { static { x() } static a = 1; b; 'c' = 2; [d] = 3; get e() { return 1 } set e(v) {} static get f() { return 2 } async g() {} *h() {} async *i() {} #j() {} static async k() {} }\n",
    'class A {\n  a = 1\n  b\n  c() {}\n  d = () => { this.x }\n  static e\n}\n',
    "x = { get a() { return 1 }, set a(v) {}, async b() {}, *c() {}, 'd'() {}, 1: 2, [e]: f, if: 1, async: 2, get: 3, async, class: 4 }\n",
    'label: for (;;) { continue label }\n', 'try {} catch {} finally {}\n', 'x = a\n  ? b\n  : c\n', 'x = a ? { b: 1 } : { c: 2 }\n', 'x = a ? b : c ? d : e, f\n',
    'foo()\n  .then(x => x)\n  .catch(e => { throw e })\n', 'x = `a ${b ? `c${d}` : { e: 1 }.e} f`\n', 'tag`x${1}`\n', 'x = y / 2 / z\nx = (a) / 2\nx = a[0] / 2 / 3\n',
    'return_ = 1\n', 'function f() { return }\nfunction g() { return /x/ }\n', 'if (a) { return_ } else if (b) c()\nelse d()\n',
    'var x = function () {}, y = function z() {}\n', '(function () { })()\n;(() => {})()\n', 'new A\nnew A()\nnew (a())()\nnew a.b.C(1)\n', 'a?.b?.[c]?.(d)\n',
    "x = a in b, c instanceof d\ndelete a.b\nvoid 0\ntypeof a === 'b'\n", 'x = +a - -b + ++c\n', 'throw new Error(`a`)\n', 'var a; var a;\n', 'let a; { let a }\n',
    'function* g() { yield; yield a; yield* b; const x = yield }\n', 'x = 0x1f + 0b1 + 0o7 + 1_000 + 1n + .5 + 5. + 1e3\n', "x = '\\u{1F600}\\x41\\n'\n",
    'x = /[/]\\/(?<a>b)(?:c)+?/giu\n', "switch (a) { case b: { c } break\n default: d\n case 'e': case 'f':\n }\n", 'if (a) b\nelse c\n', 'while (a) b++\n',
    'const f = ({ a, b = 2 }, [c, d] = [], ...rest) => ({ a, c })\n', 'x = async function () { await a; for await (const b of c) {} }\n', 'a = b ? (c, d) : e => f\n',
    'var let_ = 1\nof = 2\nget = 3\nstatic_ = 4\n', 'x ||= 1; y ??= 2; z **= 3\n', '/* a */ x /* b */ = 1 // c\n', '#!/usr/bin/env node\nx = 1\n', "'use strict';\nx()\n",
    'a\n/b/g\n', 'x = a\n++b\n', 'if (a) function_()\n', 'module.exports = { a, b };\n', 'for (var i = 0, n = a.length; i < n; ++i) b[i] = c\n',
    'x = function () { return a }()\n', 'x = [1, , 2, ]\n', 'let a = 1,\n    b = 2,\n    c;\n', 'a = b\n;[c] = d\n', 'if (x) y = { a: 1 }\nelse z = {}\n',
    "export { a as default, b as 'c' }\n", 'while (1) { if (a) break; else continue }\n', 'x = !(await a)\n', '(async () => { await a })()\n',
    'for (const [k, v] of Object.entries(a)) f(k, v)\n', 'x = a => b => c\n', 'x = (a, b) => { c }\ny = z\n', 'x\n', 'x = { ...a, ...b }\nf(...a, b);\n[...a]\n',
  ],
}
MORE_BAD = {
  "python": [
    'f(**k, *a)\n', '(a, b) += 1\n', 'x = (*a)\n', "f'{a'\n", "f'{a b}'\n", "f'{}'\n", "f'{a!x}'\n", "f'}'\n", "x = '\\N{bad}'\n", 'def f(*): pass\n',
    'def f(*, **k): pass\n', 'def f(a, a=1, b): pass\n', 'def f(/, a): pass\n', 'def f(a, /, b, /): pass\n', 'def f(**k, a): pass\n', 'def f(**k, **l): pass\n',
    'def f(a, *b, *c): pass\n', 'lambda a=1, b: 0\n', "'a' 'b' b'c'\n", 'match x:\n case 1+2: pass\n', 'match x:\n case a + b: pass\n', 'match x:\n  y = 1\n',
    'match x:\n  case 1: pass\n  y\n', 'case 1: pass\n  x\n', 'if x:\n\ta\n        b\n', 'if x:\n        a\n\tb\n', '[a, b]: int = 1\n', '(a, b): int\n',
    'del f()\ndel a + b\n', 'del (a, *b)\n', 'for f() in x: pass\n', 'with a as f(): pass\n', '(a := 1) = 2\n', 'a := 1\n', 'f(a=1, b)\n', 'f(a for a in b, c)\n',
    '{a: b, c}\n', '{**a for a in b}\n', '[*a for a in b]\n', 'a == not b\n', 'x = a if b\n', 'import a as b.c\n', 'from x import (*)\n', 'from x import a,\n',
    'None = 1\n', 'def None(): pass\n', 'class 1: pass\n', 'x = 0777\n', 'x = 1__0\n', 'else_ = 1\nelse: pass\n', 'try: pass\n',
    'try: pass\nexcept A: pass\nexcept* B: pass\n', "print 'a'\n", "exec 'a'\n", 'except A, B: pass\n', 'raise A, B\n', 'a <> b\n', '`a`\n', 'x = $a\n', 'async x = 1\n',
    'a..b\n', '@x\ny = 1\n', 'f(x y)\n', 'return = 1\n', 'if x: pass else: pass\n', 'if a: for b in c: pass\n', 'x = {1: 2, 3}\n', 'x = [1, 2\ny = 3\n',
    'def f(x):\nreturn x\n', '  x = 1\n', "x = 'a\n", 'x = """a\n', "f'{a:{b}'\n", "f'{*a, b c}'\n", "x = f'{a['\n", 'a = 1 +\n', 'a, b += 1\n', 'lambda x: (yield) = 1\n',
    "'a' = 1\n", 'f(1=2)\n', 'f(a.b=2)\n', 'f(True=1)\n', 'x = yield = 1\n', 'while True print(1)\n', 'def f(x) return x\n', 'class A\n  pass\n',
    'for i in range(3)\n  pass\n', 'import\n', 'from a import\n', 'a = b = \n', 'if x = 1: pass\n',
    "\n".join("  " * i + "if x:" for i in range(101)) + "\n" + "  " * 101 + "pass\n",
  ],
  "toml": [
    'd = 2024-13-45\n', 'd = 2023-02-29\n', 'a = 1\n[a]\n', '"a" = 1\na = 2\n', 'x = {a = 1, a = 2}\n', '[a]\n[a]\n', '[a]\nb.c = 1\n[a.b]\n', 'a = {b = 1}\n[a.c]\n',
    'a = [1]\n[[a]]\n', '[[a]]\n[a]\n', 'x = {a = 1,}\n', 'x = {a = 1\n}\n', 'x = "\\e"\n', 'x = "\\ud800"\n', 'x = 01\n', 'x = 1.\n', 'x = .5\n', 'x = 1__0\n', '[a]]\n',
    '[[a]\n', '[ [a] ]\n', "x = 'a' 'b'\n", 'a b = 1\n', 'x = [1 2]\n', 'x == 1\n', 'x\n', '= 1\n', 'a. = 1\n', 'x = nope\n', 'a.b = 1\n[a]\n', 'a = 1\na.b = 2\n',
    'x = "a\nb"\n', 'x = 10:70:00\n', '\ta = \n', 'a = 1 b = 2\n',
  ],
  "javascript": [
    'const a;\n', 'return 1\n', '1 = a\n', 'f() = 1\n', 'a ?? b || c\n', '-a ** b\n', '/(/\n', 'with (a) {}\n', 'let a; let a;\n', 'const a = 1; let a = 2\n', 'let {a};\n',
    'x = {a = 1}\n', '[1] = a\n', 'a + b = c\n', 'if (a) { return 1 }\n', 'x = a ? b\n', 'x = a : b\n', 'for (;) {}\n', 'for (let x y) {}\n', 'function f( { }\n',
    'class A { x y }\n', 'x = {a: 1 b: 2}\n', 'x = [1 2]\n', 'f(a b)\n', 'import a from b\n', 'export a\n', 'var 1a = 2\n', 'x = 08\n', "x = '\\x4'\n", 'x = `a\n',
    "x = 'a\nb'\n", '} else {\n', 'if a { }\n', 'let x = y z\n', '=> a\n', 'a => \n', 'async = > b\n', 'def f(x):\n  return x\n', "print('a')\n  if x:\n    y\n",
    'x = @a\n', 'x++ = 1\n', 'a b c\n', 'x = /a**/\n', 'x = /a/gg\n', 'class { }\n', 'interface A { b: string }\n', 'let x: number = 1\n', 'function f(a: string) {}\n',
    'type A = { b: string }\n', 'enum A { B }\n', '<div>a</div>\n', '<<<<<<< HEAD\n', '=======\n', '>>>>>>> x\n', 'for (const x = 1 of y) {}\n', 'new\n', 'throw\n', 'a.\n',
    "import { a b } from 'c'\n", 'x = {a, b\n', 'function () {}\n', 'let let_ = ;\n', 'case 1: x\n', 'do x()\n', 'try {}\n', 'a?.b = 1\n', 'break_ = (1, ]\n',
  ],
}


@pytest.mark.parametrize(("lang", "text"), [(k, t) for d in (GOOD, MORE_GOOD) for k, v in d.items() for t in v])
def test_valid_sources_need_no_edit(lang, text):
    if lang != "javascript":
        assert syntax.parses(lang, text)
    assert edits(lang, text) == 0 and not syntax.file_repairs(lang, text)["edits"]


@pytest.mark.parametrize(("lang", "text"), [(k, t) for d in (BAD, MORE_BAD) for k, v in d.items() for t in v])
def test_invalid_sources_need_edits(lang, text):
    if lang != "javascript":
        assert not syntax.parses(lang, text)
    assert edits(lang, text) > 0 and syntax.file_repairs(lang, text)["edits"]


def test_library_files_changed_anywhere_agree_with_the_reader():
    """Pieces of the standard library, whole and with a token taken out, repeated or replaced: the grammars and the reader agree."""
    rnd = random.Random(3)
    for f in rnd.sample(sorted(glob.glob(sysconfig.get_paths()["stdlib"] + "/*.py")), 25):
        lines = open(f, encoding="utf-8").read().split("\n")
        a = rnd.randrange(max(1, len(lines) - 60))
        while a and not lines[a].startswith(("def ", "class ", "import ")):
            a -= 1
        text = "\n".join(lines[a : a + 120]) + "\n"
        spots = [m.span() for m in re.finditer(r"\w+|[^\w\s]|\n *", text)]
        for k in range(6):
            (s, e), (x, y) = rnd.choice(spots), rnd.choice(spots)
            t = (text, text[:s], text[:s] + text[e:], text[:s] + text[x:y] + text[e:], text[:s] + " " + text[x:y] + " " + text[s:], text[:s] + text[e:])[k]
            assert syntax.parses("python", t) == (edits("python", t) == 0), (f, t)


def test_segments_without_places_are_the_same():
    cut = SEGMENTERS["python"][1]
    texts = [t for d in (GOOD, MORE_GOOD, BAD, MORE_BAD) for t in d["python"]] + [open(f, encoding="utf-8").read() for f in sorted(glob.glob(sysconfig.get_paths()["stdlib"] + "/*.py"))[:40]]
    for t in texts:
        assert sorted(x[:2] for x in cut(t, True)) == sorted(x[:2] for x in cut(t)), t[:200]
    for goal, shape, places in cut(texts[-1]):
        assert len(places) == len(shape) or not shape


def test_shortened_shapes_derive_alike():
    rnd = random.Random(5)
    for lang, goal, parts in (("py", "args", ["N", "N=N", "*N", "PN", "N N"]), ("py", "params", ["N", "N=N", "*N", "*", "PN", "/"]), ("py", "braces", ["N", "N:N", "*N", "PN", "LN:N"]), ("js", "array_pattern", ["N", "", "ZN", "N=0"]), ("js", "params", ["N", "N=0", "ZN", "3"])):
        for _ in range(300):
            shape = ",".join(rnd.choice(parts) for _ in range(rnd.randrange(9)))
            assert derives(f"{lang}.{goal} {shape}") == derives(f"{lang}.{goal} {thin(goal, shape)}"), shape
    for _ in range(300):
        shape = "".join(rnd.choice([";", "iB", "eB", "lB", "fB", "db", "tB", "xB", "yB", "@", "wB"]) for _ in range(rnd.randrange(1, 9)))
        assert derives(f"py.block {shape}") == derives(f"py.block {thin('block', shape)}"), shape


def test_least_cost_is_least():
    def distance(goal, shape, limit=2):  # brute force: all strings within so many edits
        alphabet, level = "SN0oq:,", {shape}
        g = GRAMMARS["json"]
        for k in range(limit + 1):
            if any(g.cost(goal, s) == 0 for s in level):
                return k
            level = {x for s in level for i in range(len(s) + 1) for x in [s[:i] + s[i + 1 :], *(s[:i] + c + s[i + 1 :] for c in alphabet), *(s[:i] + c + s[i:] for c in alphabet)]}
        return limit + 1

    for goal, shape in (("object", "S:0,"), ("object", "S0"), ("object", "S:0S:0"), ("array", "0,,"), ("array", ",0"), ("object", "S::0"), ("doc", "00")):
        assert GRAMMARS["json"].cost(goal, shape) == distance(goal, shape)


def test_long_shapes_are_repaired_in_full():
    n = 700
    assert GRAMMARS["json"].cost("array", ",".join(["0", "S"] * n)) == 0
    assert GRAMMARS["json"].cost("array", "0 ".replace(" ", "S,") * n + "0") == n
    edits_at = GRAMMARS["py"].repair("simple", "N=" + "-".join(["N"] * 3000) + "-")
    assert edits_at == [(6001, "~")] or edits_at == [(6001, "-")] or len(edits_at) == 1


def test_places_and_kinds():
    r = syntax.file_repairs("python", "a = 1\nb = (2 3)\nc = 4\n")
    assert r["kind"] == "local" and r["edits"][0]["line"] == 2 and r["edits"][0]["part"] == "paren" and len(r["edits"]) == 1
    assert syntax.file_repairs("python", "a = 1\ndef f(x):\n    return [x,\n")["kind"] == "truncation"
    assert syntax.file_repairs("python", "a = 1\ndef f(x):\n    if x:\n")["kind"] == "truncation"
    assert syntax.file_repairs("python", "try:\n    a\nb = 1\nc = 2\nd = 3\n")["kind"] == "local"
    assert syntax.file_repairs("python", "a = 1\n<<<<<<< HEAD\nb = 2\n=======\nb = 3\n>>>>>>> x\n")["kind"] == "conflict"
    assert syntax.file_repairs("python", "function f() {\n  return a + b;\n}\nvar x = new Y;\n")["kind"] == "mismatch"
    assert syntax.file_repairs("json", '{"a": [1, 2')["kind"] in ("truncation", "mismatch")
    twice = syntax.file_repairs("python", "x = a b\ny = 1\ny = 2\nx = a b\n")
    assert [e["line"] for e in twice["edits"]] == [1, 4]  # every occurrence counts


def frame(spark, data):
    return spark.createDataFrame([(r, p, c, s, t, "zz", None if s is None else [("m", "ERROR")]) for r, p, c, s, t in data], FILE)


def test_current_revision_ties_nulls_and_report(spark):
    t = [dt(2024, 1, d) for d in (1, 2, 3)]
    data = [
        ("r", "a.py", "x = (", None, t[0]), ("r", "a.py", "x = 1", True, t[1]), ("r", "b.py", "x = 1", None, t[0]), ("r", "b.py", "x = (", True, t[2]), ("r", "b.py", "x = (", True, t[2]),
        ("r", "c.json", None, None, t[0]), ("r", "d.py", None, None, t[0]), ("r", "e.txt", "((", None, t[0]), ("r", "f.toml", "a = ", None, None), (None, "g.py", "((", None, t[0]), ("r", None, "((", None, t[0]),
        ("q", "h.js", "function f() {\n  return '}'\n", None, t[0]), ("q", "i.js", "<<<<<<< a\nx()\n=======\ny()\n>>>>>>> b\n", None, t[0]), ("q", "j.PY", "import (", None, t[0]), ("q", "k.js", "SELECT a FROM b WHERE c", None, t[0]),
    ]
    got = {(r.repo_id, r.file_path): r.kind for r in syntax.syntax_repairs(frame(spark, data)).collect()}
    assert set(got) == {("r", "b.py"), ("r", "c.json"), ("r", "f.toml"), ("q", "h.js"), ("q", "i.js"), ("q", "j.PY"), ("q", "k.js")}
    assert got["q", "i.js"] == "conflict" and got["q", "h.js"] in ("truncation", "mismatch")
    rep = {(r.repo_id, r.lang): (r.n_files, r.n_invalid, r.n_recorded) for r in syntax.syntax_report(frame(spark, data)).collect()}
    assert rep["r", "python"] == (3, 1, 1) and rep["q", "javascript"] == (3, 3, 0) and rep["r", "json"] == (1, 1, 0)


def test_empty_table(spark):
    df = frame(spark, [("r", "a.py", "", None, None)]).limit(0)
    assert syntax.syntax_repairs(df).count() == 0 and syntax.syntax_report(df).count() == 0


def test_readers_are_the_exact_ones():
    assert syntax.parses("python", "") and ast.parse("") and not syntax.parses("json", "") and json.loads("1") == 1 and tomllib.loads("") == {}


def test_the_reader_only_takes_back(spark):
    """Files the reader cannot judge, and coding lines, which say nothing here."""
    good = [("r", "k.json", "1" * 5000, None, None), ("r", "l.json", "[" * 1500 + "]" * 1500, None, None), ("r", "m.py", "# -*- coding: none-such -*-\nx = 1\n", None, None), ("r", "n.toml", "a = 1\n", None, None)]
    assert syntax.syntax_repairs(frame(spark, good)).count() == 0


def test_recorded_types(spark):
    t = dt(2024, 1, 1)
    data = [("r", "a.py", "x = (", True, t), ("r", "b.py", "x = 1", True, t), ("r", "c.py", "x = 1", None, t)]
    got = {(r.kind, r.node_type): r.n_files for r in syntax.recorded_types(frame(spark, data)).collect()}
    assert got == {("truncation", "ERROR"): 1, ("valid", "ERROR"): 1, ("valid", None): 1} or got == {("mismatch", "ERROR"): 1, ("valid", "ERROR"): 1, ("valid", None): 1}
