"""The parser, scopes, flows and fixes on what the queries' fixtures don't reach."""

import pytest

from lumenlint import api
from lumenlint.javascript import fixes
from lumenlint.javascript.parser import ParseError, parse
from lumenlint.javascript.rules import File, facts
from lumenlint.operators.code import relative, renamed
from lumenlint.operators.reports import to_fixed

READABLE = [
    ("a.ts", "const a = <T,>(x: T) => x;\nexport default async function* g<T extends U = V>(this: X, ...r: T[]): AsyncIterable<T> { yield* r }"),
    ("a.tsx", "const x = <div a='b' {...p} c={d}>{/* c */} it's {a < b ? <B.C/> : <></>}</div>;"),
    ("a.js", "for (const [a,{b=2}] of c) { if (a in b) x = y / 2 / 3; }\nvar q = /a[/]b\\/c/g.test(s) / 2"),
    ("a.ts", "@In() export class A<T> extends B<T> implements C { @In() x!: string; constructor(private readonly a: X) { super() } get y(): number { return 1 } static { a() } [k: string]: any; async *gen() {} #p = 1 }"),
    ("a.ts", "type A = { readonly [K in keyof T]?: T[K] } & ((x: any) => x is string);\ndeclare module 'x' { export const a: any }\nabstract class Q { abstract x(): void }\nlet v = a as unknown as B[]; let w = f<string>(x) < y;"),
    ("a.js", "x = async () => { await y }\nasync function f() {}\na?.b?.[c]?.(d); `a${b}c${`d${1}`}`; label: for (;;) { continue label }"),
    ("a.ts", "import type X, { type Y as Z } from 'q' with { type: 'json' };\nexport * as n from './n';\nexport type { A } from './a';\nimport r = require('r');\nenum E { A = 1, B }\nnamespace N.M { export let x = 1 }"),
    ("a.js", "#!/usr/bin/env node\nif (a)\n  b\nelse c\nreturn\nlet\ny = 1"),
]


@pytest.mark.parametrize("path, text", READABLE)
def test_readable(path, text):
    parse(path, text)


@pytest.mark.parametrize("text", ["const = 1;", "function (", "`open", "a b c", "<div>"])
def test_unreadable_files_are_recorded(text):
    with pytest.raises(ParseError):
        parse("a.ts", text)
    assert facts("a.ts", text)["failed"]


def test_places_are_of_lines_and_columns():
    file = File("a.js", "a;\r\n  debugger;\n")
    assert [(f[3], f[4]) for f in file.run()] == [(2, 3)]


def test_imports_of_all_kinds():
    text = "import a, { b as c } from './x';\nimport './side';\nconst { d } = require('./y');\nconst e = await import('./z');\nexport { f } from './w';\nexport * from './v';\nimport type { T } from './t';\nlet u: import('./u').U;\nrequire('./q')();"
    got = {(e[0], e[1], e[2], e[3]) for e in facts("a.ts", text)["edges"]}
    assert got == {("./x", "import", "b,default", False), ("./side", "import", "", False), ("./y", "require", "d", False), ("./z", "require", "*", False), ("./w", "export", "f", False), ("./v", "export", "*", False), ("./t", "import", "T", True), ("./u", "type", "*", True), ("./q", "require", "*", False)}


def test_exports():
    text = "export const { a, b: [c] } = x;\nexport function d() {}\nexport default 1;\nconst e = 1; export { e as f };"
    assert {e[0] for e in facts("a.ts", text)["exports"]} == {"a", "c", "d", "default", "f"}


def test_relative():
    assert [relative("a/b.ts", t) for t in ("./c", "../d", "../../up", "lib", "..")] == ["a/c", "d", None, None, ""]


def test_renaming_changes_nothing():
    assert renamed(["0a", "1=", "0b", "0a"]) == renamed(["0x", "1=", "0y", "0x"]) != renamed(["0a", "1=", "0b", "0b"])


@pytest.mark.parametrize("name", ["shadowed", "loop", "jsx", "type query", "script"])
def test_reads_that_count(name):
    text = {
        "shadowed": "export {}; const a = 1; function f(a) { return a } f(a);", "loop": "export {}; for (const k in o) { n++ }", "jsx": "import React from 'react'; import { Box } from 'b'; export const x = <Box />;",
        "type query": "const a = 1; export type T = typeof a;", "script": "const a = 1; function f() {}",
    }[name]
    assert [f for f in facts("a.tsx", text)["findings"] if f[0].startswith("DEAD00")] == []


SAFE = [
    "const id = Number(req.query.id); exec('a ' + id);", "if (!/^a$/.test(req.query.q)) return; exec(req.query.q);", "const n = req.body.n; if (typeof n !== 'number') { throw 1 } exec(n);",
    "exec(req.body.list.length);", "let a = req.body.a; a = 'x'; exec(a);", "const k = ['a'].includes(req.query.k) ? req.query.k : 'a'; exec(k);",
]
UNSAFE = ["const { a: { b } } = req.body; exec(b);", "let s = ''; s += req.body.x; exec(s);", "for (const x of req.body.list) exec(x);", "exec([req.params.a].join(' '));", "req.body.list.forEach(x => exec(x));", "try { exec(JSON.parse(req.body.x).y) } catch {}", "exec(await req.json());", "exec(ctx.request.body.cmd);"]


@pytest.mark.parametrize("body, reaches", [(b, False) for b in SAFE] + [(b, True) for b in UNSAFE])
def test_flows(body, reaches):
    rows = facts("a.js", "import { exec } from 'child_process';\nexport async function f(req, res, ctx) { " + body + " }")
    assert not rows["failed"] and any(r[0] == "sink" and r[5] == "request" for r in rows["flows"]) is reaches


@pytest.mark.parametrize("text", ["function f() { g(a); var a = 1; }", "if (x) { var a = 1; }", "var a = 1;", "function f(a) { var a = 2; }", "import { a } from 'm';\na();"])
def test_what_fixes_leave_alone(text):
    assert fixes.plan("a.js", text) == ([], None)


def test_to_fixed():
    assert [to_fixed(x) for x in (8.45, 9.35, 0.25, 10.0)] == [8.4, 9.3, 0.3, 10.0]


def test_api(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/index.ts").write_text("import { unused } from 'fs';\nvar a = 1;\nexport const b: any = a;\n")
    (tmp_path / "package.json").write_text('{"name": "x"}')
    got = api.scan_repository(spark, str(tmp_path))
    assert sorted(r.rule_id for r in got.findings.collect()) == ["DEAD002", "JS001", "TS001"]
    assert '"version": "2.1.0"' in api.report(got, "sarif") and api.report(got, "markdown").count("- **") == 3 and '"score"' in api.report(got)
    assert api.metrics(got)["loc"] == 4 and api.explain("js001")["category"] == "hygiene"
    assert [r.text for r in api.fix(spark, str(tmp_path)).collect()] == ["const a = 1;\nexport const b: any = a;\n"]
