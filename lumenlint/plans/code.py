"""Queries over source code: generated files at scale, one small file for each rule, flows, fixes, reports and a whole scan."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..catalog import RULES
from ..javascript import fixes
from ..operators import code as C
from ..operators import findings as FD
from ..operators import flows as FL
from ..operators import reports as RP
from ..operators import text_rules as T
from ..sources import reports as RS
from .inputs import FINDINGS_SQL, case, findings, table
from .relational import _ACCURACY, _FP, _SR, _accuracy_now
from .scan import function_measures, scan
from .texts import _lines_of, _values

#: (text, [(rule, line, severity, confidence)]): an event's file is the template of its number.
TEMPLATES = [
    ("var a = 1;\nif (a == 2) { console.log(a); }\n", [("JS001", 1, "LOW", "CERTAIN"), ("JS002", 2, "LOW", "CERTAIN"), ("HYGIENE001", 2, "LOW", "CERTAIN")]),
    ("try { f(); } catch (e) {}\n", [("ERR001", 1, "MEDIUM", "CERTAIN")]),
    ("export const x: any =\n  y!;\n", [("TS001", 1, "MEDIUM", "CERTAIN"), ("TS003", 2, "LOW", "CERTAIN")]),
    ("import { a, b } from 'm';\nexport const c = a;\n", [("DEAD002", 1, "MEDIUM", "CERTAIN")]),
    ("export function f() {\n  return 1;\n  g();\n}\n", [("DEAD011", 3, "MEDIUM", "CERTAIN")]),
    ("debugger;\nwhile (true) { p().then(q => q); }\n", [("HYGIENE001", 1, "LOW", "CERTAIN"), ("ERR004", 2, "MEDIUM", "MEDIUM")]),
    ("// TODO later\nexport const h = createHash('md5');\n", [("HYGIENE002", 1, "LOW", "MEDIUM"), ("SEC005", 2, "MEDIUM", "HIGH")]),
    ("export function f(req, res) {\n  res.redirect(req.query.to);\n}\n", []),
]
#: rule: (path, text, [(line, severity, confidence)]), with one that must stay silent in most texts.
FIXTURES = {
    "COMPLEX001": ("a.js", "function f(a) {\n" + "  if (a) {}\n" * 11 + "}\nfunction g(a) { if (a) {} }", [(1, "LOW", "MEDIUM")]),
    "COMPLEX002": ("a.js", "function f(a) {\n  for (;;) { for (;;) { for (;;) { for (;;) { if (a) { if (a) {} } } } } }\n}", [(1, "MEDIUM", "HIGH")]),
    "COMPLEX003": ("a.js", "function f() {\n" + "  g();\n" * 99 + "}\nfunction h() {\n" + "  g();\n" * 98 + "}", [(1, "MEDIUM", "HIGH")]),
    "COMPLEX004": ("a.js", "function f(a, b, c, d, e, g) { return [a, b, c, d, e, g]; }\nfunction h(a, b, c, d, e) { return [a, b, c, d, e]; }", [(1, "MEDIUM", "HIGH")]),
    "COMPLEX005": ("a.js", "function f(a) { if (a) { if (a) { if (a) { if (a) { if (a) {} } } } } }\nfunction g(a) { if (a) { if (a) { if (a) { if (a) {} } } } }", [(1, "MEDIUM", "HIGH")]),
    "DEAD002": ("a.ts", "import a, { b, type C } from 'm';\nimport * as d from 'n';\nexport const x: C = b;", [(1, "MEDIUM", "CERTAIN"), (2, "MEDIUM", "CERTAIN")]),
    "DEAD003": ("a.ts", "export {};\nconst a = 1;\nlet b = 2; b = 3;\nconst _c = 4;\nconst { d, ...e } = f(); e();\nconst g = 1; h(g);", [(2, "MEDIUM", "CERTAIN"), (3, "MEDIUM", "CERTAIN")]),
    "DEAD004": ("a.ts", "export {};\nfunction a() {}\nfunction b() {}\nb();\nexport function c() {}", [(2, "MEDIUM", "CERTAIN")]),
    "DEAD005": ("a.ts", "export {};\nclass A {}\nclass B {}\nnew B();", [(2, "MEDIUM", "CERTAIN")]),
    "DEAD006": ("a.ts", "export function f(a, b) { return a; }\nexport function g(a, b) { return b; }\nexport class C { constructor(private x: X) {} }", [(1, "LOW", "CERTAIN")]),
    "DEAD007": ("a.ts", "export {};\ntype A = string;\ninterface B {}\ntype D = number;\nlet x: D; f(x);", [(2, "MEDIUM", "CERTAIN"), (3, "MEDIUM", "CERTAIN")]),
    "DEAD011": ("a.js", "function f() {\n  return g();\n  function g() {}\n  h();\n  h();\n}\nfor (;;) { break }\nfunction k() { return; }", [(4, "MEDIUM", "CERTAIN")]),
    "ERR001": ("a.js", "try { a() } catch {}\ntry { a() } catch (e) { /* fine */ }\ntry { a() } catch (e) { b(e) }", [(1, "MEDIUM", "CERTAIN")]),
    "ERR002": ("a.js", "try { a() }\ncatch (e) { throw e; }\ntry { a() } catch (e) { throw new B(e); }", [(2, "LOW", "HIGH")]),
    "ERR003": ("a.js", "async function f() {}\nf();\nvoid f();\nconst g = async () => { await f(); };\ng();", [(2, "MEDIUM", "LOW"), (5, "MEDIUM", "LOW")]),
    "ERR004": ("a.js", "a().then(b);\na().then(b).catch(c);\na().then(b, c);\nconst d = a().then(b);", [(1, "MEDIUM", "MEDIUM")]),
    "HYGIENE001": ("a.js", "console.log(1);\nconsole.info(1);\ndebugger;\nlogger.log(1);", [(1, "LOW", "CERTAIN"), (3, "LOW", "CERTAIN")]),
    "HYGIENE002": ("a.js", "// TODO one, FIXME two\nconst s = 'TODO';\n/* all done */\n/*\n HACK */", [(1, "LOW", "MEDIUM"), (1, "LOW", "MEDIUM"), (5, "LOW", "MEDIUM")]),
    "JS001": ("a.js", "var a = 1;\nlet b = 2;\nfor (var i = 0; ;) {}", [(1, "LOW", "CERTAIN"), (3, "LOW", "CERTAIN")]),
    "JS002": ("a.js", "a == b;\na == null;\ntypeof a == 'x';\na === b;\na != 1;", [(1, "LOW", "CERTAIN"), (5, "LOW", "CERTAIN")]),
    "REDUNDANT001": ("a.ts", "function f(a: boolean, b) {\n  if (a === true) g();\n  if (b === true) g();\n  if (!b == false) g();\n}", [(2, "LOW", "CERTAIN"), (4, "LOW", "CERTAIN")]),
    "REDUNDANT002": ("a.js", "if (true) a();\nif (b) a();\nif ('x') a();\nwhile (true) {}", [(1, "MEDIUM", "CERTAIN"), (3, "MEDIUM", "CERTAIN")]),
    "SEC002": ("a.js", "eval(x);\nevaluate(x);", [(1, "HIGH", "CERTAIN")]),
    "SEC003": ("a.js", "import { exec, spawn } from 'child_process';\nexec(`ls ${x}`);\nexec('ls');\nconst c = 'a' + b;\nexec(c);\nspawn('a', [b], { shell: true });\n/x/.exec(`${y}`);", [(2, "HIGH", "MEDIUM"), (5, "HIGH", "MEDIUM"), (6, "HIGH", "HIGH")]),
    "SEC004": ("a.tsx", "a.innerHTML = b;\na.innerHTML = '<b>';\na.insertAdjacentHTML('x', b);\nexport const x = <div dangerouslySetInnerHTML={{ __html: b }} />;\nexport const y = <div dangerouslySetInnerHTML={{ __html: JSON.stringify(b) }} />;", [(1, "MEDIUM", "MEDIUM"), (3, "MEDIUM", "HIGH"), (4, "MEDIUM", "MEDIUM"), (5, "MEDIUM", "LOW")]),
    "SEC005": ("a.js", "createHash('md5');\ncrypto.createHash('SHA1');\ncreateHash('sha256');", [(1, "MEDIUM", "HIGH"), (2, "MEDIUM", "HIGH")]),
    "SEC007": ("a.js", "f({ rejectUnauthorized: false });\nf({ rejectUnauthorized: true });\nf({ insecure: true });\nf({ checkServerIdentity: () => undefined });", [(1, "HIGH", "HIGH"), (3, "HIGH", "MEDIUM"), (4, "HIGH", "HIGH")]),
    "SEC008": ("a.js", "db.query('SELECT a FROM b WHERE c = ' + d);\ndb.query('SELECT 1');\ndb.raw(`delete from ${t}`);\ndb.query(`hello ${t}`);", [(1, "HIGH", "MEDIUM"), (3, "HIGH", "MEDIUM")]),
    "SEC009": ("a.js", "fs.readFile(req.query.f);\npath.join(root, req.params.x);\npath.join(root, path.basename(req.params.x));\nfs.readFile('a');", [(1, "HIGH", "LOW"), (2, "HIGH", "LOW")]),
    "SEC010": ("a.js", "import { unserialize } from 'node-serialize';\nunserialize(x);\nvm.runInNewContext(x);\nother.load(x);", [(2, "HIGH", "MEDIUM"), (3, "HIGH", "MEDIUM")]),
    "TS001": ("a.ts", "let a: any;\nlet b: Map<string, any>;\nlet c: unknown;\nf(x as any);", [(1, "MEDIUM", "CERTAIN"), (2, "LOW", "MEDIUM"), (4, "MEDIUM", "CERTAIN")]),
    "TS003": ("a.ts", "a!.b;\na != b;\n!a;\nf(a!);", [(1, "LOW", "CERTAIN"), (4, "LOW", "CERTAIN")]),
}
#: (name, cyclomatic, cognitive) of functions with known measures.
MEASURED = [
    ("straight", "return 1;", 1, 0), ("one", "if (a) b();", 2, 1), ("chain", "if (a) b(); else if (c) d(); else e();", 3, 2),
    ("nested", "for (;;) { if (a) b(); }", 3, 3), ("cases", "switch (a) { case 1: b(); break; case 2: c(); break; case 3: d(); }", 4, 1), ("run", "return a && b && c;", 3, 1),
]
FLOW_FILES = {
    "routes.js": "import { run, find } from './helpers';\nimport axios from 'axios';\nexport function a(req, res) {\n  run(req.body.cmd);\n  find(Number(req.query.id));\n  axios.get(req.query.url);\n  axios.get('https://x.example/' + req.query.q);\n  const to = req.query.to;\n  if (!SAFE.includes(to)) return;\n  res.redirect(to);\n}\nexport function b(req, res) {\n  res.redirect(req.query.next);\n  new RegExp(req.body.re);\n}\n",
    "helpers.js": "import { exec } from 'child_process';\nexport function run(c) {\n  inner(c, 1);\n}\nfunction inner(x, y) {\n  exec(`sh ${x}`);\n}\nexport function find(id) {\n  db.query('SELECT * FROM t WHERE id = ' + id);\n}\n",
}
FLOWS = [("SEC003", "helpers.js", 6, "MEDIUM"), ("SEC013", "routes.js", 6, "HIGH"), ("SEC012", "routes.js", 13, "HIGH"), ("SEC014", "routes.js", 14, "MEDIUM")]
FIXED = {
    "a.ts": ("import { a, b } from 'm';\nimport c from 'n';\nvar x = a;\nvar y;\ny = x;\nconsole.log(y);\nexport { y };\n", "import { a } from 'm';\nconst x = a;\nlet y;\ny = x;\nexport { y };\n"),
    "b.js": ("function f() { debugger; }\nvar z = 1;\n", None),
}
REPOSITORY = {
    "package.json": '{"name": "shop", "main": "src/start.ts", "dependencies": {"used-lib": "1", "spare-lib": "1"}, "scripts": {"build": "builder src"}, "devDependencies": {"builder": "1"}}',
    "src/start.ts": "import { total } from './total';\nimport { x } from 'used-lib';\nimport extra from 'missing-lib';\nexport const shown = [total(x), extra];\n",
    "src/total.ts": "import { rate } from './rate';\nexport function total(a: number) { return a * rate; }\nexport const spare = 1;\n",
    "src/rate.ts": "import { total } from './total';\nexport const rate = total ? 2 : 1;\n",
    "src/orphan.ts": "export const alone = 1;\n",
    "src/old.ts.bak": "x",
    ".env": "A=1",
    "src/quiet.test.ts": "// lumen-ignore-file\nvar a = 1;\nexport const b = a;\n",
}
SCANNED = [("DEAD009", "src/total.ts", 3), ("DEAD010", "src/orphan.ts", 1), ("DEP001", "package.json", 1), ("DEP002", "src/start.ts", 3), ("DEP003", "src/rate.ts", 1), ("HYGIENE003", "src/old.ts.bak", 1), ("HYGIENE004", ".env", 1)]

SECRET_REPORT = '[{"RuleID": "key", "Description": "A key", "File": "a.ts", "StartLine": 3, "StartColumn": 5, "Secret": "x"}]'
UNUSED_REPORT = '{"files": ["old.ts"], "issues": [{"file": "package.json", "dependencies": [{"name": "lib"}], "exports": []}, {"file": "b.ts", "exports": [{"name": "f", "line": 4, "col": 2}]}]}'
MARKED = "let a; // planted: key-1\nlet b; // planted: key-10\n// decoy: safe\nlet c; // planted: key-1"
CONFIGS = [
    ("tsconfig.json", '{ // paths\n "compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["src/*"], "@/ui/*": ["ui/*/index"], "exact": ["src/one"],}}}'),
    ("web/vite.config.ts", "export default { resolve: { alias: { '@app': './src', util: './u' } } }"),
    ("rollup.config.js", "alias({ entries: [{ find: 'core', replacement: './core' }] })"),
]
ALIASED = [("@/a/b", "src/a/b"), ("@/ui/box", "ui/box/index"), ("exact", "src/one"), ("exactly", None), ("react", None)]


def _files(spark, files: dict[str, str]):
    return spark.createDataFrame([(k, len(v), v) for k, v in files.items()], "file string, size long, text string")


def event_files(spark, sf):
    """file, text: one file for each event."""
    e = table(spark, sf, "events").select("event_id")
    return e.select(F.concat(F.lit("src/e"), F.col("event_id").cast("string"), F.lit(".ts")).alias("file"), F.element_at(F.array(*[F.lit(t) for t, _ in TEMPLATES]), (F.col("event_id") % len(TEMPLATES) + 1).cast("int")).alias("text"))


def _js_findings(spark, sf):
    return C.findings(C.code_facts(event_files(spark, sf))).groupBy("rule_id", "category", "line", "severity", "confidence").agg(F.count("*").alias("findings"))


def _rule(rule):
    def run(spark, sf):
        path, text, _ = FIXTURES[rule]
        return C.findings(C.code_facts(_files(spark, {path: text}))).filter(F.col("rule_id") == rule).select("rule_id", "line", "severity", "confidence")

    return run


def _fixed(batches):
    for pdf in batches:
        rows = [(f, *fixes.plan(f, t)) for f, t in zip(pdf["file"], pdf["text"])]
        yield pd.DataFrame([(f, len(e), t) for f, e, t in rows], columns=["file", "edits", "text"])


def fix_plan(files):
    """file, edits, text (null where the file stays as it is)."""
    return files.select("file", "text").mapInPandas(_fixed, "file string, edits int, text string")


def _flows(spark, sf):
    read = C.code_facts(_files(spark, FLOW_FILES))
    return FL.flow_findings(C.relation(read, "flows"), read.select("file")).select("rule_id", "file", "line", "confidence")


def _measured(spark, sf):
    text = "\n".join(f"function {n}(a) {{ {b} }}" for n, b, _, _ in MEASURED)
    return C.relation(C.code_facts(_files(spark, {"a.js": text})), "functions").select("name", "cyclomatic", "cognitive")


def _scan_findings(spark, sf):
    return scan(_files(spark, REPOSITORY)).findings.select("rule_id", "file", "line")


def _baseline(spark, sf):
    f = findings(spark, sf)
    now = f.groupBy("repo").agg((10 - F.count("*") % 7).cast("double").alias("score"))
    return RP.baseline_compare(now, now.filter("repo <> 'repo2'").withColumn("score", F.col("score") + F.when(F.col("repo") == "repo0", 0.25).otherwise(-0.5)))


QUERIES = {
    "js_findings": _js_findings,
    "js_function_measures": lambda s, d: function_measures(C.functions_by_text(event_files(s, d))),
    "js_clones": lambda s, d: C.code_copies(event_files(s, d), width=8, step=1).groupBy().agg(F.count("*").alias("hashes"), F.max("copies").alias("most")),
    "fn_complexity": _measured,
    "taint_flows": _flows,
    "fix_plan": lambda s, d: fix_plan(_files(s, {k: v[0] for k, v in FIXED.items()})).select("file", "text"),
    "scan_findings": _scan_findings,
    "sarif_levels": lambda s, d: findings(s, d).groupBy(RP.level(F.col("severity")).alias("level")).agg(F.count("*").alias("findings")),
    "sarif_results": lambda s, d: RP.sarif_results(FD.number_repeats(FD.fingerprint(findings(s, d)))),
    "markdown_rows": lambda s, d: RP.markdown_rows(findings(s, d)).select("rank", "value"),
    "json_lines": lambda s, d: RP.json_lines(findings(s, d)),
    "baseline_compare": _baseline,
    "accuracy_rows": lambda s, d: RP.accuracy_rows(_accuracy_now(s, d)),
    "secret_report": lambda s, d: RS.secret_report(s.createDataFrame([(SECRET_REPORT,)], "text string")).drop("evidence"),
    "unused_report": lambda s, d: RS.unused_report(s.createDataFrame([(UNUSED_REPORT,)], "text string")).select("rule_id", "category", "file", "line", "evidence"),
    "marked_lines": lambda s, d: RS.marked_lines(_lines_of(s, MARKED)).drop("file"),
    "path_aliases": lambda s, d: RS.resolve_aliases(s.createDataFrame([(t,) for t, _ in ALIASED], "target string"), RS.path_aliases(s.createDataFrame(CONFIGS, "file string, text string"))),
    "bundler_aliases": lambda s, d: RS.bundler_aliases(s.createDataFrame(CONFIGS, "file string, text string")),
    **{f"rule_{r}": _rule(r) for r in FIXTURES},
}


def _template_rows() -> str:
    return ", ".join(f"({i}, '{r}', '{RULES[r][0]}', {line}, '{s}', '{c}')" for i, (_, ts) in enumerate(TEMPLATES) for r, line, s, c in ts)


_LEVEL = "CASE WHEN severity IN ('CRITICAL', 'HIGH') THEN 'error' WHEN severity = 'MEDIUM' THEN 'warning' ELSE 'note' END"
SQL = {
    "js_findings": f"""WITH t(n, rule_id, category, line, severity, confidence) AS (VALUES {_template_rows()})
SELECT rule_id, category, line, severity, confidence, count(*) AS findings FROM events JOIN t ON event_id % {len(TEMPLATES)} = n GROUP BY ALL""",
    "js_function_measures": """WITH f AS (SELECT unnest(CASE event_id % 8 WHEN 4 THEN [4] WHEN 5 THEN [1] WHEN 7 THEN [3] ELSE [] END) AS lines FROM events)
SELECT count(*) AS functions, round(coalesce(avg(lines), 0.0::DOUBLE), 6) AS mean_lines, count(*) AS low, 0::BIGINT AS medium, 0::BIGINT AS high FROM f""",
    "fn_complexity": _values("name, cyclomatic, cognitive", [(n, c, g) for n, _, c, g in MEASURED]),
    "taint_flows": _values("rule_id, file, line, confidence", FLOWS),
    "fix_plan": _values("file, text", [(k, v[1] and v[1].replace("'", "''")) for k, v in FIXED.items()]),
    "scan_findings": _values("rule_id, file, line", SCANNED),
    "sarif_levels": f"WITH {FINDINGS_SQL} SELECT {_LEVEL} AS level, count(*) AS findings FROM findings GROUP BY 1",
    "sarif_results": f"""WITH {FINDINGS_SQL}, i AS (SELECT *, {_FP} AS i FROM findings), n AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY file, line, col, rule_id) AS n FROM i)
SELECT file, line, col, rule_id, '{{"ruleId":"' || rule_id || '","level":"' || {_LEVEL} || '","message":{{"text":"' || {case("rule_id", {r: v[5].replace("'", "''") for r, v in RULES.items()})} || '"}},"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":"' || file
|| '"}},"region":{{"startLine":' || line || ',"startColumn":' || col || '}}}}}}],"partialFingerprints":{{"lumenlint/v1":"' || CASE WHEN n > 1 THEN i || '-' || n ELSE i END || '"}}}}' AS value FROM n""",
    "markdown_rows": f"WITH {FINDINGS_SQL} SELECT {_SR} AS rank, '- **' || rule_id || '** ' || severity || ' (' || confidence || ') `' || file || ':' || line || ':' || col || '`' AS value FROM findings",
    "json_lines": f"WITH {FINDINGS_SQL} SELECT to_json(struct_pack(category := category, col := col, confidence := confidence, evidence := evidence, file := file, line := line, repo := repo, rule_id := rule_id, severity := severity))::VARCHAR AS value FROM findings",
    "baseline_compare": f"""WITH {FINDINGS_SQL}, n AS (SELECT repo, (10 - count(*) % 7)::DOUBLE AS score FROM findings GROUP BY repo),
b AS (SELECT repo, score, CASE repo WHEN 'repo0' THEN score + 0.25::DOUBLE WHEN 'repo1' THEN score - 0.5::DOUBLE END AS was FROM n)
SELECT repo, score, was, CASE repo WHEN 'repo0' THEN -0.3::DOUBLE WHEN 'repo1' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS delta, CASE repo WHEN 'repo0' THEN 'regression' WHEN 'repo1' THEN 'improved' ELSE 'no change' END AS verdict FROM b""",
    "accuracy_rows": f"""WITH {_ACCURACY} SELECT rule_id, '| ' || rule_id || ' | ' || CASE WHEN labeled = 0 THEN 'not measured' ELSE printf('%.1f', accuracy) || ' %' || CASE WHEN labeled < 30 THEN ' (low)' ELSE '' END END || ' | ' || labeled || ' |' AS value FROM acc""",
    "secret_report": _values("rule_id, category, severity, confidence, file, line, col", [("EXT:key", "security", "HIGH", "HIGH", "a.ts", 3, 5)]),
    "unused_report": _values("rule_id, category, file, line, evidence", [("EXT:files", "deadCode", "old.ts", 1, "old.ts"), ("EXT:dependencies", "dependencies", "package.json", 1, "lib"), ("EXT:exports", "deadCode", "b.ts", 4, "f")]),
    "marked_lines": _values("id, what, line", [("key-1", "planted", 1), ("key-10", "planted", 2), ("safe", "decoy", 3)]),
    "path_aliases": _values("target, path", ALIASED),
    "bundler_aliases": _values("file, alias", [("web/vite.config.ts", "@app"), ("web/vite.config.ts", "util"), ("rollup.config.js", "core")]),
    **{f"rule_{r}": _values("rule_id, line, severity, confidence", [(r, *x) for x in v[2]]) for r, v in FIXTURES.items()},
}
