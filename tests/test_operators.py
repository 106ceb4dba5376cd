"""Semantics that the queries' data doesn't reach."""

import pytest
from pyspark.sql import functions as F

from lumenlint.catalog import FINDING
from lumenlint.functions import paths as P
from lumenlint.operators import findings as FD
from lumenlint.operators import graph as G
from lumenlint.operators import scoring as S
from lumenlint.operators import text_rules as T
from lumenlint.sources import repository as R
from lumenlint.sources import texts as X


def finding(rule="DEAD009", category="deadCode", severity="MEDIUM", confidence="CERTAIN", file="src/a.ts", line=1, col=1, evidence="x"):
    return (rule, category, severity, confidence, file, line, col, evidence)


def test_clean_code_scores_ten(spark):
    none = spark.createDataFrame([], FINDING)
    assert {r.score for r in S.category_scores(S.rule_costs(none, 100)).collect()} == {10.0}
    assert S.overall(none, S.category_scores(S.rule_costs(none, 100))).first().score == 10.0


def test_a_credible_security_issue_caps_the_score_but_not_in_tests(spark):
    grave = finding("SEC001", "security", "HIGH", "HIGH")
    cap = lambda f: S.overall(f, S.category_scores(S.rule_costs(f, 50_000.0))).first()
    assert cap(spark.createDataFrame([grave], FINDING)).score == 6.9
    assert not cap(spark.createDataFrame([finding("SEC001", "security", "HIGH", "HIGH", "tests/a.ts")], FINDING)).capped


def test_damping_and_drains(spark):
    many = spark.createDataFrame([finding()] * 100, FINDING)
    costs = S.rule_costs(many, 500.0)
    assert costs.first().cost == pytest.approx(2 + __import__("math").log(149))
    assert S.drains(costs).first().lost == pytest.approx(15 / 100 * costs.first().cost)


@pytest.mark.parametrize(
    "glob, path, fits",
    [("**/lib", "lib", True), ("**/lib", "a/b/lib", True), ("**/lib", "mylib", False), ("src/*.ts", "src/a.ts", True), ("src/*.ts", "src/b/a.ts", False), ("a?c", "abc", True), ("a?c", "a/c", False), ("src/**", "src/x/y", True), ("a.b", "axb", False)],
)
def test_globs(spark, glob, path, fits):
    assert spark.range(1).select(P.matches_any(F.lit(path), [glob])).first()[0] is fits


def test_kinds(spark):
    want = {"src/a.ts": "production", "a.test-d.ts": "typeTest", "x/fixtures/a.ts": "fixture", "x/a.spec.tsx": "test", "src/test-util.ts": "test", "third_party/a.js": "vendor", "perf/a.ts": "benchmark", "docs/a.ts": "example", "template-x/a.ts": "example", ".github/a.js": "script", "src\\tests\\a.ts": "test"}
    got = spark.createDataFrame([(p,) for p in want], "p string").select("p", P.kind_of(F.col("p")).alias("k")).collect()
    assert {r.p: r.k for r in got} == want


def test_gates(spark):
    f = spark.createDataFrame([finding(severity="HIGH")], FINDING)
    fails = lambda **k: FD.gates_fail(f, F.lit(7.0), F.lit(k.pop("files", 5)), **k).first().fails
    assert fails(min_score=None, fail_on="high") and not fails(min_score=None, fail_on="CRITICAL")
    assert fails(min_score=7.5, fail_on=None) and not fails(min_score=7.0, fail_on=None)
    assert fails(min_score=1.0, fail_on=None, files=0) and fails(min_score=11.0, fail_on=None) and fails(min_score=None, fail_on="awful")


def test_external_findings_confirm_secrets(spark):
    own = spark.createDataFrame([finding("SEC001", "security", "HIGH", "LOW", line=3), finding("SEC002", "security", "HIGH", "LOW", line=3)], FINDING)
    tool = spark.createDataFrame([finding("EXT", line=3), finding("EXT", line=4)], FINDING)
    assert sorted((r.rule_id, r.confidence, r.line) for r in FD.merge_external(own, tool).collect()) == [("EXT", "CERTAIN", 4), ("SEC001", "HIGH", 3), ("SEC002", "LOW", 3)]


def test_repeats_at_one_place_are_numbered_alike_in_any_order(spark):
    rows = [finding("SEC001", severity=s, confidence=c) for s, c in (("LOW", "HIGH"), ("CRITICAL", "LOW"), ("CRITICAL", "HIGH"), ("INFO", "HIGH"))]
    numbered = lambda some: {(r.severity, r.confidence): r.id[12:] for r in FD.number_repeats(FD.fingerprint(spark.createDataFrame(some, FINDING).coalesce(1))).collect()}
    assert numbered(rows) == numbered(rows[::-1]) == {("CRITICAL", "HIGH"): "", ("INFO", "HIGH"): "-2", ("LOW", "HIGH"): "-3", ("CRITICAL", "LOW"): "-4"}


@pytest.mark.parametrize("small", [0, 1000])
def test_components_by_joins_and_in_one_task(spark, small):
    edges = spark.createDataFrame([(1, 2), (3, 2), (9, 8), (5, 5), (8, 7), (3, 1)], "u long, v long")
    assert {(r.node, r.component) for r in G.components(edges, small=small).collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 7), (9, 7)}


def test_closure(spark):
    line = [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(20)]
    assert G.closure(spark.createDataFrame([*line, ("z", "z")], "src string, dst string")).count() == 20 * 21 // 2 + 1


@pytest.mark.parametrize("walked", [0, 1000])
def test_closure_walked_and_by_joins(spark, walked):
    """A ring with a tail into it, shared targets, a loop, no way on from null, and a node that only comes last."""
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("t", "a"), ("u", "a"), ("v", "a"), ("v", "z"), ("z", "z"), ("c", None), (None, "end"), ("a", "b")]
    ring = {"a", "b", "c", None}
    want = {(s, d) for s in "abctuv" for d in ring} | {("v", "z"), ("z", "z"), (None, "end")}
    got = [(r.src, r.dst) for r in G.closure(spark.createDataFrame(edges, "src string, dst string"), walked=walked).collect()]
    assert len(got) == len(want) and set(got) == want


def test_closure_of_a_long_line_takes_no_rounds(spark, monkeypatch):
    made, real = [], G.materialise
    monkeypatch.setattr(G, "materialise", lambda df, name: made.append(name) or real(df, name))
    line = spark.createDataFrame([(i, i + 1) for i in range(400)], "src long, dst long")
    assert G.closure(line).count() == 400 * 401 // 2 and len(made) <= 2
    assert G.closure(line.filter("src < 0")).count() == 0


@pytest.mark.parametrize("small", [0, 1000])
def test_rings_of_several_kinds(spark, small):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("f", "f"), ("g", "a"), ("e", "h")], "src string, dst string")
    rings = G.rings(edges, small=small)
    assert {(r.node, r.ring) for r in rings.collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d"), ("f", "f")}
    assert {(r.ring, tuple(r.path)) for r in G.shortest_rings(edges, rings, small=small).collect()} == {("a", ("a", "b", "c", "a")), ("d", ("d", "e", "d")), ("f", ("f", "f"))}


def test_types_switched_off(spark):
    rows = spark.createDataFrame([("a.ts", 1, "// @ts-ignore"), ("a.ts", 2, "// @ts-ignore: old library"), ("a.ts", 3, "// @ts-expect-error wrong types upstream"), ("a.ts", 4, "/* @ts-nocheck */"), ("a.js", 5, "// @ts-ignore"), ("a.mts", 6, "// @ts-ignore")], "file string, line int, text string")
    assert {(r.line, r.severity, r.confidence) for r in T.unchecked_types(rows).collect()} == {(1, "MEDIUM", "HIGH"), (2, "LOW", "MEDIUM"), (4, "MEDIUM", "HIGH")}


def test_secrets_are_masked(spark):
    token = "AK" + "IA" + "ABCDEFGH234567AB"
    got = T.secrets(spark.createDataFrame([("a", 1, f"key {token} here"), ("a", 2, "nothing")], "file string, line int, text string")).collect()
    assert [(r.line, r.what, r.evidence) for r in got] == [(1, "cloud key id", "AKIA***")]


def test_line_counts(spark):
    texts = [(None, 0), ("", 0), (" \n ", 0), ("a", 1), ("a\n", 2), ("a\r\nb\rc\n", 4)]
    got = spark.createDataFrame(texts, "t string, n int").select("n", T.line_count(F.col("t")).alias("c")).collect()
    assert all(r.n == r.c for r in got)


def test_roles(spark):
    files = [("package.json", 9, "{}"), ("dist/a.js", 9, "x"), ("src/dist/a.js", 9, "x"), ("src/a.ts", 9, "let x"), ("src/big.ts", 2_000_000, "x"), ("yarn.lock", 9, "x"), ("src/gen.ts", 9, "// Code by a tool. DO NOT EDIT\nx"), ("src/hand.ts", 9, "let x\n// DO NOT EDIT"), ("node_modules/a/i.js", 9, "x"), ("README.md", 9, "x"), ("skip/a.ts", 9, "x"), ("a.txt", 9, "x\0")]
    got = {r.file: r.role for r in R.roles(spark.createDataFrame(files, "file string, size long, text string"), ["**/*"], ["skip/**"]).collect()}
    assert got == {"package.json": "text", "dist/a.js": "ignored", "src/dist/a.js": "source", "src/a.ts": "source", "src/big.ts": "too_large", "yarn.lock": "binary", "src/gen.ts": "generated", "src/hand.ts": "source", "node_modules/a/i.js": "ignored", "README.md": "text", "skip/a.ts": "excluded", "a.txt": "binary"}


def test_read_files(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src/a.ts").write_text("let x")
    (tmp_path / "node_modules/b.js").write_text("x")
    assert [(r.file, r.size) for r in R.read_files(spark, str(tmp_path)).collect()] == [("src/a.ts", 5)]


def test_package_names_and_globs(spark):
    got = spark.createDataFrame([("@a/b/c",), ("x/y",), ("./z",), ("node:fs",), ("#i",)], "t string").select(X.package_name(F.col("t")), X.is_bare(F.col("t"))).collect()
    assert [tuple(r) for r in got][:2] == [("@a/b", True), ("x", True)] and not any(r[1] for r in got[2:])
    assert X.ignore_globs(["# c", "", "!keep", "out/", "/top", "a/b"]) == ["**/out/**", "top", "top/**", "a/b", "a/b/**"]


def test_environment(spark):
    packages = spark.createDataFrame([("", "b-lib"), ("", "a-lib"), ("x", "none"), ("y", "a-lib")], "root string, name string")
    assert {(r.root, r.frameworks) for r in X.environment(packages, {"a-lib": "A", "b-lib": "B"}).collect()} == {("", "A,B"), ("y", "A")}


def test_config():
    assert R.load_config("{broken")["scan"]["include"] == ["**/*"]
    assert R.load_config('{"scan": {"exclude": ["x"]}}')["scan"] == {"include": ["**/*"], "exclude": ["x"], "includeNonProduction": False}
