"""What a scan can be told, and what it scores."""

import pytest

from lumenlint import api
from lumenlint.plans.scan import scan

SHOP = {
    "package.json": '{"name": "shop", "main": "src/start.ts", "dependencies": {"lib": "1"}}',
    "src/start.ts": "import { x } from 'lib';\nexport const a: any = x;\nconsole.log(a);\n",
    "scripts/make.ts": "eval(process.argv[2]);\n",
}
TESTS = {"src/start.test.ts": "var b = 1;\neval(b);\nexport const s = 'x';\n" * 30, "examples/a.ts": "eval(c);\n" * 40}


def files(spark, texts):
    return spark.createDataFrame([(k, len(v), v) for k, v in texts.items()], "file string, size long, text string")


def test_tests_and_examples_are_not_scored(spark):
    config = {"scan": {"include": ["**/*"], "exclude": [], "includeNonProduction": True}}
    alone, both = scan(files(spark, SHOP), config), scan(files(spark, SHOP | TESTS), config)
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert both.findings.filter("file LIKE 'examples/%'").count() > 0
    assert rows(alone.scores) == rows(both.scores) and rows(alone.costs) == rows(both.costs)
    m = both.measures.first()
    assert m.scored_loc == alone.measures.first()["loc"] and m.test_loc > 80 and m.test_ratio == pytest.approx(m.test_loc / (m.loc - m.test_loc))


def test_missing_types_make_a_guess_and_old_style_is_silent(spark):
    of = lambda found, rule: {r.confidence for r in found.findings.filter(f"rule_id = '{rule}'").collect()}
    assert of(scan(files(spark, SHOP)), "TS001") == {"LOW"} and of(scan(files(spark, SHOP), installed=True), "TS001") == {"CERTAIN"}
    old, few = {"index.js": "var a = 1;\n" * 30}, {"index.js": "var a = 1;\n" * 20}
    assert of(scan(files(spark, old)), "JS001") == set() and of(scan(files(spark, few)), "JS001") == {"CERTAIN"}


def test_options_of_the_library_entry(spark, tmp_path):
    for name, text in {**SHOP, "src/made/big.ts": "eval(x);\n", ".lumenlintignore": "# made\nmade/\n"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    secrets = '[{"RuleID": "key", "Description": "A key", "File": "src/start.ts", "StartLine": 3, "StartColumn": 5, "Secret": "x"}]'
    found = api.scan_repository(spark, str(tmp_path), secrets=secrets)
    rules = lambda df: {r.rule_id for r in df.collect()}
    assert found.findings.filter("file LIKE '%made%'").count() == 0 and {"EXT:key", "SEC002", "TS001"} <= rules(found.findings)
    assert "TS001" not in rules(api.shown(found)) and "TS001" in rules(api.shown(found, every=True))
    assert rules(api.shown(found, category="Security", every=True)) >= {"EXT:key", "SEC002"} and rules(api.shown(found, severity="high")) <= {"EXT:key", "SEC002"}
    assert api.fails(found, fail_on="high") and not api.fails(found, fail_on="critical") and api.fails(found, min_score=10) and not api.fails(found, min_score=0)
