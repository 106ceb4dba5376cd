"""Queries over findings: scores, visibility, gates, suppression, accuracy."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import CATEGORY_PERCENT, CONFIDENCE_SHARE, CONFIDENCES, RULES, SCOPES, SEVERITIES, SEVERITY_COST, rules
from ..operators import accuracy as A
from ..operators import findings as FD
from ..operators import scoring as S
from .inputs import FINDINGS_SQL, KINDS_SQL, TEST_SQL, case, findings

LOC = 20_000.0
_SR, _CR = case("severity", {s: i for i, s in enumerate(SEVERITIES)}), case("confidence", {c: i for i, c in enumerate(CONFIDENCES)})
_BACK_S, _BACK_C = lambda x: case(x, dict(enumerate(SEVERITIES))), lambda x: case(x, dict(enumerate(CONFIDENCES)))
_TEST = TEST_SQL
_PENALTY = f"({case('severity', SEVERITY_COST)})::DOUBLE * ({case('confidence', CONFIDENCE_SHARE)})::DOUBLE * CASE WHEN {_TEST} THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END"
_CHUNKS = LOC / 500
_COSTS = f"""{FINDINGS_SQL}, sums AS (SELECT category, rule_id, count(*) AS findings, sum({_PENALTY}) AS penalty FROM findings GROUP BY ALL),
weighed AS (SELECT *, penalty / CASE WHEN category = 'security' THEN least(sqrt({_CHUNKS}), 3.0) ELSE {_CHUNKS}::DOUBLE END AS x FROM sums),
costs AS (SELECT category, rule_id, findings, penalty, CASE WHEN x <= 2 THEN x ELSE 2 + ln(x - 1) END AS cost FROM weighed)"""
_PERCENT = "VALUES " + ", ".join(f"('{k}', {v})" for k, v in CATEGORY_PERCENT.items())
_SCORES = f"""{_COSTS}, cats(category, percent) AS ({_PERCENT}),
scores AS (SELECT category, percent, greatest(0.0::DOUBLE, 10 - coalesce(sum(cost), 0.0::DOUBLE)) AS score FROM cats LEFT JOIN costs USING (category) GROUP BY category, percent)"""

ACCURACY = [("DEAD009", 100.0, 19), ("SEC001", 80.0, 26), ("SEC009", 50.0, 4), ("COMPLEX001", 84.0, 12), ("SEC013", 90.0, 40)]


def _six(df, *columns):
    """Sums of floating-point numbers depend on their order; six digits don't."""
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _costs(spark, sf):
    return S.rule_costs(findings(spark, sf), LOC)


def _changed(spark, sf):
    """file, start, last of made-up hunks: a third of the files, two ranges each."""
    f = findings(spark, sf).select("file").distinct().filter(F.length("file") % 3 == 0)
    n = F.conv(F.substring(F.md5("file"), 1, 6), 16, 10).cast("int") % 90
    return f.select("file", F.explode(F.array(F.struct(n.alias("start"), (n + 9).alias("last")), F.struct((n + 100).alias("start"), (n + 104).alias("last")))).alias("r")).select("file", "r.*")


def _directives(spark, sf):
    f = findings(spark, sf).select("file", "line", "rule_id").distinct()
    whole = f.filter("file LIKE '%9.ts'").select("file").distinct().select("file", F.lit(None).cast("int").alias("at"), F.array(F.lit("SEC009"), F.lit("TS001")).alias("rules"))
    every = f.filter("line % 50 = 7").select("file", F.col("line").alias("at")).distinct().withColumn("rules", F.lit(None).cast("array<string>"))
    return whole.unionByName(every)


def _labels(spark, sf):
    f = findings(spark, sf).filter("confidence = 'LOW'").select("repo", "rule_id", "file", "line").distinct()
    more = f.filter("line % 4 = 0").withColumn("line", F.col("line") + 1000)
    return f.unionByName(more).withColumn("verdict", F.col("line") % 5 != 0)


_LABELS = """l0 AS (SELECT DISTINCT repo, rule_id, file, line FROM findings WHERE confidence = 'LOW'),
labels2 AS (SELECT *, line % 5 <> 0 AS verdict FROM (SELECT * FROM l0 UNION ALL SELECT repo, rule_id, file, line + 1000 FROM l0 WHERE line % 4 = 0))"""


def _cases(spark, sf):
    f = findings(spark, sf).filter("severity = 'CRITICAL'").select("rule_id", "file", "line").distinct()
    return f.select(F.concat_ws("/", "rule_id", "file", F.col("line").cast("string")).alias("id"), "rule_id", "file", F.when(F.col("line") % 3 == 0, F.col("line") + 500).when(F.col("line") % 3 == 1, F.col("line")).alias("at"))


_CASES = """c0 AS (SELECT DISTINCT rule_id, file, line FROM findings WHERE severity = 'CRITICAL'),
cases AS (SELECT concat_ws('/', rule_id, file, line) AS id, rule_id, file, CASE WHEN line % 3 = 0 THEN line + 500 WHEN line % 3 = 1 THEN line END AS at FROM c0)"""
_DECOYS = f"""{_CASES}, decoys AS (SELECT row_number() OVER (ORDER BY id) AS ordinal, id, rule_id, file, "at", CASE WHEN length(id) % 2 = 0 THEN 'MEDIUM' END AS tolerate FROM cases)"""


def _decoys(spark, sf):
    from pyspark.sql import Window as W

    return _cases(spark, sf).withColumn("ordinal", F.row_number().over(W.orderBy("id"))).withColumn("tolerate", F.when(F.length("id") % 2 == 0, "MEDIUM"))


def _accuracy_now(spark, sf):
    return A.rule_accuracy(A.label_verdicts(findings(spark, sf), _labels(spark, sf)), rules(spark))


_ACCURACY = f"""{FINDINGS_SQL}, {_LABELS}, cat(rule_id) AS (VALUES {", ".join(f"('{r}')" for r in RULES)}),
v AS (SELECT l.* FROM labels2 l WHERE EXISTS (SELECT 1 FROM findings f WHERE f.severity <> 'INFO' AND (f.repo, f.rule_id, f.file, f.line) = (l.repo, l.rule_id, l.file, l.line))),
acc AS (SELECT c.rule_id, count(*) FILTER (WHERE verdict) AS "right", count(*) FILTER (WHERE NOT verdict) AS wrong, count(verdict) AS labeled,
  CASE WHEN count(verdict) > 0 THEN count(*) FILTER (WHERE verdict) * 100.0::DOUBLE / count(verdict) END AS accuracy, count(verdict) >= 30 AS reliable FROM cat c LEFT JOIN v USING (rule_id) GROUP BY c.rule_id)"""


def _external(spark, sf):
    return findings(spark, sf).filter("line % 9 = 0 AND col % 2 = 0").withColumns({"rule_id": F.lit("EXT"), "confidence": F.lit("MEDIUM"), "severity": F.lit("HIGH"), "evidence": F.lit("tool")}).distinct()


QUERIES = {
    "fingerprint": lambda s, d: FD.fingerprint(findings(s, d)).groupBy("id").agg(F.count("*").alias("findings")),
    "fingerprint_unique": lambda s, d: FD.number_repeats(FD.fingerprint(findings(s, d))).select("id", "rule_id", "file", "line", "col"),
    "finding_penalty": lambda s, d: _six(findings(s, d).groupBy("severity", "confidence", S.is_test(F.col("file")).alias("test")).agg(F.count("*").alias("findings"), F.min(S.penalty()).alias("penalty")), "penalty"),
    "rule_cost": lambda s, d: _six(_costs(s, d), "penalty", "cost"),
    "category_scores": lambda s, d: _six(S.category_scores(_costs(s, d)), "score"),
    "overall_score": lambda s, d: _six(S.overall(findings(s, d), S.category_scores(_costs(s, d))), "weighted"),
    "security_cap": lambda s, d: findings(s, d).groupBy("repo").agg(S.credible_security().alias("credible")),
    "score_drains": lambda s, d: _six(S.drains(_costs(s, d), top=3), "lost"),
    "top_deductions": lambda s, d: _six(S.top_deductions(findings(s, d)), "penalty"),
    "hotspots": lambda s, d: _six(S.hotspots(findings(s, d)), "penalty"),
    "severity_histogram": lambda s, d: S.severity_histogram(findings(s, d)),
    "category_worst": lambda s, d: S.category_worst(findings(s, d)),
    "top_issue_per_category": lambda s, d: S.top_issue_per_category(findings(s, d)),
    "noisy_directories": lambda s, d: S.noisy_directories(findings(s, d), least=25, share=0.1),
    "legacy_var_majority": lambda s, d: S.legacy_majority(findings(s, d).filter("category = 'hygiene'")),
    "default_visible": lambda s, d: FD.shown_by_default(findings(s, d), s.createDataFrame(ACCURACY, "rule_id string, accuracy double, labeled int")),
    "category_filter": lambda s, d: FD.of_severity(FD.of_category(findings(s, d), "Dead code"), "medium"),
    "category_alias": lambda s, d: FD.of_category(findings(s, d), "type-safety").select("rule_id", "file", "line", "col"),
    "scope_hidden": lambda s, d: FD.in_scope(findings(s, d)).groupBy("rule_id", "kind", "hidden").agg(F.count("*").alias("findings")),
    "quality_gates": lambda s, d: FD.gates_fail(findings(s, d).filter("category = 'hygiene'"), F.lit(8.4), F.lit(10), 8.0, "critical"),
    "type_downgrade": lambda s, d: FD.downgrade_types(findings(s, d), FD.types_degraded(False, True, 0, 0)).groupBy("rule_id", "confidence").agg(F.count("*").alias("findings")),
    "since_changed_lines": lambda s, d: FD.since(findings(s, d), _changed(s, d)),
    "suppress_findings": lambda s, d: FD.suppress(findings(s, d), _directives(s, d)),
    "taint_merge": lambda s, d: FD.merge_flows(findings(s, d).filter("category = 'security' AND col < 20").dropDuplicates(["rule_id", "file", "line"]).withColumn("confidence", F.lit("MEDIUM")), findings(s, d).filter("category = 'security' AND line % 3 = 0"), findings(s, d).filter("category = 'security' AND line % 5 = 0")),
    "external_tool_upsert": lambda s, d: FD.merge_external(findings(s, d), _external(s, d)).groupBy("rule_id", "confidence").agg(F.count("*").alias("findings")),
    "labels_join": lambda s, d: A.label_verdicts(findings(s, d), _labels(s, d)),
    "stale_labels": lambda s, d: A.stale_labels(findings(s, d), _labels(s, d)),
    "wildcard_expectations": lambda s, d: A.caught(findings(s, d), _cases(s, d)).select("id", "caught"),
    "catch_rate": lambda s, d: _six(A.catch_rate(A.caught(findings(s, d), _cases(s, d))), "percent"),
    "decoy_tolerance": lambda s, d: A.decoys_reported(findings(s, d), _decoys(s, d)),
    "rule_accuracy": lambda s, d: _six(_accuracy_now(s, d), "accuracy"),
    "accuracy_gate": lambda s, d: _six(A.accuracy_gate(_accuracy_now(s, d), s.createDataFrame([(r, 82.0) for r in RULES], "rule_id string, was double")), "accuracy"),
    "sample_per_rule": lambda s, d: A.sample_per_rule(findings(s, d), _labels(s, d), 3),
}

_FP = "substr(sha256(concat(rule_id, chr(0), file, chr(0), substr(trim(regexp_replace(evidence, '\\s+', ' ', 'g')), 1, 200))), 1, 12)"
_SCOPE = case("rule_id", SCOPES)
_HIDDEN = f"NOT coalesce({_SCOPE} = 'everywhere' OR kind = 'production' OR ({_SCOPE} = 'runtime' AND kind = 'script'), true)"
_ALL = "repo, rule_id, category, severity, confidence, file, line, col, evidence"
_ACC_VALUES = ", ".join(f"('{r}', {a}, {n})" for r, a, n in ACCURACY)
SQL = {
    "fingerprint": f"WITH {FINDINGS_SQL} SELECT {_FP} AS id, count(*) AS findings FROM findings GROUP BY 1",
    "fingerprint_unique": f"""WITH {FINDINGS_SQL}, i AS (SELECT *, {_FP} AS i FROM findings), n AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY file, line, col, rule_id) AS n FROM i)
SELECT CASE WHEN n > 1 THEN i || '-' || n ELSE i END AS id, rule_id, file, line, col FROM n""",
    "finding_penalty": f"WITH {FINDINGS_SQL} SELECT severity, confidence, {_TEST} AS test, count(*) AS findings, round(min({_PENALTY}), 6) AS penalty FROM findings GROUP BY ALL",
    "rule_cost": f"WITH {_COSTS} SELECT category, rule_id, findings, round(penalty, 6) AS penalty, round(cost, 6) AS cost FROM costs",
    "category_scores": f"WITH {_SCORES} SELECT category, percent, round(score, 6) AS score FROM scores",
    "overall_score": f"""WITH {_SCORES}, m AS (SELECT sum(percent * round(score, 1)) / sum(percent) AS weighted FROM scores),
c AS (SELECT coalesce(bool_or(category = 'security' AND severity IN ('HIGH', 'CRITICAL') AND confidence IN ('HIGH', 'CERTAIN') AND NOT {_TEST}), false) AS credible FROM findings)
SELECT round(weighted, 6) AS weighted, credible AND weighted > 6.9 AS capped, round(CASE WHEN credible AND weighted > 6.9 THEN 6.9::DOUBLE ELSE weighted END, 1) AS score FROM m, c""",
    "security_cap": f"WITH {FINDINGS_SQL} SELECT repo, coalesce(bool_or(category = 'security' AND severity IN ('HIGH', 'CRITICAL') AND confidence IN ('HIGH', 'CERTAIN') AND NOT {_TEST}), false) AS credible FROM findings GROUP BY repo",
    "score_drains": f"""WITH {_COSTS}, cats(category, percent) AS ({_PERCENT}), t AS (SELECT *, sum(cost) OVER (PARTITION BY category) AS total FROM costs JOIN cats USING (category)),
d AS (SELECT rule_id, category, findings, percent / {float(sum(CATEGORY_PERCENT.values()))}::DOUBLE * cost * CASE WHEN total > 10 THEN 10 / total ELSE 1 END AS lost FROM t)
SELECT rule_id, category, findings, round(lost, 6) AS lost FROM d WHERE lost > 0 ORDER BY round(d.lost, 9) DESC, rule_id LIMIT 3""",
    "top_deductions": f"WITH {FINDINGS_SQL} SELECT rule_id, category, count(*) AS findings, round(sum({_PENALTY}), 6) AS penalty FROM findings GROUP BY ALL ORDER BY penalty DESC, rule_id LIMIT 8",
    "hotspots": f"WITH {FINDINGS_SQL} SELECT file, count(*) AS findings, round(sum({_PENALTY}), 6) AS penalty, {_BACK_S(f'max({_SR})')} AS worst FROM findings GROUP BY file ORDER BY penalty DESC, file LIMIT 5",
    "severity_histogram": f"WITH {FINDINGS_SQL} SELECT severity, count(*) AS findings FROM findings GROUP BY severity",
    "category_worst": f"WITH {FINDINGS_SQL} SELECT category, count(*) AS findings, {_BACK_S(f'max({_SR})')} AS worst FROM findings GROUP BY category",
    "top_issue_per_category": f"""WITH {FINDINGS_SQL}, r AS (SELECT *, {_SR} AS s, {_CR} AS c FROM findings), n AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY s DESC, c DESC, file, line, rule_id, evidence) AS n FROM r)
SELECT category, rule_id, file, line, severity, confidence FROM n WHERE n = 1 ORDER BY s DESC, c DESC, category LIMIT 6""",
    "noisy_directories": f"""WITH {FINDINGS_SQL}, n AS (SELECT CASE WHEN len(string_split(file, '/')) > 2 AND string_split(file, '/')[1] IN ('packages', 'apps') THEN array_to_string(string_split(file, '/')[1:2], '/') WHEN len(string_split(file, '/')) > 1 THEN string_split(file, '/')[1] ELSE '.' END AS directory FROM findings),
s AS (SELECT directory, count(*) AS findings FROM n GROUP BY 1), t AS (SELECT *, sum(findings) OVER ()::BIGINT AS total FROM s)
SELECT directory, findings, total FROM t WHERE findings >= 25 AND findings >= 0.1 * total ORDER BY findings DESC, directory LIMIT 5""",
    "legacy_var_majority": f"WITH {FINDINGS_SQL} SELECT count(*) FILTER (WHERE rule_id = 'JS001') AS old, count(*) AS declarations, count(*) FILTER (WHERE rule_id = 'JS001') >= 25 AND count(*) FILTER (WHERE rule_id = 'JS001') >= 0.9 * count(*) AS silent FROM findings WHERE category = 'hygiene'",
    "default_visible": f"""WITH {FINDINGS_SQL}, a(r, accuracy, labeled) AS (VALUES {_ACC_VALUES})
SELECT {_ALL} FROM findings LEFT JOIN a ON rule_id = r WHERE severity <> 'INFO' AND NOT coalesce(labeled >= 10 AND accuracy < 85, false)
AND (confidence IN ('HIGH', 'CERTAIN') OR (category = 'security' AND severity IN ('HIGH', 'CRITICAL') AND confidence = 'MEDIUM'))""",
    "category_filter": f"WITH {FINDINGS_SQL} SELECT {_ALL} FROM findings WHERE category = 'deadCode' AND severity = 'MEDIUM'",
    "category_alias": f"WITH {FINDINGS_SQL} SELECT rule_id, file, line, col FROM findings WHERE category = 'typescript'",
    "scope_hidden": f"WITH {FINDINGS_SQL}, k AS (SELECT *, {KINDS_SQL('file')} AS kind FROM findings), h AS (SELECT *, {_HIDDEN} AS hidden FROM k) SELECT rule_id, kind, hidden, count(*) AS findings FROM h GROUP BY ALL",
    "quality_gates": f"WITH {FINDINGS_SQL} SELECT coalesce(max({_SR}), -1) >= 4 AS fails FROM findings WHERE category = 'hygiene'",
    "type_downgrade": f"WITH {FINDINGS_SQL} SELECT rule_id, CASE WHEN rule_id IN ('TS001', 'ERR003') THEN 'LOW' ELSE confidence END AS confidence, count(*) AS findings FROM findings GROUP BY ALL",
    "since_changed_lines": f"""WITH {FINDINGS_SQL}, n AS (SELECT DISTINCT file, ('0x' || substr(md5(file), 1, 6))::INTEGER % 90 AS n FROM findings WHERE length(file) % 3 = 0)
SELECT {_ALL} FROM findings f WHERE EXISTS (SELECT 1 FROM n WHERE n.file = f.file AND (f.line BETWEEN n AND n + 9 OR f.line BETWEEN n + 100 AND n + 104))""",
    "suppress_findings": f"""WITH {FINDINGS_SQL} SELECT {_ALL} FROM findings WHERE NOT (line % 50 = 7) AND NOT (file LIKE '%9.ts' AND rule_id IN ('SEC009', 'TS001'))""",
    "taint_merge": f"""WITH {FINDINGS_SQL}, s AS (SELECT * FROM findings WHERE category = 'security'), c AS (SELECT DISTINCT rule_id, file, line FROM s WHERE line % 5 = 0),
p AS (SELECT DISTINCT rule_id, file, line FROM s WHERE col < 20 AND NOT EXISTS (SELECT 1 FROM c WHERE (c.rule_id, c.file, c.line) = (s.rule_id, s.file, s.line))),
f AS (SELECT rule_id, file, line, max({_CR}) AS r FROM s WHERE line % 3 = 0 GROUP BY ALL)
SELECT rule_id, file, line, {_BACK_C("greatest(coalesce(r, 0), CASE WHEN pp THEN 1 ELSE 0 END)")} AS confidence, r IS NOT NULL AS flow, coalesce(pp, false) AS pattern FROM (SELECT *, true AS pp FROM p) FULL JOIN f USING (rule_id, file, line)""",
    "external_tool_upsert": f"""WITH {FINDINGS_SQL}, x AS (SELECT DISTINCT repo, category, file, line, col FROM findings WHERE line % 9 = 0 AND col % 2 = 0), pl AS (SELECT DISTINCT file, line FROM x),
own AS (SELECT f.rule_id, CASE WHEN pl.file IS NOT NULL AND f.rule_id = 'SEC001' AND {_CR} < 2 THEN 'HIGH' ELSE confidence END AS confidence FROM findings f LEFT JOIN pl ON f.file = pl.file AND f.line = pl.line),
new AS (SELECT 'EXT' AS rule_id, 'MEDIUM' AS confidence FROM x WHERE NOT EXISTS (SELECT 1 FROM findings f WHERE f.rule_id = 'SEC001' AND f.file = x.file AND f.line = x.line))
SELECT rule_id, confidence, count(*) AS findings FROM (SELECT * FROM own UNION ALL SELECT * FROM new) GROUP BY ALL""",
    "labels_join": f"WITH {_ACCURACY} SELECT repo, rule_id, file, line, verdict FROM v",
    "stale_labels": f"WITH {FINDINGS_SQL}, {_LABELS} SELECT l.* FROM labels2 l WHERE repo IN (SELECT repo FROM findings) AND NOT EXISTS (SELECT 1 FROM findings f WHERE (f.repo, f.rule_id, f.file, f.line) = (l.repo, l.rule_id, l.file, l.line))",
    "wildcard_expectations": f"WITH {FINDINGS_SQL}, {_CASES} SELECT id, EXISTS (SELECT 1 FROM findings f WHERE f.rule_id = c.rule_id AND f.file = c.file AND (c.at IS NULL OR c.at = f.line)) AS caught FROM cases c",
    "catch_rate": f"WITH {FINDINGS_SQL}, {_CASES}, k AS (SELECT EXISTS (SELECT 1 FROM findings f WHERE f.rule_id = c.rule_id AND f.file = c.file AND (c.at IS NULL OR c.at = f.line)) AS caught FROM cases c) SELECT count(*) FILTER (WHERE caught) AS caught, count(*) AS planted, round(CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE caught) * 100.0::DOUBLE / count(*) ELSE 100 END, 6) AS percent FROM k",
    "decoy_tolerance": f"""WITH {FINDINGS_SQL}, {_DECOYS}, ff AS (SELECT row_number() OVER (ORDER BY rule_id) AS n, rule_id, file, line, confidence FROM findings),
b AS (SELECT f.*, d.id, d.tolerate, row_number() OVER (PARTITION BY n ORDER BY d.ordinal) AS k FROM ff f JOIN decoys d ON f.rule_id = d.rule_id AND f.file = d.file AND (d.at IS NULL OR d.at = f.line))
SELECT id, rule_id, file, line, confidence FROM b WHERE k = 1 AND NOT coalesce({_CR} <= {case('tolerate', {c: i for i, c in enumerate(CONFIDENCES)})}, false)""",
    "rule_accuracy": f"""WITH {_ACCURACY} SELECT rule_id, "right", wrong, labeled, round(accuracy, 6) AS accuracy, reliable FROM acc""",
    "accuracy_gate": f"WITH {_ACCURACY} SELECT rule_id, round(accuracy, 6) AS accuracy, 82.0::DOUBLE AS was FROM acc WHERE accuracy < 80",
    "sample_per_rule": f"""WITH {FINDINGS_SQL}, {_LABELS}, u AS (SELECT DISTINCT repo, rule_id, file, line FROM findings f WHERE NOT EXISTS (SELECT 1 FROM labels2 l WHERE (f.repo, f.rule_id, f.file, f.line) = (l.repo, l.rule_id, l.file, l.line))),
n AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY md5(concat_ws('|', repo, rule_id, file, line)), repo, rule_id, file, line) AS n FROM u) SELECT repo, rule_id, file, line FROM n WHERE n <= 3""",
}
