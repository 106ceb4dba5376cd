"""Findings and scores as documents: JSON lines, SARIF, Markdown, baselines. Each is built in columns; writing is `df.write`."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import RULES, look_up, severity_rank


def to_fixed(x: float, digits: int = 1) -> float:
    """Rounds the exact binary value half up, where round() of a column rounds its shortest decimal form."""
    return float(Decimal(x).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def level(severity: Column) -> Column:
    return F.when(severity.isin("CRITICAL", "HIGH"), "error").when(severity == "MEDIUM", "warning").otherwise("note")


def json_lines(findings: DataFrame) -> DataFrame:
    """value: one JSON object per finding, for write.text."""
    return findings.select(F.to_json(F.struct(*sorted(findings.columns))).alias("value"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """value: one result of a SARIF 2.1.0 run per finding (findings have `id`). Runs of any size are written as parts, then joined."""
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine"), F.col("col").alias("startColumn")).alias("region")).alias("physicalLocation"))
    title = look_up(F.col("rule_id"), {r: v[5] for r, v in RULES.items()}, "Reported by another tool")
    result = F.struct(F.col("rule_id").alias("ruleId"), level(F.col("severity")).alias("level"), F.struct(title.alias("text")).alias("message"), F.array(place).alias("locations"), F.struct(F.col("id").alias("lumenlint/v1")).alias("partialFingerprints"))
    return findings.select("file", "line", "col", "rule_id", F.to_json(result).alias("value"))


def sarif_rules(findings: DataFrame) -> DataFrame:
    """rule_id, title of the catalog's rules and of all others that findings name."""
    known = findings.sparkSession.createDataFrame([(r, v[5]) for r, v in RULES.items()], "rule_id string, title string")
    other = findings.select("rule_id").distinct().join(known, "rule_id", "left_anti").withColumn("title", F.lit("Reported by another tool"))
    return known.unionByName(other)


def sarif(findings: DataFrame) -> str:
    """A whole SARIF document, for the findings of one repository."""
    import json

    results = [json.loads(r["value"]) for r in sarif_results(findings).orderBy("file", "line", "col", "rule_id").toLocalIterator()]
    rules = [{"id": r["rule_id"], "shortDescription": {"text": r["title"]}} for r in sarif_rules(findings).orderBy("rule_id").collect()]
    return json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": {"name": "lumenlint", "rules": rules}}, "results": results}]})


def markdown_rows(findings: DataFrame) -> DataFrame:
    """file, line, col, rule_id, value: one list item per finding, in the order in which they are to be written."""
    item = F.format_string("- **%s** %s (%s) `%s:%d:%d`", "rule_id", "severity", "confidence", "file", "line", "col")
    return findings.select(severity_rank(F.col("severity")).alias("rank"), "file", "line", "col", "rule_id", item.alias("value"))


def markdown(scores: DataFrame, drains: DataFrame, findings: DataFrame, score: float) -> str:
    """A whole report, for one repository."""
    table = [f"| {r['category']} | {to_fixed(r['score']):.1f} |" for r in scores.orderBy("category").collect()]
    lost = [f"- {r['rule_id']}: {r['findings']} findings, {r['lost']:.2f} points" for r in drains.collect()]
    items = [r["value"] for r in markdown_rows(findings).orderBy(F.desc("rank"), "file", "line", "col", "rule_id").toLocalIterator()]
    return "\n".join([f"# Score {score:.1f} / 10", "", "| Category | Score |", "| --- | ---: |", *table, "", "## What takes points off", "", *lost, "", f"## Findings ({len(items)})", "", *items, ""])


def baseline_compare(now: DataFrame, before: DataFrame, by: str = "repo") -> DataFrame:
    """by, score, was, delta (one decimal), verdict. now and before: by, score; a missing baseline counts as no change."""
    b = before.select(by, F.col("score").alias("was"))
    delta = F.round(F.col("score") - F.coalesce("was", "score"), 1)
    return now.select(by, "score").join(b, by, "left").withColumn("delta", delta).withColumn("verdict", F.when(F.col("delta") < 0, "regression").when(F.col("delta") > 0, "improved").otherwise("no change"))


def accuracy_rows(accuracy: DataFrame) -> DataFrame:
    """rule_id, value: the table row of each rule's accuracy; few labels are marked."""
    shown = F.when(F.col("labeled") == 0, "not measured").otherwise(F.concat(F.format_string("%.1f %%", "accuracy"), F.when(F.col("labeled") < 30, " (low)").otherwise("")))
    return accuracy.select("rule_id", F.format_string("| %s | %s | %d |", F.col("rule_id"), shown, F.col("labeled")).alias("value"))
