"""What happens to findings between the rules and the reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..catalog import CONFIDENCES, SCOPES, SEVERITIES, confidence_rank, look_up, severity_rank
from ..functions.paths import applies, kind_of

TYPE_AWARE = ("ERR003", "TS001")
CATEGORY_NAMES = {"arch": "architecture", "dead": "deadcode", "deps": "dependencies", "errors": "errorhandling", "redundancy": "redundantlogic", "redundant": "redundantlogic", "types": "typescript", "typesafety": "typescript"}
PLACE = ["rule_id", "file", "line"]


def union_all(frames: list[DataFrame]) -> DataFrame:
    """The outputs of all rules, in one relation."""
    return reduce(DataFrame.unionByName, frames)


def fingerprint(findings: DataFrame) -> DataFrame:
    """Adds `id`: 12 hex digits over rule, file and the evidence with blanks collapsed, cut at 200 characters."""
    seen = F.substring(F.btrim(F.regexp_replace("evidence", r"\s+", " ")), 1, 200)
    return findings.withColumn("id", F.substring(F.sha2(F.concat_ws("\0", "rule_id", "file", seen), 256), 1, 12))


def number_repeats(findings: DataFrame) -> DataFrame:
    """Makes ids unique: the n-th finding with an id (by file, line, column) gets the suffix -n from the second on.

    Findings with one id share a rule and a file, so this shuffles by id, and no single key gathers many files. At one
    place the other columns decide, so that a finding's id doesn't depend on where its row comes from.
    """
    place = ["file", "line", "col", "rule_id"]
    n = F.row_number().over(W.partitionBy("id").orderBy(*place, *sorted(set(findings.columns) - {"id", *place})))
    return findings.withColumn("n", n).withColumn("id", F.when(F.col("n") > 1, F.concat("id", F.lit("-"), F.col("n").cast("string"))).otherwise(F.col("id"))).drop("n")


def in_scope(findings: DataFrame) -> DataFrame:
    """Adds `kind` of the file and `hidden`: whether the rule doesn't apply to such files."""
    scope = look_up(F.col("rule_id"), SCOPES, "everywhere")
    return findings.withColumn("kind", kind_of(F.col("file"))).withColumn("hidden", ~applies(scope, F.col("kind")))


def downgrade_types(findings: DataFrame, degraded: bool) -> DataFrame:
    """Findings that need types the project can't load are a guess."""
    return findings.withColumn("confidence", F.when(F.lit(degraded) & F.col("rule_id").isin(*TYPE_AWARE), "LOW").otherwise(F.col("confidence")))


def types_degraded(installed: bool, declares: bool, unresolved: int, imported: int) -> bool:
    return (not installed and declares) or (unresolved >= 10 and unresolved >= 0.5 * max(imported, 1))


def since(findings: DataFrame, changed: DataFrame) -> DataFrame:
    """Findings on changed lines. changed: file, start, last. An equi join by file with the range as a residual condition."""
    c = changed.select(F.col("file").alias("c_file"), "start", "last")
    return findings.join(c, (F.col("file") == F.col("c_file")) & F.col("line").between(F.col("start"), F.col("last")), "left_semi")


def suppress(findings: DataFrame, directives: DataFrame) -> DataFrame:
    """Drops what a directive silences. directives: file, at (null: the whole file), rules (null: every rule)."""
    d = directives.select(F.col("file").alias("d_file"), "at", "rules")
    hit = (F.col("file") == F.col("d_file")) & (F.col("at").isNull() | (F.col("at") == F.col("line"))) & (F.col("rules").isNull() | F.array_contains("rules", F.upper("rule_id")))
    return findings.join(d, hit, "left_anti")


def shown_by_default(findings: DataFrame, accuracy: DataFrame) -> DataFrame:
    """Confident findings of rules that proved right, and grave security findings that are likely. accuracy: rule_id, accuracy, labeled."""
    a = accuracy.select(F.col("rule_id").alias("a_rule"), F.col("accuracy").alias("a"), F.col("labeled").alias("n"))
    grave = (F.col("category") == "security") & F.col("severity").isin("CRITICAL", "HIGH") & (F.col("confidence") == "MEDIUM")
    untrusted = F.coalesce((F.col("n") >= 10) & (F.col("a") < 85), F.lit(False))
    kept = findings.join(a, F.col("rule_id") == F.col("a_rule"), "left").filter((F.col("severity") != "INFO") & ~untrusted & (F.col("confidence").isin("CERTAIN", "HIGH") | grave))
    return kept.drop("a_rule", "a", "n")


def _plain(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z]", "")


def of_category(findings: DataFrame, category: str) -> DataFrame:
    """Any spelling of a category's name, and its short names."""
    name = "".join(x for x in category.lower() if "a" <= x <= "z")
    return findings.filter(_plain(F.col("category")) == CATEGORY_NAMES.get(name, name))


def of_severity(findings: DataFrame, severity: str) -> DataFrame:
    return findings.filter(F.lower("severity") == severity.lower())


def gates_fail(findings: DataFrame, score: Column, analyzed_files: Column, min_score: float | None, fail_on: str | None) -> DataFrame:
    """One row: fails, by the score (which files have to back) or by a finding at least as severe as fail_on."""
    if min_score is not None and not 0 <= min_score <= 10 or fail_on is not None and fail_on.upper() not in SEVERITIES:
        return findings.sparkSession.range(1).select(F.lit(True).alias("fails"))
    low = F.lit(False) if min_score is None else (analyzed_files == 0) | (score < min_score)
    worst = F.coalesce(F.max(severity_rank(F.col("severity"))), F.lit(-1))
    grave = F.lit(False) if fail_on is None else worst >= SEVERITIES.index(fail_on.upper())
    return findings.agg(worst.alias("worst")).select((low | (grave if fail_on is None else F.col("worst") >= SEVERITIES.index(fail_on.upper()))).alias("fails"))


def merge_flows(patterns: DataFrame, flows: DataFrame, cleared: DataFrame) -> DataFrame:
    """Findings of patterns and of data flows, one per rule, file and line.

    A pattern that a flow shows to be clean goes. Where both report, the higher confidence stays and the flow is added.
    """
    p = patterns.join(cleared.select(*PLACE).distinct(), PLACE, "left_anti").select(*PLACE, F.col("confidence").alias("p"))
    f = flows.groupBy(*PLACE).agg(F.max(confidence_rank(F.col("confidence"))).alias("f"))
    best = F.greatest(confidence_rank(F.col("p")), F.col("f"))
    return p.join(f, PLACE, "full_outer").select(*PLACE, F.element_at(F.array(*map(F.lit, CONFIDENCES)), (best + 1).cast("int")).alias("confidence"), F.col("f").isNotNull().alias("flow"), F.col("p").isNotNull().alias("pattern"))


def merge_external(findings: DataFrame, external: DataFrame, confirms: str = "SEC001") -> DataFrame:
    """Adds another tool's findings. One on a line with a finding of `confirms` raises that one to HIGH, as it is the same."""
    at = ["file", "line"]
    tool = external.select(*at).distinct().withColumn("confirmed", F.lit(True))
    own = findings.join(tool, at, "left").withColumn("confidence", F.when(F.col("confirmed") & (F.col("rule_id") == confirms) & (confidence_rank(F.col("confidence")) < 2), "HIGH").otherwise(F.col("confidence"))).drop("confirmed")
    new = external.join(findings.filter(F.col("rule_id") == confirms).select(*at).distinct(), at, "left_anti")
    return own.unionByName(new)
