"""What a user calls: scan a checkout, read its reports, plan fixes, compare baselines."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import RULES
from .operators import findings as FD
from .operators import reports as RP
from .operators import scoring as S
from .plans.code import fix_plan
from .plans.scan import Scan, function_measures, scan
from .sources import repository as R
from .sources import reports as RS
from .sources import texts as X

CONFIG, IGNORE = "lumenlint.config.json", ".lumenlintignore"


def load_repository(spark: SparkSession, root: str) -> DataFrame:
    """file, size, text of a folder. Unreadable bytes become U+FFFD."""
    return R.read_files(spark, root).select("file", "size", F.col("content").cast("string").alias("text"))


def _text_of(root: str, name: str) -> str | None:
    at = os.path.join(root, name)
    if not os.path.isfile(at):
        return None
    with open(at) as f:
        return f.read()


def scan_repository(spark: SparkSession, root: str, config: dict | None = None, diff: str | None = None, secrets: str | None = None, unused: str | None = None) -> Scan:
    """A scan of a local or shared folder.

    `diff`, a unified diff without context, keeps findings on its new lines only. `secrets` and `unused` are the reports
    of other tools, whose findings are merged. Globs of an ignore file in the folder add to the excluded ones.
    """
    config = config or R.load_config(_text_of(root, CONFIG))
    ignored = X.ignore_globs((_text_of(root, IGNORE) or "").split("\n"))
    config = config | {"scan": config["scan"] | {"exclude": [*config["scan"]["exclude"], *ignored]}}
    reports = [read(spark.createDataFrame([(text,)], "text string")) for read, text in ((RS.secret_report, secrets), (RS.unused_report, unused)) if text is not None]
    external = FD.union_all(reports) if reports else None
    out = scan(load_repository(spark, root), config, os.path.isdir(os.path.join(root, "node_modules")), external)
    if diff is not None:
        rows = spark.createDataFrame([("diff", i + 1, x) for i, x in enumerate(diff.split("\n"))], "file string, line int, text string")
        out.findings = FD.since(out.findings, X.diff_hunks(rows).withColumnRenamed("path", "file"))
    return out


def shown(found: Scan, category: str | None = None, severity: str | None = None, every: bool = False, accuracy: DataFrame | None = None) -> DataFrame:
    """The findings to show: of a category and a severity, and but for `every` only those a reader can rely on.

    accuracy: rule_id, accuracy, labeled, as operators.accuracy.rule_accuracy gives it; without it all rules are trusted.
    """
    rows = found.findings if category is None else FD.of_category(found.findings, category)
    rows = rows if severity is None else FD.of_severity(rows, severity)
    none = found.findings.sparkSession.createDataFrame([], "rule_id string, accuracy double, labeled long")
    return rows if every else FD.shown_by_default(rows, accuracy if accuracy is not None else none)


def fails(found: Scan, min_score: float | None = None, fail_on: str | None = None) -> bool:
    """Whether a gate closes: the score is too low (or rests on no file), or a finding is at least as severe as fail_on."""
    score, files = found.overall.first()["score"], found.measures.first()["files"]
    return FD.gates_fail(found.findings, F.lit(score), F.lit(files), min_score, fail_on).first()["fails"]


def noisy(found: Scan) -> DataFrame:
    """Directories that hold so many findings that leaving them out may be worth it."""
    return S.noisy_directories(found.findings)


def report(found: Scan, form: str = "json") -> str:
    """json, sarif or markdown, for one repository."""
    if form == "sarif":
        return RP.sarif(found.findings)
    score = found.overall.first()["score"]
    if form == "markdown":
        return RP.markdown(found.scores, S.drains(found.costs), found.findings, RP.to_fixed(score))
    rows = [json.loads(r["value"]) for r in RP.json_lines(found.findings.orderBy("file", "line", "col", "rule_id")).toLocalIterator()]
    return json.dumps({"score": score, "categories": {r["category"]: RP.to_fixed(r["score"]) for r in found.scores.collect()}, "findings": rows})


def metrics(found: Scan) -> dict:
    return found.measures.first().asDict() | function_measures(found.functions).first().asDict()


def explain(rule: str) -> dict:
    category, severity, confidence, scope, threshold, title = RULES[rule.upper()]
    return {"rule": rule.upper(), "category": category, "severity": severity, "confidence": confidence, "scope": scope, "threshold": threshold, "title": title}


def fix(spark: SparkSession, root: str) -> DataFrame:
    """file, edits, text of the files that safe rewrites would change."""
    return fix_plan(load_repository(spark, root).filter(F.col("file").rlike(r"\.[cm]?[jt]sx?$"))).filter("text IS NOT NULL")
