"""How right the rules are: findings against planted cases, decoys and labels by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..catalog import confidence_rank

PLACE = ["repo", "rule_id", "file", "line"]


def label_verdicts(findings: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels that a finding of the same place meets, each once; informational findings don't count. labels: PLACE, verdict."""
    return labels.join(findings.filter("severity <> 'INFO'").select(*PLACE).distinct(), PLACE)


def stale_labels(findings: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels of scanned repositories that no finding meets any more."""
    scanned = findings.select("repo").distinct()
    return labels.join(scanned, "repo", "left_semi").join(findings.select(*PLACE).distinct(), PLACE, "left_anti")


def caught(findings: DataFrame, planted: DataFrame) -> DataFrame:
    """planted with `caught`. planted: id, rule_id, file, at (null: any line). One row per case, whatever the matches."""
    f = findings.select("rule_id", "file", "line").distinct()
    p = planted.alias("p")
    hit = p.join(f.alias("f"), (F.col("p.rule_id") == F.col("f.rule_id")) & (F.col("p.file") == F.col("f.file")) & (F.col("p.at").isNull() | (F.col("p.at") == F.col("f.line"))), "left_semi").select("id").withColumn("caught", F.lit(True))
    return planted.join(hit.distinct(), "id", "left").withColumn("caught", F.coalesce("caught", F.lit(False)))


def decoys_reported(findings: DataFrame, decoys: DataFrame) -> DataFrame:
    """Findings on decoys. The first decoy of a place counts; one that tolerates a confidence forgives up to that. decoys: ordinal, id, rule_id, file, at, tolerate."""
    f = findings.select("rule_id", "file", "line", "confidence").withColumn("f_id", F.monotonically_increasing_id())
    d = decoys.select(F.col("rule_id").alias("d_rule"), F.col("file").alias("d_file"), "ordinal", "id", "at", "tolerate")
    both = f.join(d, (F.col("rule_id") == F.col("d_rule")) & (F.col("file") == F.col("d_file")) & (F.col("at").isNull() | (F.col("at") == F.col("line"))))
    first = both.groupBy("f_id").agg(F.min(F.struct("ordinal", "id", "tolerate", "rule_id", "file", "line", "confidence")).alias("d")).select("d.*")
    forgiven = F.coalesce(confidence_rank(F.col("confidence")) <= confidence_rank(F.col("tolerate")), F.lit(False))
    return first.filter(~forgiven).select("id", "rule_id", "file", "line", "confidence")


def rule_accuracy(verdicts: DataFrame, rules: DataFrame) -> DataFrame:
    """rule_id, right, wrong, labeled, accuracy (percent; null without labels), reliable (30 labels), for every rule."""
    sums = verdicts.groupBy("rule_id").agg(F.count(F.when(F.col("verdict"), 1)).alias("right"), F.count(F.when(~F.col("verdict"), 1)).alias("wrong"))
    n = F.coalesce("right", F.lit(0)) + F.coalesce("wrong", F.lit(0))
    return rules.select("rule_id").join(sums, "rule_id", "left").select("rule_id", F.coalesce("right", F.lit(0)).alias("right"), F.coalesce("wrong", F.lit(0)).alias("wrong"), n.alias("labeled"), F.when(n > 0, F.coalesce("right", F.lit(0)) * 100.0 / n).alias("accuracy"), (n >= 30).alias("reliable"))


def catch_rate(cases: DataFrame) -> DataFrame:
    """One row: caught, planted, percent (100 when nothing is planted)."""
    return cases.agg(F.count(F.when(F.col("caught"), 1)).alias("caught"), F.count("*").alias("planted")).withColumn("percent", F.when(F.col("planted") > 0, F.col("caught") * 100.0 / F.col("planted")).otherwise(100.0))


def accuracy_gate(now: DataFrame, baseline: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """Rules whose accuracy fell by more than the tolerance against a baseline (rule_id, was)."""
    return now.join(baseline, "rule_id").filter(F.col("accuracy") < F.col("was") - tolerance).select("rule_id", "accuracy", "was")


def sample_per_rule(findings: DataFrame, labelled: DataFrame, n: int) -> DataFrame:
    """At most n findings of each rule that have no label yet, drawn by a hash of the place: the same on every run."""
    left = findings.join(labelled.select(*PLACE).distinct(), PLACE, "left_anti")
    drawn = F.md5(F.concat_ws("|", "repo", "rule_id", "file", F.col("line").cast("string")))
    ranked = left.select(*PLACE).distinct().withColumn("n", F.row_number().over(W.partitionBy("rule_id").orderBy(drawn, *PLACE)))
    return ranked.filter(F.col("n") <= n).drop("n")
