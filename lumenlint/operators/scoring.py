"""From findings to scores, and what takes points off.

Every operator takes many repositories at once by naming the columns that tell them apart (`by`), and needs one shuffle
by (repository, category, rule); all above that are small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..catalog import CATEGORY_PERCENT, CONFIDENCE_SHARE, SEVERITIES, SEVERITY_COST, look_up, severity_rank
from ..functions.paths import is_test

LINES = 500.0  # of code that a penalty is weighed against
KNEE, CAP = 2.0, 6.9


def penalty() -> Column:
    """Cost of a finding by severity and confidence; half in test code."""
    return look_up(F.col("severity"), SEVERITY_COST) * look_up(F.col("confidence"), CONFIDENCE_SHARE) * F.when(is_test(F.col("file")), 0.5).otherwise(1.0)


def damped(points: Column) -> Column:
    """Grows with the logarithm past the knee, so that one noisy rule can't empty a category."""
    return F.when(points <= KNEE, points).otherwise(KNEE + F.log(points - KNEE + 1))


def rule_costs(findings: DataFrame, loc: float) -> DataFrame:
    """category, rule_id, findings, penalty, cost."""
    chunks = max(loc / LINES, 1.0)
    weigh = F.when(F.col("category") == "security", min(chunks**0.5, 3.0)).otherwise(chunks)
    sums = findings.groupBy("category", "rule_id").agg(F.count("*").alias("findings"), F.sum(penalty()).alias("penalty"))
    return sums.withColumn("cost", damped(F.col("penalty") / weigh))


def category_scores(costs: DataFrame, architecture: bool = True) -> DataFrame:
    """category, percent, score of every category, 10 where nothing was found."""
    chosen = {k: v for k, v in CATEGORY_PERCENT.items() if architecture or k != "architecture"}
    every = costs.sparkSession.createDataFrame(list(chosen.items()), "category string, percent int")
    lost = costs.groupBy("category").agg(F.sum("cost").alias("lost"))
    return every.join(lost, "category", "left").select("category", "percent", F.greatest(F.lit(0.0), 10 - F.coalesce("lost", F.lit(0.0))).alias("score"))


def credible_security() -> Column:
    """Whether any finding is a grave and credible security issue outside tests."""
    return F.coalesce(F.bool_or((F.col("category") == "security") & F.col("severity").isin("CRITICAL", "HIGH") & F.col("confidence").isin("CERTAIN", "HIGH") & ~is_test(F.col("file"))), F.lit(False))


def overall(findings: DataFrame, scores: DataFrame) -> DataFrame:
    """One row: weighted (mean of the category scores, which are rounded before), capped, score."""
    mean = scores.agg((F.sum(F.col("percent") * F.round("score", 1)) / F.sum("percent")).alias("weighted"))
    both = mean.crossJoin(findings.agg(credible_security().alias("credible")))  # one row each
    capped = F.col("credible") & (F.col("weighted") > CAP)
    return both.select("weighted", capped.alias("capped"), F.round(F.when(capped, CAP).otherwise(F.col("weighted")), 1).alias("score"))


def drains(costs: DataFrame, architecture: bool = True, top: int | None = 3) -> DataFrame:
    """Rules by the points they take off the overall score. A category's rules together take 10 at most."""
    chosen = {k: v for k, v in CATEGORY_PERCENT.items() if architecture or k != "architecture"}
    total = F.sum("cost").over(W.partitionBy("category"))
    share = look_up(F.col("category"), chosen) / float(sum(chosen.values()))
    out = costs.withColumn("lost", share * F.col("cost") * F.when(total > 10, 10 / total).otherwise(1.0)).filter("lost > 0").select("rule_id", "category", "findings", "lost")
    return out if top is None else out.orderBy(F.desc(F.round("lost", 9)), "rule_id").limit(top)


def top_deductions(findings: DataFrame, top: int = 8) -> DataFrame:
    sums = findings.groupBy("rule_id", "category").agg(F.count("*").alias("findings"), F.sum(penalty()).alias("penalty"))
    return sums.orderBy(F.desc(F.round("penalty", 6)), "rule_id").limit(top)


def hotspots(findings: DataFrame, top: int = 5) -> DataFrame:
    sums = findings.groupBy("file").agg(F.count("*").alias("findings"), F.sum(penalty()).alias("penalty"), F.max(severity_rank(F.col("severity"))).alias("r"))
    best = sums.orderBy(F.desc(F.round("penalty", 6)), "file").limit(top)
    return best.select("file", "findings", "penalty", F.element_at(F.array(*map(F.lit, SEVERITIES)), F.col("r") + 1).alias("worst"))


def severity_histogram(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count("*").alias("findings"))


def category_worst(findings: DataFrame) -> DataFrame:
    """Findings and worst severity of each category."""
    sums = findings.groupBy("category").agg(F.count("*").alias("findings"), F.max(severity_rank(F.col("severity"))).alias("r"))
    return sums.select("category", "findings", F.element_at(F.array(*map(F.lit, SEVERITIES)), F.col("r") + 1).alias("worst"))


def top_issue_per_category(findings: DataFrame, top: int = 6) -> DataFrame:
    """The gravest finding of each category, by severity, confidence and place. A maximum per category, not a sort of each."""
    from ..catalog import CONFIDENCES, confidence_rank

    place = F.struct((-severity_rank(F.col("severity"))).alias("s"), (-confidence_rank(F.col("confidence"))).alias("c"), "file", "line", "rule_id", "evidence")
    best = findings.groupBy("category").agg(F.min(place).alias("b"))
    out = best.select("category", "b.rule_id", "b.file", "b.line", F.element_at(F.array(*map(F.lit, SEVERITIES)), 1 - F.col("b.s")).alias("severity"), F.element_at(F.array(*map(F.lit, CONFIDENCES)), 1 - F.col("b.c")).alias("confidence"))
    return out.orderBy(F.desc(severity_rank(F.col("severity"))), F.desc(confidence_rank(F.col("confidence"))), "category").limit(top)


def noisy_directories(findings: DataFrame, top: int = 5, least: int = 25, share: float = 0.1) -> DataFrame:
    """Directories with many of all findings: one path segment, two below packages and apps."""
    parts = F.split("file", "/")
    name = F.when((F.size(parts) > 2) & F.element_at(parts, 1).isin("apps", "packages"), F.concat_ws("/", F.slice(parts, 1, 2))).when(F.size(parts) > 1, F.element_at(parts, 1)).otherwise(".")
    sums = findings.groupBy(name.alias("directory")).agg(F.count("*").alias("findings"))
    total = F.sum("findings").over(W.partitionBy())  # over directories, not findings
    return sums.withColumn("total", total).filter((F.col("findings") >= least) & (F.col("findings") >= share * F.col("total"))).orderBy(F.desc("findings"), "directory").limit(top).select("directory", "findings", "total")


def legacy_majority(variables: DataFrame, rule: str = "JS001", least: int = 25, share: float = 0.9) -> DataFrame:
    """One row: whether a code base is written in the old style throughout, so that the rule says nothing about it. variables: rule_id or null."""
    hits = F.count(F.when(F.col("rule_id") == rule, 1))
    return variables.agg(hits.alias("old"), F.count("*").alias("declarations"), ((hits >= least) & (hits >= share * F.count("*"))).alias("silent"))
