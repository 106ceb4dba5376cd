"""Relations read from what people and other tools write: labels, planted cases, reports, aliases of imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LABEL = "repo string, rule string, file string, line int, verdict boolean, reason string"
PLANTED = "id string, rule string, file string, line string, issue string"
RESULT = "repo string, commit string, score double, durationMs long, findings array<struct<ruleId: string, severity: string, confidence: string, file: string, line: int>>"


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """repo, rule_id, file, line, verdict of JSON lines. Those without a verdict wait for one; a malformed line fails the job."""
    raw = spark.read.schema(LABEL).option("mode", "FAILFAST").json(path)
    return raw.filter("verdict IS NOT NULL").select("repo", F.col("rule").alias("rule_id"), "file", "line", "verdict")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """repo, rule_id, severity, confidence, file, line of saved corpus results. A commit that isn't 40 hex digits fails the job."""
    raw = spark.read.schema(RESULT).option("multiLine", True).json(path)
    pinned = F.when(F.col("commit").rlike("^[0-9a-f]{40}$"), F.col("repo")).otherwise(F.raise_error(F.concat(F.lit("not a pinned commit: "), F.coalesce("commit", F.lit("none")))))
    return raw.select(pinned.alias("repo"), F.explode("findings").alias("f")).select("repo", F.col("f.ruleId").alias("rule_id"), "f.severity", "f.confidence", "f.file", "f.line")


def marked_lines(rows: DataFrame) -> DataFrame:
    """id, what (planted or decoy), file, line: the first line whose comment marks an id. rows: file, line, text.

    Ids are read whole, so a longer one never counts as a shorter.
    """
    mark = r"(planted|decoy): ([A-Za-z0-9_-]+)"
    found = rows.select("file", "line", F.regexp_extract("text", mark, 1).alias("what"), F.regexp_extract("text", mark, 2).alias("id")).filter("id <> ''")
    return found.groupBy("id", "what").agg(F.min(F.struct("file", "line")).alias("at")).select("id", "what", "at.file", "at.line")


def _finding(rule: Column, category: str, severity: str, confidence: str, file: Column, line: Column, col: Column, evidence: Column) -> list[Column]:
    return [rule.alias("rule_id"), F.lit(category).alias("category"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence"), file.alias("file"), F.coalesce(line, F.lit(1)).cast("int").alias("line"), F.coalesce(col, F.lit(1)).cast("int").alias("col"), evidence.alias("evidence")]


def secret_report(texts: DataFrame) -> DataFrame:
    """Findings of a secret scanner's report (a JSON array in `text`). The secret itself is never taken over."""
    kind = "array<struct<RuleID: string, Description: string, File: string, StartLine: int, StartColumn: int>>"
    r = texts.select(F.explode(F.from_json("text", kind)).alias("r")).select("r.*")
    return r.select(*_finding(F.concat(F.lit("EXT:"), F.col("RuleID")), "security", "HIGH", "HIGH", F.col("File"), F.col("StartLine"), F.col("StartColumn"), F.concat(F.col("Description"), F.lit(" (redacted)"))))


def unused_report(texts: DataFrame) -> DataFrame:
    """Findings of an unused-code tool's report (a JSON object in `text`)."""
    item = "array<struct<name: string, line: int, col: int>>"
    lists = {"dependencies": "dependencies", "devDependencies": "dependencies", "optionalPeerDependencies": "dependencies", "unlisted": "dependencies", "unresolved": "dependencies", "exports": "deadCode", "types": "deadCode"}
    kind = "struct<files: array<string>, issues: array<struct<file: string, " + ", ".join(f"{k}: {item}" for k in lists) + ">>>"
    r = texts.select(F.from_json("text", kind).alias("r"))
    whole = r.select(F.explode("r.files").alias("f")).select(*_finding(F.lit("EXT:files"), "deadCode", "MEDIUM", "MEDIUM", F.col("f"), F.lit(1), F.lit(1), F.col("f")))
    issues = r.select(F.explode("r.issues").alias("i")).select("i.*")
    out = whole
    for name, category in lists.items():
        one = issues.select("file", F.explode(name).alias("x"))
        out = out.unionByName(one.select(*_finding(F.lit(f"EXT:{name}"), category, "MEDIUM", "MEDIUM", F.col("file"), F.col("x.line"), F.col("x.col"), F.col("x.name"))))
    return out


def _without_comments(text: Column) -> Column:
    """JSON as configurations have it, with comments and trailing commas, made plain. Strings stay untouched."""
    kept = F.regexp_replace(text, r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*[\s\S]*?\*/', "$1")
    return F.regexp_replace(kept, r'("(?:[^"\\]|\\.)*")|,(?=\s*[}\]])', "$1")


def path_aliases(files: DataFrame) -> DataFrame:
    """root, pattern, target of compilerOptions.paths: the first target of each pattern, relative to the repository."""
    own = files.filter(F.col("file").rlike(r"(^|/)[jt]sconfig[^/]*\.json$"))
    v = F.try_parse_json(_without_comments(F.col("text")))
    base = F.coalesce(F.try_variant_get(v, "$.compilerOptions.baseUrl", "string"), F.lit("."))
    maps = F.from_json(F.try_variant_get(v, "$.compilerOptions.paths", "string"), "map<string, array<string>>")
    each = own.select(F.regexp_replace("file", r"[^/]*$", "").alias("root"), base.alias("base"), F.explode(maps).alias("pattern", "targets"))
    joined = F.concat("root", F.col("base"), F.lit("/"), F.element_at("targets", 1))
    return each.select(F.regexp_replace("root", "/$", "").alias("root"), "pattern", F.regexp_replace(F.regexp_replace(joined, r"(^|/)(\./)+", "$1"), r"/{2,}", "/").alias("target"))


def bundler_aliases(files: DataFrame) -> DataFrame:
    """file, alias: keys of alias objects and `find` entries in tool configurations, and of import maps."""
    own = files.filter(F.col("file").rlike(r"(^|/)[^/]*\.config\.[cm]?[jt]s$|(^|/)\.babelrc$|(^|/)(import[-_]?map|deno)[^/]*\.jsonc?$"))
    inside = F.regexp_extract_all("text", F.lit(r"(?:alias|moduleNameMapper|imports)[\"']?\s*:\s*\{([^}]*)\}"), 1)
    keys = F.flatten(F.transform(inside, lambda x: F.regexp_extract_all(x, F.lit(r"[\"']?([\w@~#$/.^*()-]+)[\"']?\s*:(?!:)"), 1)))
    found = F.regexp_extract_all("text", F.lit(r"\bfind\s*:\s*[\"']([^\"']+)[\"']"), 1)
    return own.select("file", F.explode(F.array_distinct(F.concat(keys, found))).alias("alias"))


def resolve_aliases(imports: DataFrame, aliases: DataFrame) -> DataFrame:
    """imports with `path`: what the alias with the longest fitting prefix makes of `target`, or null.

    An equi join over a target's prefixes, no prefix join. A pattern without * fits the whole target only. imports: file,
    target, and others; aliases: pattern, target.
    """
    a = aliases.select(F.substring_index("pattern", "*", 1).alias("prefix"), F.when(F.col("pattern").contains("*"), F.regexp_extract("pattern", r"\*(.*)$", 1)).alias("suffix"), F.col("target").alias("to"))
    wanted = imports.select("target").distinct()
    each = wanted.select("target", F.explode(F.transform(F.sequence(F.lit(0), F.length("target")), lambda i: F.substring("target", F.lit(1), i))).alias("prefix"))
    both = each.join(a, "prefix").filter(F.when(F.col("suffix").isNull(), F.col("target") == F.col("prefix")).otherwise(F.col("target").endswith(F.col("suffix")) & (F.length("target") >= F.length("prefix") + F.length("suffix"))))
    star = F.substring("target", F.length("prefix") + 1, F.length("target") - F.length("prefix") - F.length(F.coalesce("suffix", F.lit(""))))
    made = both.withColumn("path", F.when(F.col("suffix").isNull(), F.col("to")).otherwise(F.concat(F.substring_index("to", "*", 1), star, F.regexp_extract("to", r"\*(.*)$", 1))))
    best = made.groupBy("target").agg(F.max_by("path", F.struct(F.length("prefix"), "path")).alias("path"))
    return imports.drop("path").join(best, "target", "left")
