"""The rule catalog, score weights and orders, as plain data and as small DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEVERITIES = ("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL")
CONFIDENCES = ("LOW", "MEDIUM", "HIGH", "CERTAIN")
SEVERITY_COST = dict(zip(SEVERITIES, (0.0, 0.8, 1.5, 2.5, 3.0)))
CONFIDENCE_SHARE = dict(zip(CONFIDENCES, (0.3, 0.6, 0.8, 1.0)))
#: Percent of the overall score. The blend divides by the sum of those that count.
CATEGORY_PERCENT = {
    "security": 15, "complexity": 15, "deadCode": 15, "dependencies": 10, "duplication": 10,
    "errorHandling": 10, "typescript": 10, "redundantLogic": 5, "architecture": 5, "hygiene": 5,
}

# id: (category, severity, confidence, where it applies, threshold, what it reports)
_M, _L, _H, _C = "MEDIUM", "LOW", "HIGH", "CERTAIN"
RULES: dict[str, tuple[str, str, str, str, int | None, str]] = {
    "ARCH001": ("architecture", _H, _C, "everywhere", None, "An import crosses layers that are kept apart"),
    "COMPLEX001": ("complexity", _M, _H, "production", 10, "Too many independent paths"),
    "COMPLEX002": ("complexity", _M, _H, "production", 15, "Too hard to follow"),
    "COMPLEX003": ("complexity", _M, _H, "production", 100, "A very long function"),
    "COMPLEX004": ("complexity", _M, _H, "production", 5, "Many parameters"),
    "COMPLEX005": ("complexity", _M, _H, "production", 4, "Blocks nested deeply"),
    "DEAD002": ("deadCode", _M, _C, "everywhere", None, "An import nobody uses"),
    "DEAD003": ("deadCode", _M, _C, "production", None, "A variable nobody reads"),
    "DEAD004": ("deadCode", _M, _C, "production", None, "A function nobody calls"),
    "DEAD005": ("deadCode", _M, _C, "production", None, "A class nobody uses"),
    "DEAD006": ("deadCode", _L, _C, "production", None, "A parameter nobody reads"),
    "DEAD007": ("deadCode", _M, _C, "production", None, "A type nobody names"),
    "DEAD009": ("deadCode", _M, _M, "production", None, "An export nobody imports"),
    "DEAD010": ("deadCode", _M, _M, "production", None, "A file nothing reaches"),
    "DEAD011": ("deadCode", _M, _C, "everywhere", None, "Code behind an exit"),
    "DEP001": ("dependencies", _M, _C, "everywhere", None, "A declared package without a use"),
    "DEP002": ("dependencies", _H, _H, "everywhere", None, "A used package without a declaration"),
    "DEP003": ("dependencies", _M, _H, "production", None, "Modules that import one another in a ring"),
    "DUP001": ("duplication", _L, _M, "production", 60, "A block of code that stands elsewhere too"),
    "ERR001": ("errorHandling", _M, _C, "production", None, "A catch that does nothing"),
    "ERR002": ("errorHandling", _L, _H, "production", None, "A catch that only throws on"),
    "ERR003": ("errorHandling", _M, _M, "production", None, "A promise left alone"),
    "ERR004": ("errorHandling", _M, _M, "production", None, "A chain without a catch"),
    "HYGIENE001": ("hygiene", _L, _C, "production", None, "A debug statement"),
    "HYGIENE002": ("hygiene", _L, _M, "production", None, "A marker in a comment"),
    "HYGIENE003": ("hygiene", _L, _H, "everywhere", None, "A backup file"),
    "HYGIENE004": ("hygiene", _H, _M, "everywhere", None, "An environment file"),
    "JS001": ("hygiene", _L, _C, "production", None, "A var declaration"),
    "JS002": ("hygiene", _L, _C, "production", None, "An equality that coerces"),
    "REDUNDANT001": ("redundantLogic", _L, _C, "production", None, "A boolean compared with a literal"),
    "REDUNDANT002": ("redundantLogic", _M, _C, "production", None, "A condition that never changes"),
    "SEC001": ("security", _H, _H, "everywhere", None, "A credential in the code"),
    "SEC002": ("security", _H, _C, "runtime", None, "Text run as code"),
    "SEC003": ("security", _H, _M, "runtime", None, "A command built from data"),
    "SEC004": ("security", _M, _M, "runtime", None, "Markup inserted unescaped"),
    "SEC005": ("security", _M, _H, "runtime", None, "A weak hash"),
    "SEC007": ("security", _H, _H, "runtime", None, "Certificates left unchecked"),
    "SEC008": ("security", _H, _M, "runtime", None, "A query built from data"),
    "SEC009": ("security", _H, _L, "runtime", None, "A path built from data"),
    "SEC010": ("security", _H, _M, "runtime", None, "Objects revived unsafely"),
    "SEC011": ("security", _M, _M, "runtime", None, "A prototype open to writes"),
    "SEC012": ("security", _M, _H, "runtime", None, "A redirect to anywhere"),
    "SEC013": ("security", _H, _H, "runtime", None, "A request to anywhere"),
    "SEC014": ("security", _M, _M, "runtime", None, "A pattern built from data"),
    "TS001": ("typescript", _M, _C, "production", None, "A type that allows anything"),
    "TS002": ("typescript", _M, _C, "production", None, "Type checking switched off"),
    "TS003": ("typescript", _L, _C, "production", None, "A null check waved away"),
}
#: Ids that are scoped though no rule here emits them.
RESERVED_SCOPES = {"JS003": "production", "SEC006": "runtime"}
SCOPES = {r: v[3] for r, v in RULES.items()} | RESERVED_SCOPES
FINDING = "rule_id string, category string, severity string, confidence string, file string, line int, col int, evidence string"


def rules(spark: SparkSession) -> DataFrame:
    rows = [(r, *v) for r, v in sorted(RULES.items())]
    return spark.createDataFrame(rows, "rule_id string, category string, severity string, confidence string, scope string, threshold int, title string")


def look_up(c: Column, table: dict, default=None) -> Column:
    """A constant table as a map literal: one lookup, however large the table, where a CASE would outgrow generated code."""
    found = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[c]
    return found if default is None else F.coalesce(found, F.lit(default))


def severity_rank(c: Column) -> Column:
    return look_up(c, {s: i for i, s in enumerate(SEVERITIES)})


def confidence_rank(c: Column) -> Column:
    return look_up(c, {s: i for i, s in enumerate(CONFIDENCES)})
