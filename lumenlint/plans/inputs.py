"""Relations the queries run on, derived from the tables with the same arithmetic in Spark and in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import RULES, look_up

#: By user_id % 10: directories of every kind of file.
DIRECTORIES = ("src/", "src/api/", "lib/core/", "tests/", "type-tests/", "examples/", "bench/", "scripts/", "fixtures/", "vendor/")
#: (event_type, event_id % 3): rule. Severity and confidence are the catalog's, but INFO and LOW in some cases.
EMITTED = {
    "view": ("DEAD009", "HYGIENE001", "COMPLEX001"), "click": ("ERR003", "TS001", "DUP001"), "error": ("SEC001", "SEC008", "SEC013"),
    "purchase": ("DEP001", "JS001", "ARCH001"), "signup": ("SEC009", "REDUNDANT002", "HYGIENE004"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repo, rule_id, category, severity, confidence, file, line, col, evidence: one for each event."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    rule = look_up(F.concat("event_type", F.pmod("event_id", F.lit(3)).cast("string")), {f"{t}{i}": r for t, rs in EMITTED.items() for i, r in enumerate(rs)})
    e = e.withColumn("rule_id", rule)
    of = lambda i: look_up(F.col("rule_id"), {r: RULES[r][i] for rs in EMITTED.values() for r in rs})
    return e.select(
        F.concat(F.lit("repo"), F.pmod("user_id", F.lit(3)).cast("string")).alias("repo"), "rule_id", of(0).alias("category"),
        F.when(F.col("event_id") % 11 == 0, "INFO").when(F.col("event_id") % 13 == 0, "CRITICAL").otherwise(of(1)).alias("severity"),
        F.when(F.col("event_id") % 7 == 0, "LOW").otherwise(of(2)).alias("confidence"),
        F.concat(look_up(F.pmod("user_id", F.lit(10)), dict(enumerate(DIRECTORIES))), F.lit("f"), F.col("user_id").cast("string"), F.lit(".ts")).alias("file"),
        (F.col("event_id") % 200 + 1).cast("int").alias("line"), (F.col("event_id") % 40 + 1).cast("int").alias("col"),
        F.concat("event_type", F.lit("  "), F.floor("value").cast("string")).alias("evidence"),
    )


def _case(column: str, pairs: dict) -> str:
    quote = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return "CASE " + " ".join(f"WHEN {column} = {quote(k)} THEN {quote(v)}" for k, v in pairs.items()) + " END"


def case(column: str, pairs: dict) -> str:
    return _case(column, pairs)


_RULE = _case("event_type || (event_id % 3)::VARCHAR", {f"{t}{i}": r for t, rs in EMITTED.items() for i, r in enumerate(rs)})
_OF = lambda i: _case("rule_id", {r: RULES[r][i] for rs in EMITTED.values() for r in rs})
#: A CTE named findings, the same relation.
FINDINGS_SQL = f"""e AS (SELECT *, {_RULE} AS rule_id FROM events),
findings AS (SELECT 'repo' || (user_id % 3)::VARCHAR AS repo, rule_id, {_OF(0)} AS category,
  CASE WHEN event_id % 11 = 0 THEN 'INFO' WHEN event_id % 13 = 0 THEN 'CRITICAL' ELSE {_OF(1)} END AS severity,
  CASE WHEN event_id % 7 = 0 THEN 'LOW' ELSE {_OF(2)} END AS confidence,
  {_case('user_id % 10', dict(enumerate(DIRECTORIES)))} || 'f' || user_id::VARCHAR || '.ts' AS file,
  (event_id % 200 + 1)::INTEGER AS line, (event_id % 40 + 1)::INTEGER AS col, event_type || '  ' || floor(value)::BIGINT::VARCHAR AS evidence FROM e)"""


def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, text of documents, pages and conversations as one collection of files."""
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("docs/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file"), "text")
    p = table(spark, sf_dir, "pages").select(F.concat(F.lit("site/"), F.col("page_id").cast("string"), F.lit(".html")).alias("file"), F.col("html").alias("text"))
    c = table(spark, sf_dir, "conversations").select(F.concat(F.lit("chats/"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"), F.lit(".txt")).alias("file"), "text")
    return d.unionByName(p).unionByName(c)


FILES_SQL = """files AS (SELECT 'docs/' || source || '/' || doc_id || '.md' AS file, text FROM documents
UNION ALL SELECT 'site/' || page_id || '.html', html FROM pages
UNION ALL SELECT 'chats/' || conv_id || '-' || turn || '.txt', text FROM conversations)"""
LINES_SQL = FILES_SQL + r""",
parts AS (SELECT file, regexp_split_to_array(text, '\r\n|\r|\n') AS p FROM files),
lines AS (SELECT file, unnest(p) AS text, generate_subscripts(p, 1) AS line FROM parts)"""


def import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst: every supplier is a module that imports the one its balance names; those of five nations import their successor too."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    n = F.lit(max(1, s.count()))
    named = F.pmod(F.floor(F.abs("s_acctbal") * 100).cast("long"), n) + 1
    after = F.pmod(F.col("s_suppkey").cast("long"), n) + 1
    both = s.select("s_suppkey", F.explode(F.when(F.col("s_nationkey") < 5, F.array(named, after)).otherwise(F.array(named))).alias("to"))
    return both.select(module("s_suppkey").alias("src"), module("to").alias("dst")).distinct()


def module(c: str) -> Column:
    return F.concat(F.lit("m"), F.lpad(F.col(c).cast("string"), 6, "0"))


_MODULE = lambda c: f"'m' || lpad(({c})::VARCHAR, 6, '0')"
EDGES_SQL = f"""sn AS (SELECT s_suppkey, s_nationkey, s_acctbal, count(*) OVER () AS n FROM supplier),
st AS (SELECT s_suppkey, floor(abs(s_acctbal) * 100)::BIGINT % n + 1 AS t FROM sn UNION ALL SELECT s_suppkey, s_suppkey % n + 1 FROM sn WHERE s_nationkey < 5),
edges AS (SELECT DISTINCT {_MODULE('s_suppkey')} AS src, {_MODULE('t')} AS dst FROM st)"""
MODULES_SQL = f"modules AS (SELECT {_MODULE('s_suppkey')} AS path FROM supplier)"
#: Kinds as the directories above have them, said apart from the predicates that the queries use.
KINDS_SQL = lambda c: f"""CASE split_part({c}, '/', 1) WHEN 'tests' THEN 'test' WHEN 'type-tests' THEN 'typeTest' WHEN 'examples' THEN 'example'
WHEN 'bench' THEN 'benchmark' WHEN 'scripts' THEN 'script' WHEN 'fixtures' THEN 'fixture' WHEN 'vendor' THEN 'vendor' ELSE 'production' END"""  # noqa: E731
TEST_SQL = "split_part(file, '/', 1) IN ('tests', 'fixtures')"
