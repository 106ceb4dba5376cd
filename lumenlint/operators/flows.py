"""Request data across functions and files: the rows of each function joined until nothing new comes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.state import materialise
from ..javascript.flows import RULE_OF
from .graph import SUFFIXES

#: Sinks for which only the beginning of a text matters, and those that are never more than likely.
BEGINNINGS, LIKELY = ("SEC012", "SEC013"), ("SEC011", "SEC014")


def callee_files(rows: DataFrame, files: DataFrame) -> DataFrame:
    """rows of calls with `callee_file`: their own file, or the first existing one that the import's path names."""
    wanted = rows.filter("path IS NOT NULL").select("path").distinct()
    tries = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(s).alias("s")) for i, s in enumerate(SUFFIXES)])
    each = wanted.select("path", F.explode(tries).alias("t")).select("path", "t.rank", F.concat("path", "t.s").alias("file"))
    found = each.join(files.select("file").distinct(), "file").groupBy("path").agg(F.min_by("file", "rank").alias("imported"))
    return rows.join(found, "path", "left").withColumn("callee_file", F.when(F.col("source") == "", F.col("file")).otherwise(F.col("imported"))).drop("imported")


def tainted(rows: DataFrame, files: DataFrame, max_rounds: int = 40) -> DataFrame:
    """file, fn, origin (a parameter, as p0), from (request or argv), leading, clean: parameters that get such data."""
    calls = callee_files(rows.filter("what = 'call'"), files).filter("callee_file IS NOT NULL")
    calls = materialise(calls.select("file", "fn", "origin", "leading", "clean", "callee_file", "callee", "arg").distinct(), "calls")
    to = [F.col("callee_file").alias("file"), F.col("callee").alias("fn"), F.concat(F.lit("p"), F.col("arg").cast("string")).alias("origin")]
    new = materialise(calls.filter("origin IN ('request', 'argv')").select(*to, F.col("origin").alias("from"), "leading", "clean").distinct(), "tainted")
    known = new
    c = calls.select(F.col("file").alias("c_file"), F.col("fn").alias("c_fn"), F.col("origin").alias("c_origin"), F.col("leading").alias("c_leading"), F.col("clean").alias("c_clean"), "callee_file", "callee", "arg")
    for _ in range(max_rounds):
        both = new.join(c, (F.col("file") == F.col("c_file")) & (F.col("fn") == F.col("c_fn")) & (F.col("origin") == F.col("c_origin")))
        clean = F.array_join(F.array_sort(F.array_distinct(F.filter(F.concat(F.split("clean", ","), F.split("c_clean", ",")), lambda x: x != ""))), ",")
        step = both.select(*to, "from", (F.col("leading") & F.col("c_leading")).alias("leading"), clean.alias("clean")).distinct()
        new = materialise(step.join(known, known.columns, "left_anti"), "tainted")
        if new.isEmpty():
            return known
        known = materialise(known.unionByName(new), "known")
    raise RuntimeError("flows did not settle")


def flow_findings(rows: DataFrame, files: DataFrame) -> DataFrame:
    """rule_id, file, line, col, confidence, evidence of sinks that request data or arguments reach, once per place."""
    sinks = rows.filter("what = 'sink'")
    direct = sinks.filter("origin IN ('request', 'argv')").select("rule_id", "file", "line", "col", "evidence", F.col("origin").alias("from"), F.lit(True).alias("direct"))
    kind = F.create_map(*[F.lit(x) for k, r in RULE_OF.items() for x in (r, k)])[F.col("rule_id")]
    t = tainted(rows, files).withColumnsRenamed({"leading": "t_leading", "clean": "t_clean"})
    via = sinks.join(t, ["file", "fn", "origin"]).filter(~F.array_contains(F.split("t_clean", ","), kind) & (F.col("t_leading") | ~F.col("rule_id").isin(*BEGINNINGS)))
    both = direct.unionByName(via.select("rule_id", "file", "line", "col", "evidence", "from", F.lit(False).alias("direct")))
    sure = F.col("direct") & (F.col("from") == "request") & ~F.col("rule_id").isin(*LIKELY)
    return both.withColumn("sure", sure).groupBy("rule_id", "file", "line").agg(F.min("col").alias("col"), F.when(F.bool_or("sure"), "HIGH").otherwise("MEDIUM").alias("confidence"), F.min("evidence").alias("evidence"))


def cleared(rows: DataFrame) -> DataFrame:
    """rule_id, file, line of sinks that only get what was made safe for them."""
    at = ["rule_id", "file", "line"]
    return rows.filter("what = 'clean'").select(*at).distinct().join(rows.filter("what = 'sink'").select(*at).distinct(), at, "left_anti")
