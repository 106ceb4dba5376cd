"""Relations read out of text formats: diffs, lock files, manifests, imports in prose, configurations.

Line formats are state machines over lines. Where the state is "the last header seen", it is a window per file; a file's
lines stay together, so no window spans files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MANIFEST_SECTIONS = ("dependencies", "devDependencies", "optionalDependencies", "peerDependencies")


def _by_line() -> W:
    return W.partitionBy("file").orderBy("line").rowsBetween(W.unboundedPreceding, 0)


def diff_hunks(rows: DataFrame) -> DataFrame:
    """path, start, last: new-side line ranges of a unified diff without context. rows: file, line, text.

    Deletions have no new side; a hunk of no lines only takes some away.
    """
    head = F.when(F.col("text").startswith("+++ "), F.when(F.col("text").startswith("+++ b/"), F.substring("text", 7, 1 << 30)).otherwise(""))
    hunk = r"^@@ -[0-9]+(,[0-9]+)? \+([0-9]+)(,([0-9]+))? @@"
    got = rows.withColumn("path", F.last(head, ignorenulls=True).over(_by_line())).filter(F.col("text").rlike(hunk) & (F.col("path") != ""))
    n = F.when(F.regexp_extract("text", hunk, 4) == "", 1).otherwise(F.regexp_extract("text", hunk, 4).try_cast("int"))
    start = F.regexp_extract("text", hunk, 2).cast("int")
    return got.select("path", start.alias("start"), (start + n - 1).alias("last")).filter("last >= start")


def prose_imports(rows: DataFrame) -> DataFrame:
    """file, line, target of import lines outside of fenced code. A fence opens and closes with its own sign."""
    sign = F.regexp_extract("text", r"^\s*(```|~~~)", 1)
    ticks = F.sum(F.when(sign == "```", 1).otherwise(0)).over(_by_line()) % 2
    waves = F.sum(F.when(sign == "~~~", 1).otherwise(0)).over(_by_line()) % 2
    p = r"""^\s*import\s+([^'"]*\s+from\s+)?['"]([^'"]+)['"]"""
    return rows.withColumn("inside", ticks + waves).filter((F.col("inside") == 0) & F.col("text").rlike(p)).select("file", "line", F.regexp_extract("text", p, 2).alias("target"))


def package_of_key(key: Column) -> Column:
    """The package that a lock file's key names: /name@1.0.0, name@1.0.0(peer), @scope/name@2, of both generations of keys."""
    plain = F.regexp_replace(F.regexp_replace(key, r"\(.*$", ""), r"^['\"]?/?|['\"]$", "")
    return F.when(plain.startswith("@"), F.regexp_extract(plain, r"^(@[^/]+/[^/@]+)", 1)).otherwise(F.regexp_extract(plain, r"^([^/@]+)", 1))


def lock_packages(rows: DataFrame) -> DataFrame:
    """file, package, has_bin, peers of the packages section of an indented lock file."""
    section = F.last(F.when(F.col("text").rlike(r"^[A-Za-z]+:"), F.regexp_extract("text", r"^([A-Za-z]+):", 1)), ignorenulls=True).over(_by_line())
    entry = F.when(F.col("text").rlike(r"^  \S.*:\s*$"), F.regexp_extract("text", r"^  (\S.*):\s*$", 1))
    part = F.when(F.col("text").rlike(r"^    \S+:"), F.regexp_extract("text", r"^    (\S+):", 1))
    own = rows.withColumn("section", section).filter("section = 'packages'").withColumn("key", F.last(entry, ignorenulls=True).over(_by_line())).withColumn("part", F.last(part, ignorenulls=True).over(_by_line()))
    peer = F.when((F.col("part") == "peerDependencies") & F.col("text").rlike(r"^      \S+:"), F.regexp_extract("text", r"^      ['\"]?([^'\":]+)", 1))
    each = own.filter("key IS NOT NULL").select("file", package_of_key(F.col("key")).alias("package"), F.coalesce(F.col("text").rlike(r"^    hasBin:\s*true"), F.lit(False)).alias("b"), peer.alias("p"))
    return each.groupBy("file", "package").agg(F.bool_or("b").alias("has_bin"), F.array_join(F.array_sort(F.collect_set("p")), ",").alias("peers"))


def manifest_dependencies(files: DataFrame) -> DataFrame:
    """file, package, section of all declared dependencies. Malformed manifests give none. files: file, text."""
    own = files.filter(F.col("file").rlike(r"(^|/)package\.json$")).select("file", F.try_parse_json("text").alias("v"))
    maps = F.array(*[F.struct(F.lit(s).alias("section"), F.map_keys(F.from_json(F.try_variant_get("v", f"$.{s}", "string"), "map<string,string>")).alias("names")) for s in MANIFEST_SECTIONS])
    return own.select("file", F.explode(maps).alias("m")).select("file", F.explode("m.names").alias("package"), F.col("m.section").alias("section"))


def package_name(target: Column) -> Column:
    """The package of a bare import: its first part, or two with a scope."""
    return F.when(target.startswith("@"), F.substring_index(target, "/", 2)).otherwise(F.substring_index(target, "/", 1))


def is_bare(target: Column) -> Column:
    """Whether an import names a package: no path, no # or URL scheme."""
    return ~target.rlike(r"^([./#]|[A-Za-z][A-Za-z0-9+.-]*:)") & (target != "")


def ignore_globs(lines: list[str]) -> list[str]:
    """Globs of an ignore file: a line with a slash inside is anchored, others fit at any depth; comments and negations are skipped."""
    out = []
    for line in (x.strip() for x in lines):
        if not line or line[0] in "#!":
            continue
        body, anchored = line.strip("/"), "/" in line.rstrip("/")
        base = body if anchored else f"**/{body}"
        out += [f"{base}/**"] if line.endswith("/") else [base, f"{base}/**"]
    return out


def environment(packages: DataFrame, frameworks: dict[str, str]) -> DataFrame:
    """root, frameworks (in the table's order) of packages (root, name): what each declares of a table name -> framework."""
    t = packages.sparkSession.createDataFrame([(i, k, v) for i, (k, v) in enumerate(frameworks.items())], "rank int, name string, framework string")
    found = packages.join(F.broadcast(t), "name").groupBy("root", "framework").agg(F.min("rank").alias("rank"))
    return found.groupBy("root").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "framework"))), lambda x: x["framework"]), ",").alias("frameworks"))
