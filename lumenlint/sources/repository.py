"""Files of repositories as a relation, with the role each plays in a scan."""

from __future__ import annotations

import json
import os
import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import CACHE_DIRS, OUTPUT_DIRS, is_generated_path, is_source, is_unscannable, matches_any

MAX_SOURCE, MAX_TEXT = 1_500_000, 1_000_000
DEFAULTS = {"project": {}, "scan": {"include": ["**/*"], "exclude": [], "includeNonProduction": False}, "architecture": {"layers": {}}, "rules": {}}


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """file (relative), size, content of all files below root, cache folders pruned before content is read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/") + "/"
    path = F.regexp_replace("path", r"^[a-z]+:/+", "/")
    keep = ~path.rlike("/(" + "|".join(d.replace(".", r"\.") for d in CACHE_DIRS) + ")/")
    return raw.filter(keep).select(F.substring(path, len(base.replace("file://", "")) + 1, 1 << 30).alias("file"), F.col("length").alias("size"), "content")


def tracked_files(root: str) -> list[str] | None:
    """Paths git knows or would add, or null outside of a work tree. Runs on the driver: it is about one local checkout."""
    got = subprocess.run(["git", "-C", root, "ls-files", "-z", "--cached", "--others", "--exclude-standard"], capture_output=True, text=True)
    names = sorted({x for x in got.stdout.split("\0") if x and os.path.isfile(os.path.join(root, x))}) if got.returncode == 0 else []
    return names or None


def load_config(text: str | None) -> dict:
    """A configuration over the defaults; a broken one counts as none."""
    try:
        own = json.loads(text) if text else {}
    except ValueError:
        own = {}
    return {k: {**v, **own[k]} if isinstance(own.get(k), dict) else v for k, v in DEFAULTS.items()}


# Fixed values of the next two: marks that generators leave, the numbers of lines and characters looked at, and the limits.
def generated_header(text: Column) -> Column:
    """Whether the comments at the top say that a tool wrote the file, or its end carries a source map."""
    lines = F.slice(F.split(text, r"\r\n|\r|\n", -1), 1, 40)
    code = F.transform(lines, lambda x: (F.trim(x) != "") & ~F.trim(x).rlike(r"^(//|/\*|\*|#!|'use |\"use )"))
    head = F.array_join(F.when(F.array_position(code, True) > 0, F.slice(lines, F.lit(1), (F.array_position(code, True) - 1).cast("int"))).otherwise(lines), "\n")
    says = head.rlike(r"\bDO NOT EDIT\b") | head.rlike(r"(?i)@generated\b|\bauto-?generated\b|\bgenerated file\b|\bthis file (was|is) (automatically )?generated\b")
    return says | F.substring(text, -400, 400).rlike(r"(?m)^//[@#]\s*sourceMappingURL=")


def minified(text: Column) -> Column:
    """Long lines: over 200 characters on average, or over 120 below a licence banner."""
    mean = F.length(text) / F.size(F.split(text, "\n", -1))
    banner = F.substring(text, 1, 2500).rlike(r"(^|\n)\s*/\*!")
    return (F.length(text) >= 2000) & ((mean > 200) | ((mean > 120) & banner))


def binary(content: Column) -> Column:
    """A zero byte among the first 8000."""
    return F.locate("00", F.regexp_replace(F.hex(F.substring(content, 1, 8000)), "(..)", "$1 ")) > 0


def output_dirs(files: DataFrame) -> DataFrame:
    """prefix: build output, which lies directly in a package's root (a folder with a manifest)."""
    roots = files.filter(F.col("file").rlike(r"(^|/)package\.json$")).select(F.regexp_replace("file", r"package\.json$", "").alias("root"))
    return roots.select(F.explode(F.array(*[F.concat("root", F.lit(d + "/")) for d in OUTPUT_DIRS])).alias("prefix")).distinct()


def roles(files: DataFrame, include: list[str], exclude: list[str]) -> DataFrame:
    """files (file, size, text) with `role`: ignored, excluded, too_large, binary, generated, source or text. The order decides."""
    up = F.transform(F.sequence(F.lit(1), F.size(F.split("file", "/"))), lambda i: F.concat(F.array_join(F.slice(F.split("file", "/"), F.lit(1), i), "/"), F.lit("/")))
    below = files.select("file", F.explode(up).alias("prefix")).join(output_dirs(files), "prefix", "left_semi").select("file").distinct().withColumn("output", F.lit(True))
    source = is_source(F.col("file"))
    role = (
        F.when(F.coalesce("output", F.lit(False)) | F.col("file").rlike("(^|/)(" + "|".join(d.replace(".", r"\.") for d in CACHE_DIRS) + ")/"), "ignored")
        .when(matches_any(F.col("file"), exclude) | (source & ~matches_any(F.col("file"), include)), "excluded")
        .when(F.col("size") > F.when(source, MAX_SOURCE).otherwise(MAX_TEXT), "too_large")
        .when(is_unscannable(F.col("file")) | F.col("text").contains("\0"), "binary")
        .when(source & (is_generated_path(F.col("file")) | generated_header(F.col("text")) | minified(F.col("text"))), "generated")
        .when(source, "source").otherwise("text")
    )
    return files.join(below, "file", "left").withColumn("role", role).drop("output")
