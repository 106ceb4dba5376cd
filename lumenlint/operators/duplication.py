"""Repeated blocks: windows of tokens that occur in two places or more, joined to islands and clusters.

Windows are hashed where their file is, so only (hash, file, start) shuffles. A hash that very many files hold is cut to
a star from its first file (a window's first value, which is map-side combined), never to all pairs.
Nearly all hashes are unique, so what a task holds of them is bounded by dealing them over tasks in the input's proportion.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.state import materialise

WIDTH, STEP = 60, 5
PART = 8_000_000  # characters whose windows a task holds: 800,000 windows of single letters, mostly some 250,000
SALTS = 64  # tasks over which the places of one hash are dealt


def windows(files: DataFrame, tokens: Column, width: int = WIDTH, step: int = STEP) -> DataFrame:
    """file, start (0-based token), hash of every step-th window of width tokens. tokens: array of strings.

    Windows begin and end at multiples of what step and width have in common. Tokens are hashed in chunks of that many,
    and a window over its chunks' hashes, from two seeds: 16 bytes leave each.
    """
    chunk = gcd(width, step)
    # No filter on sizes: it would move below and make the tokens a second time. A null array has no windows.
    starts = lambda c, n, by: F.when(F.size(c) >= n, F.sequence(F.lit(0), F.size(c) - n, F.lit(by)))
    c = files.select("file", tokens.alias("t")).select("file", F.transform(starts("t", chunk, chunk), lambda i: F.xxhash64(F.slice("t", i + 1, F.lit(chunk)))).alias("c"))
    at = starts("c", width // chunk, step // chunk)
    each = c.select("file", F.explode(F.transform(at, lambda i: F.struct((i * chunk).alias("start"), F.slice("c", i + 1, F.lit(width // chunk)).alias("w")))).alias("x"))
    half = lambda *seed: F.lpad(F.hex(F.xxhash64(*seed, F.col("x.w"))), 16, "0")
    return each.select("file", F.col("x.start").cast("int").alias("start"), F.unhex(F.concat(half(), half(F.lit(1)))).alias("hash"))


def parts(files: DataFrame) -> int:
    """Over how many tasks the windows of files (text) are to be dealt. Reads all texts once, but doesn't cut them."""
    characters = files.agg(F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0))).first()[0]
    return max(files.sparkSession.sparkContext.defaultParallelism, -(-characters // PART))


def repeated(found: DataFrame, tasks: int) -> DataFrame:
    """hash, copies (files), places, of hashes in two files or more. tasks: as `parts` counts them.

    Places are counted where a hash's share of files is, without a table of all windows before the shuffle; shares are added up.
    """
    shared = found.select("hash", "file", F.pmod(F.xxhash64("file"), F.lit(SALTS)).alias("salt")).repartition(tasks, "hash", "salt")
    share = shared.groupBy("hash", "salt", "file").agg(F.count("*").alias("places")).groupBy("hash", "salt").agg(F.count("file").alias("copies"), F.sum("places").alias("places"))
    return share.drop("salt").repartition(tasks, "hash").groupBy("hash").agg(F.sum("copies").alias("copies"), F.sum("places").alias("places")).filter("copies > 1")


def star_pairs(found: DataFrame) -> DataFrame:
    """a, b, a_start, b_start: the first place of a hash in its first file, with the first place in each other file.

    Hashes of one file only, which nearly all are, go after the first aggregation; the rest is a small table, so that
    windows meet it in one more shuffle, or in none where it is small enough for Spark to broadcast.
    """
    first = found.groupBy("hash").agg(F.min(F.struct("file", "start")).alias("f"), F.max("file").alias("last_file")).filter(F.col("last_file") != F.col("f.file"))
    first = materialise(first.select("hash", "f"), "repeated-windows")
    per_file = found.join(first, "hash").filter(F.col("file") != F.col("f.file")).groupBy("hash", "file", "f").agg(F.min("start").alias("start"))
    return per_file.select(F.col("f.file").alias("a"), F.col("file").alias("b"), F.col("f.start").alias("a_start"), F.col("start").alias("b_start"))


def islands(pairs: DataFrame, width: int = WIDTH) -> DataFrame:
    """a, b, a_start, a_end, b_start: runs of windows that overlap at the same offset, joined."""
    shift = F.col("b_start") - F.col("a_start")
    by = W.partitionBy("a", "b", "shift").orderBy("a_start")
    reach = F.max(F.col("a_start") + width).over(by.rowsBetween(W.unboundedPreceding, -1))
    marked = pairs.distinct().withColumn("shift", shift).withColumn("new", F.when(F.col("a_start") > F.coalesce(reach, F.lit(-1)), 1).otherwise(0))
    numbered = marked.withColumn("island", F.sum("new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy("a", "b", "shift", "island").agg(F.min("a_start").alias("a_start"), (F.max("a_start") + width).alias("a_end")).select("a", "b", "a_start", "a_end", (F.col("a_start") + F.col("shift")).alias("b_start"))


def places(blocks: DataFrame) -> DataFrame:
    """file, from, to of each distinct block, and place: the first `from` of the run of overlapping blocks of its file."""
    by = W.partitionBy("file").orderBy("from", "to")
    reach = F.max("to").over(by.rowsBetween(W.unboundedPreceding, -1))
    marked = blocks.select("file", "from", "to").distinct().withColumn("new", F.when(reach.isNull() | (F.col("from") > reach), F.col("from")))
    return marked.withColumn("place", F.last("new", True).over(by.rowsBetween(W.unboundedPreceding, 0))).drop("new")


def span_severity(span: Column, width: int = WIDTH) -> Column:
    return F.when(span >= 4 * width, "HIGH").when(span >= 2 * width, "MEDIUM").otherwise("LOW")


def data_windows(files: DataFrame, tokens: Column, is_literal: Column, width: int = WIDTH, step: int = STEP, share: float = 0.3) -> DataFrame:
    """file, start, literals: windows of data rather than logic, with at least that share of literals. is_literal: array of 0 and 1."""
    t = files.select("file", tokens.alias("t"), is_literal.alias("l")).filter(F.size("t") >= width)
    at = t.select("file", "l", F.explode(F.sequence(F.lit(0), F.size("t") - width, F.lit(step))).alias("start"))
    n = F.aggregate(F.slice("l", F.col("start") + 1, width), F.lit(0), lambda a, x: a + x)
    return at.select("file", F.col("start").cast("int").alias("start"), n.alias("literals")).filter(F.col("literals") >= share * width)
