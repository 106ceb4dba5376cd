"""DUP001 unites blocks and overlapping blocks, not files."""

import random

from pyspark.sql import functions as F

from lumenlint.operators import duplication as D
from lumenlint.plans.scan import duplicate_findings


def code(seed, statements=10):
    rng = random.Random(seed)
    return "".join(f"r{i} = a{i}" + "".join(f" {rng.choice(['+', '-', '*', '/', '<', '>'])} {v}{i}" for v in "bcdefg") + ";\n" for i in range(statements))


def test_two_blocks_of_one_file_are_two_clusters(spark):
    p, q, other = code(1), code(2), [code(s) for s in (3, 4, 5)]
    files = [("x.ts", p + other[0] + q), ("y.ts", p + other[1]), ("z.ts", q + other[2])]
    got = sorted((r.file, r.line) for r in duplicate_findings(spark.createDataFrame(files, "file string, text string")).collect())
    assert got == [("x.ts", 1), ("x.ts", 21)]


def test_overlapping_blocks_are_one_place(spark):
    blocks = [("a", 1, 9), ("a", 9, 12), ("a", 3, 4), ("a", 13, 20), ("b", 5, 6)]
    got = {(r["file"], r["from"]): r["place"] for r in D.places(spark.createDataFrame(blocks, "file string, `from` int, `to` int")).collect()}
    assert got == {("a", 1): 1, ("a", 9): 1, ("a", 3): 1, ("a", 13): 13, ("b", 5): 5}


def test_repeats_are_counted_over_as_many_tasks_as_the_texts_take(spark, monkeypatch):
    monkeypatch.setattr(D, "PART", 1000)
    files = spark.createDataFrame([(i, None if i == 7 else "x" * 100) for i in range(300)], "file long, text string")
    assert D.parts(files) == 30 and D.parts(files.filter("file < 0")) == spark.sparkContext.defaultParallelism
    found = spark.range(6000).select((F.col("id") % 300).alias("file"), F.col("id").cast("int").alias("start"), F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 2500).cast("string")).cast("binary").alias("hash"))
    got = D.repeated(found, D.parts(files))
    assert got.rdd.getNumPartitions() == 30
    want = found.groupBy("hash").agg(F.countDistinct("file").alias("copies"), F.count("*").alias("places")).filter("copies > 1")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
