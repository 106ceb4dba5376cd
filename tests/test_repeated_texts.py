"""Texts that come again are parsed once; every file still gets its own rows."""

import uuid

import pyarrow as pa
from pyspark.sql import functions as F

from lumenlint.operators import code as C
from lumenlint.plans.code import QUERIES
from lumenlint.plans.scan import function_measures

ADD = "export function add(a, b) { const c = a + b; return c * c; }\n"
MORE = ADD + "export const twice = (x) => add(x, x) + add(x, 1);\n"
FILES = [
    ("a/one.ts", ADD), ("b/two.ts", ADD), ("b/two.ts", ADD), ("a/three.js", ADD), ("a/four.ts", MORE), ("a/four.ts", ADD), ("plain", MORE),
    ("a/typed.ts", "const x = <T>(y: T) => y as any;\n"), ("a/typed.tsx", "const x = <T>(y: T) => y as any;\n"), ("bad.ts", "function ("), ("none.ts", None),
]


def test_copies_are_counted_by_file(spark):
    files = spark.createDataFrame(FILES, "file string, text string")
    want = {r["hash"]: r["n"] for r in C.code_windows(files, width=8, step=1).groupBy("hash").agg(F.countDistinct("file").alias("n")).collect()}
    assert max(want.values()) == 5
    assert {r["hash"]: r["copies"] for r in C.code_copies(files, width=8, step=1).collect()} == want


def test_equal_texts_are_cut_once():
    calls = []
    read = C.Kept(lambda file, text: calls.append((file, text)) or {"windows": []})
    batch = pa.RecordBatch.from_pydict({"file": [f"d{i}/f{i}.{'js' if i % 2 else 'ts'}" for i in range(5000)], "text": ["x"] * 5000})
    out = list(C._per_file(iter([batch]), read, C.WINDOWS))
    assert sum(b.num_rows for b in out) == 5000 and calls == [("d0/f0.ts", "x"), ("d1/f1.js", "x")]


def test_what_is_kept_is_bounded(monkeypatch):
    monkeypatch.setattr(C, "KEPT", 1000)
    read = C.Kept(lambda file, text: text)
    for i in range(100):
        assert read("a.ts", f"{i:200d}") == f"{i:200d}"
        assert read.size <= 1000 and len(read.kept) <= 3
    assert read("a.ts", "y" * 5000) == "y" * 5000 and read.size == 0


def test_equal_texts_are_parsed_once_and_imports_follow_their_folder(monkeypatch):
    calls, real = [], C.facts
    monkeypatch.setattr(C, "facts", lambda *a: calls.append(a[0]) or real(*a))
    text = "import { g } from './g';\nexport function f(a) {\n  return g(a);\n}\n"
    files = [f"d{i % 3}/f{i}.ts" for i in range(300)]
    batch = pa.RecordBatch.from_pydict({"file": files, "text": [text] * 300})
    rows = [r for b in C._reader(None)(iter([batch])) for r in b.to_pylist()]
    assert [r["file"] for r in rows] == files and calls == files[:1]
    assert [[e["path"] for e in r["edges"]] for r in rows] == [[f"d{i % 3}/g"] for i in range(300)]
    assert all(len(r["functions"]) == 1 and r["functions"][0]["lines"] == 3 for r in rows)


def test_measures_count_every_file_of_equal_texts(spark, monkeypatch):
    files = spark.createDataFrame([(f"d{i}/f{i}.ts", ADD) for i in range(40)] + [(f"e{i}.ts", MORE) for i in range(10)], "file string, text string")
    got = function_measures(C.relation(C.code_facts(files), "functions")).first()
    assert (got["functions"], got["mean_lines"], got["low"]) == (60, 1.0, 60)
    calls, real = [], C.facts
    monkeypatch.setattr(C, "facts", lambda *a: calls.append(a[0]) or real(*a))
    batch = pa.RecordBatch.from_pydict({"file": [f"e{i}.ts" for i in range(10)], "text": [MORE] * 10})
    rows = [r for b in C._reader(None)(iter([batch])) for r in b.to_pylist()]
    assert [len(r["functions"]) for r in rows] == [2] * 10 and calls == ["e0.ts"]


def test_functions_by_text_are_those_of_all_files(spark):
    more = [("ts", "function f(a: any) { return a; }\n"), ("d.x/plain", ADD), ("A.TS", ADD), ("a.js", "const f = <T>(y: T) => y;\n"), ("twice.js", "function f() {\n  return 1;\n}\nfunction g(a) { return a ? f() : 1; }\n")]
    files = spark.createDataFrame(FILES + more, "file string, text string")
    every, once = C.relation(C.code_facts(files), "functions"), C.functions_by_text(files)
    columns = every.columns[1:]
    want = {tuple(r): r["count"] for r in every.groupBy(*columns).count().select(*columns, "count").collect()}
    got = {tuple(r): r["count"] for r in once.groupBy(*columns).agg(F.sum("files").alias("count")).select(*columns, "count").collect()}
    assert got == want
    assert function_measures(once).collect() == function_measures(every).collect()
    none = spark.createDataFrame([("bad.ts", "function ("), ("none.ts", None)], files.schema)
    assert tuple(function_measures(C.functions_by_text(none)).first()) == (0, 0.0, 0, 0, 0)


def test_measures_take_each_text_of_the_table_once(spark, monkeypatch, tmp_path):
    """Over many tasks, not one process: rows that reach the parser are written down."""
    real, seen = C._reader, tmp_path / "seen"
    seen.mkdir()

    def counting(*a):
        def read(batches):
            def told():
                for batch in batches:
                    (seen / uuid.uuid4().hex).write_text(str(batch.num_rows))
                    yield batch

            yield from real(*a)(told())

        return read

    spark.range(4000).withColumnRenamed("id", "event_id").repartition(5).write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(C, "_reader", counting)
    assert tuple(QUERIES["js_function_measures"](spark, str(tmp_path)).first()) == (1500, 2.666667, 1500, 0, 0)
    assert sum(int(p.read_text()) for p in seen.iterdir()) == 8


def test_texts_that_differ_are_dealt_over_all_tasks(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", spark.sparkContext.defaultParallelism)  # as many as the grouping has, whose small partitions are joined
    try:
        files = spark.range(400).select(F.concat(F.lit("f"), "id", F.lit(".ts")).alias("file"), F.concat(F.lit(ADD + "// "), F.col("id").cast("string")).alias("text"))
        assert C.functions_by_text(files).select(F.spark_partition_id()).distinct().count() == spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
