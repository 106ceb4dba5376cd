"""Facts of source files as relations: one pass of the parser per file, all relations out of its table.

Files are dealt evenly by a hash of their path before parsing, so that a folder of large files isn't one task. A process
parses a text that comes again once, as long as it keeps it; every file gets its rows either way. What only counts files
takes each distinct text once in the whole job, with the number of files that hold it.
"""

from __future__ import annotations

import posixpath
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import RULES, look_up
from ..functions.state import materialise
from ..javascript.rules import facts
from .duplication import WIDTH

#: relation: its columns, in the parser's order.
SHAPES = {
    "findings": "rule_id string, severity string, confidence string, line int, col int, evidence string",
    "functions": "name string, line int, lines int, params int, cyclomatic int, cognitive int, nesting int",
    "edges": "target string, kind string, names string, type_only boolean, line int, path string",
    "exports": "name string, line int",
    "declared": "old int, new int",
    "flows": "what string, fn string, line int, col int, rule_id string, origin string, leading boolean, clean string, source string, callee string, arg int, evidence string, path string",
    "failed": "reason string",
}
WINDOWS = {"windows": "start int, line int, last int, hash string"}
KEPT = 1 << 20  # characters of texts; their facts take some tens of MB


def _schema(shapes: dict[str, str], first: str = "file string") -> str:
    return f"{first}, " + ", ".join(f"{k} array<struct<{', '.join(c.replace(' ', ': ') for c in v.split(', '))}>>" for k, v in shapes.items())


def relative(file: str, target: str) -> str | None:
    """The path, without a suffix, that a relative import names; null for packages and for what lies above the root."""
    if not target.startswith("."):
        return None
    path = posixpath.normpath(posixpath.join(posixpath.dirname(file), target))
    return None if path.startswith("..") else "" if path == "." else path


class Kept:
    """of(file, text), which may read nothing of the path but its suffix. What it returned stays until newer texts fill KEPT characters."""

    def __init__(self, of: Callable[[str, str], Any]):
        self.of, self.kept, self.size = of, {}, 0

    def __call__(self, file: str, text: str) -> Any:
        key = file[file.rfind(".") :] if "." in file else f"/{file}", text
        got = self.kept.pop(key, None)
        if got is None:
            got = self.of(file, text)
            self.size += len(text) + 64
        self.kept[key] = got
        while self.size > KEPT:
            _, old = next(iter(self.kept))
            del self.kept[next(iter(self.kept))]
            self.size -= len(old) + 64
        return got


def _per_file(batches: Iterator[pa.RecordBatch], read: Callable[[str, str], dict[str, list[dict]]], shapes: dict[str, str]) -> Iterator[pa.RecordBatch]:
    """The columns but text, and an array of structs for each shape. Equal rows are made once for a batch of up to KEPT characters of text."""
    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
    made = pa.schema([(k, pa.list_(pa.struct([(n, kinds[kind]) for n, kind in (c.split(" ") for c in v.split(", "))]))) for k, v in shapes.items()])
    for batch in batches:
        files, texts = batch.column("file").to_pylist(), batch.column("text").to_pylist()
        head = batch.drop_columns(["text"])
        at = 0
        while at < len(files):
            first, which, size, rows = at, [], 0, {}
            while at < len(files) and size < KEPT and at - first < 4096:
                row = read(files[at], texts[at] or "")
                which.append(rows.setdefault(id(row), (len(rows), row))[0])
                size += len(texts[at] or "")
                at += 1
            once = pa.RecordBatch.from_pylist([row for _, row in rows.values()], made)
            yield pa.RecordBatch.from_arrays([*head.slice(first, at - first).columns, *once.take(pa.array(which, pa.int32())).columns], schema=pa.schema([*head.schema, *made]))


def _reader(limits: dict[str, int] | None, shapes: dict[str, str] = SHAPES):
    names = {k: [c.split(" ")[0] for c in v.split(", ")] for k, v in shapes.items()}

    def parsed(file: str, text: str) -> dict:
        got = facts(file, text, limits)
        return {"got": got, "local": any(x.startswith(".") for x in [*(e[0] for e in got["edges"]), *(f[8] for f in got["flows"])]), "row": None}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = Kept(parsed)

        def row(file: str, text: str) -> dict[str, list[dict]]:
            one = kept(file, text)
            where = posixpath.dirname(file) if one["local"] else ""  # relative imports lead elsewhere from another folder
            if one["row"] is None or one["row"][0] != where:
                got = one["got"] | {"edges": [(*e, relative(file, e[0])) for e in one["got"]["edges"]], "flows": [(*f, relative(file, f[8])) for f in one["got"]["flows"]]}
                one["row"] = where, {k: [dict(zip(names[k], r)) for r in got[k]] for k in shapes}
            return one["row"][1]

        yield from _per_file(batches, row, shapes)

    return read


def _dealt(files: DataFrame, by: str | Column) -> DataFrame:
    """Files, by a hash of this column, over as many tasks as the session shuffles to. Parsing is slow for its bytes, so small partitions aren't joined."""
    spark = files.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return files.repartition(parts, by)


def code_facts(files: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """file and an array of structs for each relation of SHAPES, in the shared folder. files: file, text; null texts are empty."""
    return materialise(_dealt(files.select("file", "text"), "file").mapInArrow(_reader(limits), _schema(SHAPES)), "code-facts")


def functions_by_text(files: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """files and the columns of the relation functions: each distinct text is parsed once, files says how many files hold it.

    Files are counted by their text before texts are dealt, so neither rows per file nor the other relations leave the JVM or are written.
    """
    read = F.when(F.contains("file", F.lit(".")), F.concat(F.lit("."), F.substring_index("file", ".", -1))).otherwise(F.col("file"))  # all that the parser takes of a path
    texts = files.select(read.alias("file"), F.coalesce("text", F.lit("")).alias("text")).groupBy("file", "text").agg(F.count("*").alias("files"))
    shapes = {"functions": SHAPES["functions"]}
    dealt = _dealt(texts, F.xxhash64("file", "text"))  # not by the grouping's own columns: its partitions would stay, and small ones be joined
    made = dealt.mapInArrow(_reader(limits, shapes), _schema(shapes, "file string, files long"))
    return made.select("files", F.explode("functions").alias("r")).select("files", "r.*")


def relation(read: DataFrame, name: str) -> DataFrame:
    """file and the columns of one relation."""
    return read.select("file", F.explode(name).alias("r")).select("file", "r.*")


def category(rule: Column) -> Column:
    return look_up(rule, {r: v[0] for r, v in RULES.items()}, "other")


def findings(read: DataFrame) -> DataFrame:
    """rule_id, category, severity, confidence, file, line, col, evidence."""
    f = relation(read, "findings")
    return f.select("rule_id", category(F.col("rule_id")).alias("category"), "severity", "confidence", "file", "line", "col", "evidence")


def without_legacy(found: DataFrame, variables: int, old: int, least: int = 25, share: float = 0.9) -> DataFrame:
    """found without JS001 where nearly all declarations are of the old kind: that's a style, not an issue."""
    return found.filter("rule_id <> 'JS001'") if old >= least and old >= share * variables else found


def renamed(tokens: list[str]) -> list[str]:
    """Identifiers (marked by a leading 0) numbered by their first place, so that renaming changes nothing."""
    seen: dict[str, str] = {}
    return [seen.setdefault(t, f"0{len(seen)}") if t[0] == "0" else t for t in tokens]


def _cutter(width: int, step: int):
    names = [c.split(" ")[0] for c in WINDOWS["windows"].split(", ")]

    def windows(path: str, text: str) -> dict[str, list[dict]]:
        import hashlib

        from ..javascript.parser import ParseError
        from ..javascript.rules import File

        try:
            tokens = File(path, text).code_tokens()
        except (ParseError, RecursionError):
            return {"windows": []}
        rows = []
        for at in range(0, len(tokens) - width + 1, step):
            some = [t for t, _ in tokens[at : at + width]]
            data = sum(t[1:2] in "\"'`0123456789" and t[0] == "1" for t in some)
            logic = sum(t[0] == "1" and (t[1:2].isalpha() or t[1:] in ("(", "=", "=>", "&&", "||", "?", "+", "-", "*", "/", "<", ">", "===", "!==")) for t in some)
            if data < 0.3 * width and logic >= 0.1 * width:
                rows.append((at, tokens[at][1], tokens[at + width - 1][1], hashlib.sha1(" ".join(renamed(some)).encode("utf-8", "surrogatepass")).hexdigest()))
        return {"windows": [dict(zip(names, r)) for r in rows]}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _per_file(batches, Kept(windows), WINDOWS)

    return cut


def _windows(files: DataFrame, width: int, step: int) -> DataFrame:
    return _dealt(files.select("file", "text"), "file").mapInArrow(_cutter(width, step), _schema(WINDOWS))


def code_windows(files: DataFrame, width: int = WIDTH, step: int = 5) -> DataFrame:
    """file, start, line, last, hash of every step-th window of tokens, with identifiers numbered within the window.

    Windows that hold data rather than logic (30 % literals or more, or hardly a word of the language) are left out.
    """
    return relation(_windows(files, width, step), "windows")


def code_copies(files: DataFrame, width: int = WIDTH, step: int = 5) -> DataFrame:
    """hash, copies: in how many files each hash of code_windows occurs.

    Each distinct text is cut once, and files are counted by their text (128 bits of its hash), so that no row per file and
    window shuffles. A file that comes with several texts counts once for what these share.
    """
    suffix = F.concat(F.lit("."), F.substring_index("file", ".", -1))  # all that the parser takes of a path
    named = files.select("file", suffix.alias("suffix"), F.coalesce("text", F.lit("")).alias("text"))
    key = F.concat(F.hex(F.xxhash64("suffix", "text")), F.hex(F.xxhash64(F.lit(1), "suffix", "text")), "suffix")
    sets = named.select("file", key.alias("key")).groupBy("file").agg(F.array_sort(F.collect_set("key")).alias("keys")).groupBy("keys").agg(F.count("*").alias("files"))
    sets = materialise(sets, "files-by-text")
    cut = _windows(named.select("suffix", "text").distinct().select(key.alias("file"), "text"), width, step)
    cut = materialise(cut.select(F.col("file").alias("key"), F.explode(F.array_distinct("windows.hash")).alias("hash")), "windows-by-text")
    one = sets.filter("size(keys) = 1").select(F.col("keys")[0].alias("key"), "files").join(cut, "key").select("hash", "files")
    more = sets.filter("size(keys) > 1").select("keys", "files", F.explode("keys").alias("key")).join(cut, "key").select("keys", "files", "hash").distinct().select("hash", "files")
    return one.unionByName(more).groupBy("hash").agg(F.sum("files").alias("copies"))
