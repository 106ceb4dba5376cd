"""Line dedup with sharded cuckoo filters backed by exact reference-count tables.

A line's key is its text without blanks at both ends and with A-Z lower-cased, as two 64-bit hashes. A key of at least
`min_chars` code points that two documents or more hold loses all its lines but those in the document with the smallest
id. Keys are dealt to shards of about `shard_keys` keys. A shard is one row: a cuckoo filter of its keys and, packed
beside it, the exact table (key, references, first document) that backs the filter.

`dedup_lines` works on a whole table. Counting is map-side combined, so a line in a third of all documents reaches the
shuffle once per task. Lines (ids, positions and hashes, never texts) then meet their shard: both are sorted by shard, a
task holds one shard at a time and streams the lines past it. The filter turns away most lines; what passes is looked up
in the exact table, so its false positives change nothing. A shard with more than 1/512 of all lines (and more than some
hundred thousand) is copied to several places and its lines are dealt among these; there are 512 such shards at most,
whatever the size of the table. Texts move only if their document may lose a line.

`LineIndex` keeps the same shards under insertions and deletions of documents. Only shards that a batch touches are
opened; the filter tells which keys of the batch are new for certain, so only the others are looked up. Deleting lowers
the counts, drops keys that no document holds, and takes these out of the filters: the state is as if the documents had
never been inserted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bitmaps import split_by
from .common import BLANKS, NO_ID, ascii_lower, materialise, table
from .cuckoo import CuckooFilter, Full

SHARD_KEYS = 1 << 14  # keys of a shard, about: half a megabyte
#: A shard's lines are dealt among several places if they are more than 1 / HOT of all, and more than PLACE_LINES.
HOT, PLACE_LINES = 512, 1 << 18
KEY = ["k1", "k2"]
PACKED = ("k1", "k2", "refs", "first")
STATE = "shard int, filter binary, " + ", ".join(f"{c} binary" for c in PACKED)


def _line_keys(text: Column, min_chars: int) -> Column:
    """array<struct<k1,k2>> with an entry per line, null for lines too short to count."""
    lines = F.transform(F.split(ascii_lower(text), "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)))
    return F.transform(lines, lambda x: F.when(F.char_length(x) >= min_chars, F.struct(F.xxhash64(x).alias("k1"), F.xxhash64(F.lit("line"), x).alias("k2"))))


def _keyed(docs: DataFrame, text: str, doc_id: str, min_chars: int) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.coalesce(F.col(doc_id), F.lit(NO_ID)).cast("long").alias("o"), F.xxhash64(t).alias("t"), _line_keys(t, min_chars).alias("lines"))


def _lines(keyed: DataFrame) -> DataFrame:
    """o, t, at, k1, k2: each line that is long enough to count, with its position."""
    return keyed.select("o", "t", F.posexplode("lines").alias("at", "k")).filter("k IS NOT NULL").select("o", "t", "at", "k.k1", "k.k2")


def _postings(keyed: DataFrame) -> DataFrame:
    """o, k1, k2: each key that a document holds, once per document."""
    return _lines(keyed).select("o", *KEY).distinct()


def _shard(shards: int) -> Column:
    return F.pmod("k2", F.lit(shards)).cast("int")


def _shards_for(keys: int, shard_keys: int) -> int:
    n = 1
    while n * shard_keys < keys:
        n *= 2
    return n


class Shard:
    """A filter and the exact table behind it, ordered by key."""

    def __init__(self, filter: CuckooFilter, columns: dict[str, np.ndarray]):
        self.filter, self.columns = filter, columns

    @classmethod
    def of(cls, rows: pd.DataFrame) -> Shard:
        rows = rows.sort_values(KEY)
        return cls(CuckooFilter.of(rows["k1"].to_numpy()), {c: rows[c].to_numpy(np.int64) for c in PACKED})

    @classmethod
    def loads(cls, filter: bytes, *columns: bytes) -> Shard:
        return cls(CuckooFilter.loads(filter), {c: np.frombuffer(b, np.int64) for c, b in zip(PACKED, columns)})

    def row(self, shard: int) -> pd.DataFrame:
        return pd.DataFrame({"shard": [shard], "filter": [self.filter.dumps()], **{c: [self.columns[c].tobytes()] for c in PACKED}})

    def find(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        """Where each key stands in the table, -1 if it doesn't. The filter is asked first, the table about what passes."""
        at = np.full(len(k1), -1, np.int64)
        maybe = np.flatnonzero(self.filter.contains(k1))
        a, b = self.columns["k1"], self.columns["k2"]
        place = np.searchsorted(a, k1[maybe])
        while len(maybe):  # more than one turn only where different keys have one k1
            inside = place < len(a)
            maybe, place = maybe[inside], place[inside]
            same = a[place] == k1[maybe]
            maybe, place = maybe[same], place[same]
            hit = b[place] == k2[maybe]
            at[maybe[hit]] = place[hit]
            maybe, place = maybe[~hit], place[~hit] + 1
        return at


def build_shards(keys: DataFrame, shards: int) -> DataFrame:
    """A row per shard that has keys. keys: k1, k2, refs, first, each key once."""
    rows = keys.select(_shard(shards).alias("shard"), *PACKED)
    return rows.groupBy("shard").applyInPandas(lambda pdf: Shard.of(pdf).row(int(pdf["shard"].iloc[0])), STATE)


def _losing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """o, t, at of lines that go. Rows come by place (a shard, or one copy of it), the shard's own row before its lines."""
    group = shard = None
    for batch in batches:
        own, groups = batch.column("own").is_valid().to_numpy(zero_copy_only=False), batch.column("place").to_numpy()
        line = {c: batch.column(c).fill_null(0).to_numpy() for c in ("o", "t", "at", "n1", "n2")}
        starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]]) if len(groups) else []
        gone = np.zeros(len(groups), bool)
        for lo, hi in zip(starts, [*starts[1:], len(groups)]):
            if groups[lo] != group:
                group, shard = groups[lo], None
            if own[lo]:
                shard = Shard.loads(*batch.column("own")[int(lo)].as_py().values())
                lo += 1
            if shard is not None and lo < hi:
                at = shard.find(line["n1"][lo:hi], line["n2"][lo:hi])
                gone[lo:hi] = (at >= 0) & (shard.columns["first"][at] != line["o"][lo:hi])
        if gone.any():
            yield pa.RecordBatch.from_arrays([pa.array(line[c][gone]) for c in ("o", "t", "at")], ["o", "t", "at"])


def dropped_lines(keyed: DataFrame, repeated: DataFrame, shards: int) -> DataFrame:
    """o, t, drops (positions of lines to drop, in order) for documents that lose lines. repeated: k1, k2, refs, first."""
    spark = keyed.sparkSession
    state = materialise(build_shards(repeated, shards), "line-shards")
    weights = materialise(repeated.groupBy(_shard(shards).alias("shard")).agg(F.sum("refs").alias("n")), "shard-weights")
    total = weights.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    part = max(PLACE_LINES, total // HOT)
    hot = {r["shard"]: min(HOT, -(-r["n"] // part)) for r in weights.filter(F.col("n") > part).collect()}
    copies = spark.createDataFrame(sorted(hot.items()), "hot int, copies int")
    with_copies = lambda df: df.join(F.broadcast(copies), F.col("shard") == F.col("hot"), "left").withColumn("copies", F.coalesce("copies", F.lit(1))).drop("hot")
    place = lambda copy: (F.col("shard").cast("long") * HOT + copy).alias("place")
    lines = with_copies(_lines(keyed).withColumn("shard", _shard(shards))).select(place(F.pmod(F.xxhash64("o", "t", "at"), "copies")), "o", "t", "at", F.col("k1").alias("n1"), F.col("k2").alias("n2"))
    own = with_copies(state).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).select(place(F.col("copy")), F.struct("filter", *PACKED).alias("own"))
    met = lines.unionByName(own, allowMissingColumns=True).repartition("place").sortWithinPartitions("place", F.col("own").isNull())
    return met.mapInArrow(_losing, "o long, t long, at int").groupBy("o", "t").agg(F.array_sort(F.collect_set("at")).alias("drops"))


def _kept(lines: Column, drops: Column) -> Column:
    """lines without those at the positions `drops`, in order: the runs between two of them are copied as they are."""
    begin = lambda i: F.when(i == 0, 0).otherwise(F.get(drops, i - 1) + 1)
    run = lambda i: F.slice(lines, begin(i) + 1, F.coalesce(F.get(drops, i), F.size(lines)) - begin(i))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(drops)), run))


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = 10, shard_keys: int = SHARD_KEYS, into: str = "lines") -> DataFrame:
    """docs with a struct column `into`: text (what stays), n_lines (before dropping), n_dropped.

    Texts are split at \\n only; null and empty texts are one empty line, which is too short to go. Lines that stay are
    joined by \\n; if all go, the text is empty. A line that repeats within one document only stays. Texts of any length
    are read whole; a document's lines are one row of hashes. A null doc_id sorts after all others, and all rows with one
    count as one document, as do repeated rows of one doc_id, whose lines stay or go alike. There are no ties, as ids
    decide. All columns stay, whatever their names, but for one called `into`, which the result replaces. An empty table
    gives an empty result.
    """
    keyed = materialise(_keyed(docs, text, doc_id, min_chars), "line-keys")
    counted = _lines(keyed).groupBy(*KEY).agg(F.count("*").alias("refs"), F.min("o").alias("first"), F.max("o").alias("last"))
    repeated = materialise(counted.filter("first <> last").drop("last"), "line-refs")
    shards = _shards_for(repeated.count(), shard_keys)
    drops = materialise(dropped_lines(keyed, repeated, shards), "line-drops")

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(doc_id), F.lit(NO_ID)).cast("long").alias("o"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    maybe, whole = split_by(rows.withColumn("key", F.xxhash64("o", "t")), drops.select(F.xxhash64("o", "t").alias("key")), "key")
    t = F.coalesce(F.col("row")[text], F.lit(""))
    made = lambda text, n, gone: F.struct(text.alias("text"), n.cast("long").alias("n_lines"), gone.cast("long").alias("n_dropped"))
    # The one element binds the split lines, so that they are made once for all runs.
    cut = F.transform(F.array(F.split(t, "\n", -1)), lambda x: made(F.when(F.col("drops").isNull(), t).otherwise(F.array_join(_kept(x, F.col("drops")), "\n")), F.size(x), F.coalesce(F.size("drops"), F.lit(0))))[0]
    n_lines = F.octet_length(t) - F.octet_length(F.replace(t, F.lit("\n"), F.lit(""))) + 1
    stay = [F.col("row")[c].alias(c) for c in docs.columns if c.lower() != into.lower()]
    found = maybe.join(drops, ["o", "t"], "left").select("row", cut.alias("made")).unionByName(whole.select("row", made(t, n_lines, F.lit(0)).alias("made")))
    return found.select(*stay, F.col("made").alias(into))


class LineIndex:
    """Postings (key, document) and shards in a shared folder, for incremental dedup that can be undone.

    Every change writes new tables and leaves the old ones until the session ends, so readers are never cut off. Shards
    are divided in two, all at once, when they get larger than `shard_keys` on average.
    """

    def __init__(self, spark: SparkSession, min_chars: int = 10, shard_keys: int = SHARD_KEYS, most_parts: int = 16):
        self.spark, self.min_chars, self.shard_keys, self.most_parts = spark, min_chars, shard_keys, most_parts
        self.shards, self.n_keys, self.parts = 1, 0, 0
        self.postings = spark.createDataFrame([], "o long, k1 long, k2 long")
        self.state = spark.createDataFrame([], STATE)

    def refs(self) -> DataFrame:
        """k1, k2, refs, first of every key: the exact tables of all shards."""
        rows = lambda batches: (pd.DataFrame({c: np.concatenate([np.frombuffer(b, np.int64) for b in pdf[c]] or [np.zeros(0, np.int64)]) for c in PACKED}) for pdf in batches)
        return self.state.mapInPandas(rows, "k1 long, k2 long, refs long, first long")

    def _change(self, changes: DataFrame) -> None:
        """changes: k1, k2, refs, first, change: `add` (to what is there), `set` (instead of it) or `drop`; each key once."""
        changes = materialise(changes, "changes")
        needed = _shards_for(self.n_keys + changes.filter("change = 'add'").count(), self.shard_keys)
        if needed > self.shards:
            self.state, self.shards = materialise(build_shards(self.refs(), needed), "shards"), needed

        def merge(old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
            shard = int(new["shard"].iloc[0])
            k1, k2 = new["k1"].to_numpy(np.int64), new["k2"].to_numpy(np.int64)
            change, refs, first = new["change"].to_numpy(), new["refs"].to_numpy(np.int64), new["first"].to_numpy(np.int64)
            if not len(old):
                return Shard.of(new[change != "drop"]).row(shard)
            had = Shard.loads(*old[["filter", *PACKED]].iloc[0])
            at = had.find(k1, k2)
            rows = {c: v.copy() for c, v in had.columns.items()}
            add, put, drop = ((at >= 0) & (change == c) for c in ("add", "set", "drop"))
            rows["refs"][at[add]] += refs[add]
            rows["first"][at[add]] = np.minimum(rows["first"][at[add]], first[add])
            rows["refs"][at[put]], rows["first"][at[put]] = refs[put], first[put]
            stay = np.ones(len(rows["k1"]), bool)
            stay[at[drop]] = False
            fresh = (at < 0) & (change != "drop")
            table = pd.DataFrame({c: np.concatenate([rows[c][stay], {"k1": k1, "k2": k2, "refs": refs, "first": first}[c][fresh]]) for c in PACKED}).sort_values(KEY)
            try:
                had.filter.delete(k1[drop])
                had.filter.insert(k1[fresh])
            except Full:
                return Shard.of(table).row(shard)
            return Shard(had.filter, {c: table[c].to_numpy(np.int64) for c in PACKED}).row(shard)

        new = changes.withColumn("shard", _shard(self.shards))
        touched = new.select("shard").distinct()
        merged = self.state.join(touched, "shard", "left_semi").groupBy("shard").cogroup(new.groupBy("shard")).applyInPandas(merge, STATE)
        self.state = materialise(merged.unionByName(self.state.join(touched, "shard", "left_anti")), "shards")
        self.n_keys = self.state.agg(F.coalesce(F.sum(F.octet_length("k1") / 8), F.lit(0))).first()[0]

    def insert(self, docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> None:
        """Adds documents. Those whose ids the index holds lines of already change nothing."""
        held = self.postings.select("o").distinct()
        added = materialise(_postings(_keyed(docs, text, doc_id, self.min_chars)).join(held, "o", "left_anti"), "added")
        self._change(added.groupBy(*KEY).agg(F.count("*").alias("refs"), F.min("o").alias("first")).withColumn("change", F.lit("add")))
        self.postings, self.parts = self.postings.unionByName(added), self.parts + 1
        if self.parts > self.most_parts:
            self.postings, self.parts = materialise(self.postings, "postings"), 1

    def delete(self, ids: DataFrame, doc_id: str = "doc_id") -> None:
        """Takes documents out by id; ids the index does not hold change nothing."""
        ids = ids.select(F.coalesce(F.col(doc_id), F.lit(NO_ID)).alias("o")).distinct()
        touched = materialise(self.postings.join(ids, "o", "left_semi").select(*KEY).distinct(), "touched")
        left = materialise(self.postings.join(ids, "o", "left_anti"), "postings")
        again = left.join(touched, KEY, "left_semi").groupBy(*KEY).agg(F.count("*").alias("refs"), F.min("o").alias("first"))
        found = touched.join(again, KEY, "left").select(*KEY, F.coalesce("refs", F.lit(0)).alias("refs"), F.coalesce("first", F.lit(0)).alias("first"), F.when(F.col("refs").isNull(), "drop").otherwise("set").alias("change"))
        self._change(found)
        self.postings, self.parts = left, 1

    def drops(self, docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
        """o, t, drops: the positions of the lines that the index's documents lose now."""
        repeated = materialise(self.refs().filter("refs > 1"), "repeated")
        return dropped_lines(_keyed(docs, text, doc_id, self.min_chars), repeated, self.shards)


def op2_line_dedup(spark, sf_dir):
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "lines.n_lines", "lines.n_dropped", F.sha2(F.col("lines.text").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op2_line_dedup": op2_line_dedup}
SQL = {
    "op2_line_dedup": r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
d AS (SELECT k.doc_id, k.i, k.line, r.key IS NOT NULL AND k.doc_id <> r.first AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM d GROUP BY doc_id"""
}
