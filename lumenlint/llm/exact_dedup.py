"""Exact dedup by two-pass Bloom filtering, in DataFrame operations only.

Pass 1 hashes each normalised text to `probes` slots and finds the slots that two rows or more hit; these are kept as
bitmaps. Pass 2 looks every row up: a row with a slot that was hit once has no equal and passes straight through. Only
the others shuffle by their full hash, which makes the result exact whatever the filter says.

The bitmaps are broadcast, and their size has a fixed bound: `max_bits` / 8 bytes (16 MB by default). With far more rows
than bits, more rows are possibly repeated and shuffle (40 bytes each, never the text); results stay the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitmaps import MAX_BITS, bits_for, pages, slots, with_maybe
from .common import ascii_lower, materialise, table

def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", probes: int = 2, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical after lower-casing A-Z; null counts as empty. Of equal texts the row with the largest
    doc_id stays (a null doc_id is smaller than any other); of repeated rows with that doc_id, one stays. Other columns
    are not read, whatever their names. An empty table gives an empty result.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.sha2(ascii_lower(F.coalesce(F.col(text), F.lit(""))).cast("binary"), 256).alias("text_sha256"))
    rows = materialise(rows.withColumn("row_id", F.monotonically_increasing_id()), "hashes")
    bits = bits_for(rows.count(), max_bits)
    hit = rows.select(F.explode(F.array(*slots("text_sha256", bits, probes))).alias("slot")).groupBy("slot").agg(F.count("*").alias("n")).filter("n > 1")
    probed = with_maybe(rows, pages(hit), "text_sha256", bits, probes)

    alone = probed.filter(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    again = materialise(probed.filter("maybe").drop("maybe"), "maybe")
    groups = materialise(again.groupBy("text_sha256").agg(F.max(F.struct("doc_id", "row_id")).alias("keep"), F.count("*").alias("group_size")), "groups")
    shared = again.join(groups, "text_sha256").select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("row_id") == F.col("keep.row_id")).alias("kept"), "text_sha256")
    return alone.unionByName(shared)


def op9_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


QUERIES = {"op9_exact_dedup": op9_exact_dedup}
SQL = {
    "op9_exact_dedup": """
WITH h AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM h WINDOW w AS (PARTITION BY text_sha256)"""
}
