"""From raw documents to tokens: quality rules, line dedup, near-dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. run() writes what a stage returns
as Parquet in the shared folder and reads it again as the next one's docs.

Rows with a null doc_id count as one document in line dedup and are kept or dropped together in near-dedup; so are
repeated rows of one doc_id. The mix takes repeated rows one by one. Ties between ids don't occur; those of the mix are
settled as in `mix`. Null and empty texts are rejected by the quality rules; a text that line dedup empties is one of the
near copies of all empty texts. Texts of any length are read whole. An empty table passes through as such. Columns beside
doc_id, text, source and n_chars pass through untouched, whatever their names, up to encoding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlint.llm.bitmaps import split_by
from lumenlint.llm.common import NO_ID, materialise, table
from lumenlint.llm.line_dedup import dedup_lines
from lumenlint.llm.mixing import mix
from lumenlint.llm.pieces import encode_pieces
from lumenlint.llm.quality import ledger, passes
from lumenlint.llm.similar import similar_documents


def _free(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have yet."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the policy rejects."""
    into = _free(docs, "ledger")
    return ledger(docs, into=into).filter(passes(F.col(into)["mask"], "full-1")).drop(into)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier document has; n_chars is that of the text that stays."""
    into = _free(docs, "lines")
    text = F.col(into)["text"]
    new = {"text": text, "n_chars": F.char_length(text).cast("long")}
    return dedup_lines(docs, into=into).select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of near copies: SimHash links, and five-word Jaccard of 0.8 or more."""
    known = lambda c: F.coalesce(F.col(c), F.lit(NO_ID)).cast("long")
    gone = similar_documents(docs).filter(known("doc_id") != known("component_id")).select(known("doc_id").alias("gone")).distinct()
    gone = materialise(gone, "near-copies")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), known("doc_id").alias("id"))
    # A filter of the ids that go tells which texts need not move.
    maybe, stay = split_by(rows, gone.select(F.col("gone").alias("id")), "id")
    return maybe.join(gone, F.col("id") == F.col("gone"), "left_anti").unionByName(stay).select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: a row per copy, none if it isn't taken."""
    copies = (F.col("taken") / F.col("size")).cast("int")
    return mix(docs, with_row=True).filter("taken > 0").select("row", F.explode(F.sequence(F.lit(1), copies))).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids, ids_sha256, decoded_sha256 of each row."""
    into = _free(docs, "pieces")
    return encode_pieces(docs, with_text=False, into=into).select("doc_id", "source", *[F.col(into)[c].alias(c) for c in ("n_tokens", "ids", "ids_sha256", "decoded_sha256")])


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("encode", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs


#: SQL has no SentencePiece encoding; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None
