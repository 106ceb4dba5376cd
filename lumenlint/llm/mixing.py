"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Each source gets a share of all words by its weight, at most `max_epochs` times its own words; what a source can't take
is shared anew by weight (water-filling, in closed form). A source's budget is met by complete epochs first. The rest is
a sample without replacement: a document's key is -ln(u) / quality with u drawn from a hash of its id, documents are
taken in the order of their keys until the prefix sum of sizes meets the budget.

The prefix sums need no global sort. Keys are mapped monotonically to (0, 1) and cut into `cells` per source, so many
that a cell holds about `cell_rows` rows. Sizes are summed per cell with partial aggregation, cells are prefix-summed,
and only the one cell per source in which the budget ends is sorted by key. A hot source just has more cells. The result
is the same as that of sorting each source whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, n_words, table


def _keys(docs: DataFrame, text: str, doc_id: str, source: str, seed: str, with_row: bool = False) -> DataFrame:
    """doc_id, source, size, u, key. quality: the share of a text's characters that are letters, digits or blanks, 0.1 at least."""
    t = F.coalesce(F.col(text), F.lit(""))
    noise = F.char_length(t) - F.char_length(F.translate(t, "#*$%&|<>!", ""))
    name = F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("null:"), t))
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), name)), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    quality = F.greatest(F.lit(0.1), 1.0 - noise.cast("double") / F.greatest(F.char_length(t), F.lit(1)))
    own = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if with_row else [])])
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), u.alias("u"), quality.alias("quality"), *([own.alias("row")] if with_row else []))


def _targets(sizes: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """source, rows, source_size, target. sizes has a row per source; it is small, so one task may order it."""
    ordered = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1).cast("int")).cast("double"))
    ordered = ordered.withColumn("cap", F.col("source_size") * float(max_epochs)).withColumn("ratio", F.col("cap") / F.col("weight"))
    by = W.orderBy("ratio", F.col("source").asc_nulls_last())
    before, every = by.rowsBetween(W.unboundedPreceding, -1), W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    # The level at which this source and all with a larger ratio share what the ones before it leave.
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(by.rowsBetween(0, W.unboundedFollowing))
    ordered = ordered.withColumn("level", level)
    # Capped sources are the first in order; the first that isn't capped has the level of all that follow.
    found = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", F.col("source").isNull().alias("n"), "source", "level"))).over(every)["level"]
    return ordered.select("source", "rows", "source_size", F.coalesce(F.least(F.col("cap"), F.col("weight") * found), F.col("cap")).alias("target"))


def mix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: str = "mix", cell_rows: int = 4096, with_row: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken, source; with_row: and a struct `row` of its columns.

    size: words of the text (null: 0). Sources are ordered by code point, null last and a source of its own; they weigh
    `weights`, repeating. taken: words the mix takes of this row, a multiple of its size up to max_epochs times. The last
    last document taken may overshoot: it is taken if that brings the source nearer to its target. Ties of the key fall
    to the smaller id, then the smaller size. Rows with a null id draw by their text. Repeated rows draw the same key and
    count one by one, so only some of them may be taken. Texts are read whole, whatever their length. A table without
    words gives taken 0 everywhere; an empty table an empty result. Other columns are not read, whatever their names.

    with_row decides each row where its text is: texts are read again and not joined; only those of the cells in which
    budgets end move.
    """
    keyed = materialise(_keys(docs, text, doc_id, source, seed), "keyed")
    targets = _targets(keyed.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")), weights, max_epochs)
    whole = F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)))
    targets = materialise(targets.withColumn("epochs", F.least(whole, F.lit(max_epochs)).cast("long")).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "targets")
    # Qualities are within 0.1 and 1, and most are near 1: u is the key's rank but for those, and exp(-key) keeps cells even.
    cells = F.ceil(F.col("rows") / cell_rows)
    row = ["row"] if with_row else []

    def in_cells(rows: DataFrame, more: list[str]) -> DataFrame:
        key, cell = -F.log("u") / F.col("quality"), F.least(F.floor((1.0 - F.exp(F.log("u") / F.col("quality"))) * cells), cells - 1).cast("long")
        return rows.join(targets, rows["source"].eqNullSafe(targets["source"])).select("doc_id", rows["source"].alias("source"), "size", "source_size", "target", "epochs", "rest", key.alias("key"), cell.alias("cell"), *more)

    sums = in_cells(keyed, []).groupBy("source", "cell").agg(F.sum("size").alias("in_cell"), F.max("rest").alias("cell_rest"))
    before = F.coalesce(F.sum("in_cell").over(W.partitionBy("source").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    edge = sums.withColumn("before", before).filter("before < cell_rest").groupBy("source").agg(F.max_by(F.struct("cell", "before"), "cell").alias("edge"))
    edge = materialise(edge, "edge")
    full = in_cells(_keys(docs, text, doc_id, source, seed, True) if with_row else keyed, row)
    placed = full.join(edge.select(F.col("source").alias("edge_source"), "edge"), F.col("source").eqNullSafe(F.col("edge_source")), "left").drop("edge_source")
    take = F.col("epochs") * F.col("size")
    out = lambda df, more: df.select("doc_id", "size", "source_size", "target", (take + more).cast("long").alias("taken"), "source", *row)
    sorted_cell = F.col("cell") == F.col("edge.cell")
    apart = out(placed.filter(F.coalesce(~sorted_cell, F.lit(True))), F.when(F.col("cell") < F.col("edge.cell"), F.col("size")).otherwise(0))
    upto = F.coalesce(F.sum("size").over(W.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + F.col("edge.before")
    at_edge = out(placed.filter(sorted_cell).withColumn("upto", upto), F.when(F.col("upto") + F.col("size") / 2.0 <= F.col("rest"), F.col("size")).otherwise(0))
    return apart.unionByName(at_edge)


def op8_mix_sources(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).drop("source")


QUERIES = {"op8_mix_sources": op8_mix_sources}
SQL = {
    "op8_mix_sources": r"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS x, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
k AS (SELECT doc_id, source, size, -ln((('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null:' || x)), 1, 12))::BIGINT + 0.5) / 281474976710656.0)
      / greatest(0.1, 1.0 - (length(x) - length(translate(x, '#*$%&|<>!', '')))::DOUBLE / greatest(length(x), 1)) AS key FROM t),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, source_size * 3.0::DOUBLE AS cap FROM s),
l AS (SELECT *, cap / weight AS ratio, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
      / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT level FROM l WHERE level <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1),
g AS (SELECT source, source_size, coalesce(least(cap, weight * (SELECT level FROM f)), cap) AS target FROM l),
e AS (SELECT *, least(floor(target / greatest(source_size, 1)), 3)::BIGINT AS epochs FROM g),
p AS (SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
      coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto
      FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (epochs * size + CASE WHEN upto + size / 2.0 <= rest THEN size ELSE 0 END)::BIGINT AS taken FROM p"""
}
