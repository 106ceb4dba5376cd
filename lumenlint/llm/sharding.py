"""Sharding by balanced label propagation.

Documents are linked through hubs: what several documents share, such as an equal text. Linked documents start in shards
by a hash, but for those of large hubs, which start together where there is room. In each round a hub names the shard that holds most of its documents (shards with room first), and documents ask to move to the shard
most of their hubs name. Quotas let only so many in: a shard accepts as many as it sends away, plus its room below the
capacity; who is let in is decided by a hash of the hub, so that its documents move together. A hub larger than a shard
is split by a hash into parts that fit. Rounds are Spark joins over (document, hub) links, and state is a table per round
in the shared folder. `cut_edges` counts the links that end in another shard than their hub.

At last the shards are made exactly even (`rows`: counts at most one apart): each keeps its linked documents up to its
share, and all others (without links, or beyond the share) fill what is left. Ranks need no global sort: rows are counted
per cell, where a cell is a range of hub hashes, and a hub with more than `CELL_ROWS` documents has cells of its own by
ranges of doc_id hashes. Only cells are sorted inside. Nodes and ranks depend on contents alone, not on files or tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import NO_ID, materialise, table

CELL_ROWS = 4096  # documents of a cell, about
LARGE = 20
POOLS = 64  # parts in which the documents that fill up are ranked


def _u(*parts: Column) -> Column:
    """Evenly in [0, 1) by a hash."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 40)).cast("double") / float(1 << 40)


def hash_labels(nodes: DataFrame, shards: int) -> DataFrame:
    return nodes.select("node", F.pmod(F.xxhash64(F.lit("shard"), "node"), F.lit(shards)).cast("int").alias("shard"))


def cut_edges(assigned: DataFrame, links: DataFrame) -> int:
    """Documents linked to a hub that has more documents in another shard. assigned: node, shard; links: node, hub, n (documents)."""
    votes = links.join(assigned, "node").groupBy("hub", "shard").agg(F.sum("n").alias("n"))
    sums = votes.groupBy("hub").agg(F.max("n").alias("most"), F.sum("n").alias("n"))
    return sums.agg(F.coalesce(F.sum(F.col("n") - F.col("most")), F.lit(0))).first()[0]


def _fitting(links: DataFrame, capacity: float) -> DataFrame:
    """links with hubs larger than the capacity split into parts by a hash of the node."""
    large = links.groupBy("hub").agg(F.sum("n").alias("size")).filter(F.col("size") > capacity)
    parts = materialise(large.select(F.col("hub").alias("whole"), F.ceil(F.col("size") / capacity).alias("parts")), "large-hubs")
    part = F.xxhash64("hub", F.floor(_u(F.lit("part"), F.col("node")) * F.col("parts")))
    return links.join(F.broadcast(parts), F.col("hub") == F.col("whole"), "left").select("node", F.when(F.col("parts").isNull(), F.col("hub")).otherwise(part).alias("hub"), "n")


def _first(links: DataFrame, shards: int, capacity: float) -> DataFrame:
    """node, n, shard to begin with: hubs of more than 1 / LARGE of a shard go, largest first, to the emptiest shard; others by a hash.

    There are LARGE x shards such hubs at most (for each hub a document is in), as their sizes add up to no more than all shards.
    """
    large = links.groupBy("hub").agg(F.sum("n").alias("size")).filter(F.col("size") * LARGE > capacity).collect()
    room, seats = [capacity] * shards, []
    for r in sorted(large, key=lambda r: (-r["size"], r["hub"])):
        s = max(range(shards), key=lambda s: (room[s], -s))
        room[s] -= r["size"]
        seats.append((r["hub"], s))
    seats = links.sparkSession.createDataFrame(seats, "large long, seat int")
    room = [max(0.0, x) for x in room]
    upto = [sum(room[: s + 1]) / max(sum(room), 1e-9) for s in range(shards - 1)]
    u = _u(F.lit("shard"), F.col("node"))
    other = F.size(F.filter(F.array(*[F.lit(b) for b in upto], F.lit(2.0)), lambda b: b <= u))
    nodes = links.join(F.broadcast(seats), F.col("hub") == F.col("large"), "left").groupBy("node").agg(F.max("n").alias("n"), F.min("seat").alias("seat"))
    return nodes.select("node", "n", F.coalesce("seat", other).cast("int").alias("shard"))


def propagate(links: DataFrame, shards: int, capacity: float, max_rounds: int = 4, slack: float = 0.05, stop_below: float = 0.001) -> DataFrame:
    """node, shard of every linked node after label propagation under quotas. links: node, hub, n (documents of the node in the hub).

    Counts per (hub, shard) are map-side combined, so a hub with very many documents is gathered as a few counts. A round
    in which less than `stop_below` of the documents move is the last. A shard may get `slack` more than its capacity,
    without which full shards could let nobody in; even_shards takes that off again.
    """
    links = materialise(_fitting(links, capacity), "links")
    now = materialise(_first(links, shards, capacity), "shards")
    for turn in range(max_rounds):
        sizes = {r["shard"]: r["n"] for r in now.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        room = F.col("shard").isin([s for s in range(shards) if sizes.get(s, 0) < capacity * (1 + slack / 2)])
        votes = links.join(now.select("node", "shard"), "node").groupBy("hub", "shard").agg(F.sum("n").alias("n"))
        # Shards with room come first. Ties fall to each hub's own order of shards, so that hubs don't all ask for one.
        named = materialise(votes.groupBy("hub").agg(F.max_by("shard", F.struct(room, "n", F.xxhash64("hub", "shard"))).alias("to")), "named")
        asked = links.join(named, "hub").groupBy("node", "to").agg(F.sum("n").alias("votes"), F.min("hub").alias("hub"))
        asked = asked.groupBy("node").agg(F.max_by(F.struct("to", "hub"), F.struct("votes", F.xxhash64("node", "to"))).alias("most"))
        wish = asked.join(now, "node").filter("most.to <> shard").select("node", "n", "shard", F.col("most.to").alias("to"), _u(F.lit(turn), F.col("most.hub")).alias("u"))
        wish = materialise(wish, "wish")
        # shards x shards counts at most: where each shard's room comes from is settled on these alone.
        flows = {(r["shard"], r["to"]): r["n"] for r in wish.groupBy("shard", "to").agg(F.sum("n").alias("n")).collect()}
        out = {s: sum(n for (a, _), n in flows.items() if a == s) for s in range(shards)}
        into = {s: sum(n for (_, b), n in flows.items() if b == s) for s in range(shards)}
        quota = {s: max(0.0, min(1.0, (0.9 * out[s] + capacity * (1 + slack) - sizes.get(s, 0)) / into[s])) if into[s] else 0.0 for s in range(shards)}
        moves = wish.filter(F.col("u") < F.element_at(F.array(*[F.lit(quota[s]) for s in range(shards)]), F.col("to") + 1)).select("node", "to", F.col("n").alias("moved"))
        moves = materialise(moves, "moves")
        moved = moves.agg(F.coalesce(F.sum("moved"), F.lit(0))).first()[0]
        if not moved:
            break
        now = materialise(now.join(moves, "node", "left").select("node", "n", F.coalesce("to", "shard").alias("shard")), "shards")
        if moved < stop_below * sum(sizes.values()):
            break
    return now.select("node", "shard")


def _ranked(rows: DataFrame, labels: int) -> tuple[DataFrame, list[int]]:
    """rows (label, hub, key and others) with `rank`, from 0 within each label, in the order of hub hashes and keys; and the labels' sizes."""
    large = materialise(rows.groupBy("hub").agg(F.count("*").alias("held")).filter(F.col("held") > CELL_ROWS).withColumnRenamed("hub", "large"), "large")
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    cells = max(1, sum(sizes.values()) // (CELL_ROWS * labels))
    of_its_own = F.col("large").isNotNull()
    cell = {"c0": F.floor(_u(F.lit("hub"), F.col("hub")) * cells), "c1": F.col("large"), "c2": F.when(of_its_own, F.floor(_u(F.lit("key"), F.col("key")) * F.ceil(F.col("held") / CELL_ROWS))).otherwise(0)}
    rows = materialise(rows.join(large, F.col("hub") == F.col("large"), "left").withColumns(cell).drop("large", "held"), "cells")
    order = W.partitionBy("label").orderBy("c0", F.col("c1").asc_nulls_first(), "c2").rowsBetween(W.unboundedPreceding, -1)
    counts = rows.groupBy("label", *cell).agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)))
    counts = materialise(counts.select(F.col("label").alias("in_label"), *[F.col(c).alias("in_" + c) for c in cell], "before"), "offsets")
    on = (F.col("label") == F.col("in_label")) & (F.col("c0") == F.col("in_c0")) & F.col("c1").eqNullSafe(F.col("in_c1")) & (F.col("c2") == F.col("in_c2"))
    rank = F.col("before") + F.row_number().over(W.partitionBy("label", *cell).orderBy("hub", "key")) - 1
    ranked = rows.join(counts, on).withColumn("rank", rank.cast("long")).drop(*cell, *counts.columns)
    return ranked, [sizes.get(i, 0) for i in range(labels)]


def _at(values: list[int], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), index + 1)


def even_shards(placed: DataFrame, shards: int) -> DataFrame:
    """placed (shard, null if any will do; hub, key and others) with final shard and slot: counts at most one apart."""
    linked, held = _ranked(placed.filter("shard IS NOT NULL").withColumnRenamed("shard", "label"), shards)
    linked = materialise(linked, "linked")
    n = sum(held) + placed.filter("shard IS NULL").count()
    share = [n // shards + (s < n % shards) for s in range(shards)]
    stay = [min(a, b) for a, b in zip(held, share)]
    kept = linked.filter(F.col("rank") < _at(stay, F.col("label")))
    more = linked.filter(F.col("rank") >= _at(stay, F.col("label"))).drop("label", "rank").unionByName(placed.filter("shard IS NULL").drop("shard"))
    # The others fill shard after shard. They are ranked in POOLS parts, each of which begins where the one before ends.
    pool, sizes = _ranked(more.withColumn("label", F.floor(_u(F.lit("pool"), F.col("hub")) * POOLS).cast("int")), POOLS)
    starts = [sum(sizes[:i]) for i in range(POOLS)]
    begins = [sum(share[:s]) - sum(stay[:s]) for s in range(shards)]
    pool = pool.withColumn("rank", F.col("rank") + _at(starts, F.col("label"))).drop("label")
    shard = F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in begins]), lambda b: b <= F.col("rank"))) - 1
    pool = pool.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("rank") - _at(begins, F.col("shard")) + _at(stay, F.col("shard"))).drop("rank")
    return kept.withColumnRenamed("label", "shard").withColumnRenamed("rank", "slot").unionByName(pool)


def by_text(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, size, text_crc32, hub, key, node) and links (node, hub, n) of documents with equal texts."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(t) + 8).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), F.xxhash64(t).alias("hub"))
    rows = rows.withColumn("key", F.coalesce(F.col("doc_id"), F.lit(NO_ID)).cast("long"))
    rows = materialise(rows.withColumn("node", F.xxhash64("key", "hub")), "documents")
    nodes = rows.groupBy("node", "hub").agg(F.count("*").alias("n"))
    shared = nodes.groupBy("hub").agg(F.sum("n").alias("all")).filter("all > 1").select("hub")
    return rows, materialise(nodes.join(shared, "hub").select("node", "hub", "n"), "links")


def shard(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shards: int = 24, max_rounds: int = 4) -> DataFrame:
    """One row per row of docs: doc_id, size (UTF-8 bytes of the text plus 8), text_crc32, shard, slot (from 0 in its shard).

    Rows with equal texts (nulls count as empty) are linked. Every shard has as many rows as any other, or one more.
    Texts are hashed whole, whatever their length. Ties between shards fall by hashes of contents, so the result does not
    depend on how the table lies in files. Null doc_ids rank last; repeated rows are one node and placed next to each
    other. Other columns are not read, whatever their names. An empty table gives an empty result.
    """
    rows, links = by_text(docs, text, doc_id)
    labels = propagate(links, shards, max(1.0, rows.count() / shards), max_rounds)
    placed = materialise(rows.join(labels, "node", "left").drop("node"), "placed")
    return even_shards(placed, shards).select("doc_id", "size", "text_crc32", "shard", "slot")


def op7_sharding(spark, sf_dir):
    out = shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op7_sharding": op7_sharding}
SQL: dict[str, str] = {}
