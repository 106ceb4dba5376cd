"""SimHash near-dedup with BK-trees.

A text's fingerprint is the bitwise majority of the XXH64 hashes of its word shingles. Two fingerprints link if at most
`radius` bits differ; a document's component is everything reachable.

Fingerprints are cut into blocks of bits. With `radius + c` blocks, two that link agree on at least c blocks, so each
distinct fingerprint goes to one shard per choice of c blocks, and every linked pair meets in one of these. c grows with
the number of fingerprints (known before), which keeps shards small. A shard whose fingerprints still are many (a crowd
of near copies) is dealt anew by the bits that are left, in the same exact way, so no task gets a whole crowd.

Each shard holds a BK-tree: a node's children are keyed by their integer Hamming distance to it, and a search follows
only edges whose key is within the radius of the query's distance to the node. All trees of a partition are built and
searched level by level on arrays. What a shard finds leaves it as a star per local component, not as all its pairs;
stars are joined to components by large-star and small-star rounds.

The trees are built where their shard is. They aren't broadcast from the driver, as it must not collect the fingerprints
of all documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, NO_ID, UPPER, WORD, materialise, spread, table

_WORD = re.compile(WORD)
_ASCII_LOWER = str.maketrans(UPPER, LOWER)
SHARD_FINGERPRINTS = 64  # fingerprints of a shard that the blocks are chosen for
CROWD = 2048  # fingerprints of a shard from which it is dealt anew
PAIRS = 1 << 20  # (query, node) visits held in memory at once


def shingle_hashes(text: str | None, width: int = 4, seed: int = 42) -> np.ndarray:
    """XXH64 of each word shingle of a whole text, in order; empty without words."""
    words = _WORD.findall((text or "").translate(_ASCII_LOWER) if not (text or "").isascii() else (text or "").lower())
    if not words:
        return np.zeros(0, np.uint64)
    data = " ".join(words).encode("utf-8", "surrogatepass")
    n = max(1, len(words) - width + 1)
    gaps = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)  # words hold no blanks, so each gap parts two words
    starts = [0, *(gaps + 1).tolist()][:n]
    ends = [*gaps.tolist(), len(data)][-n:]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(data[a:b], seed) for a, b in zip(starts, ends)), np.uint64, n)


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """Unsigned 64-bit fingerprint of a whole text; 0 without words."""
    hashes = shingle_hashes(text, width, seed)
    n, votes = len(hashes), np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):  # bounded memory for very long texts
        votes += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))


class Trees:
    """BK-trees of many shards at once. Items must be sorted by shard; each shard's first item is its root."""

    def __init__(self, shard: np.ndarray, items: np.ndarray):
        n = len(items)
        items = np.ascontiguousarray(items).view(np.uint64)  # bitwise_count takes the absolute value of signed numbers
        self.items, self.parent, self.key = items, np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        starts = np.r_[True, shard[1:] != shard[:-1]] if n else np.zeros(0, bool)
        self.root_of = np.flatnonzero(starts)[np.cumsum(starts) - 1] if n else np.zeros(0, np.int64)
        # Each group is what hangs below one node by one key. Its first item becomes that node's child, the others go below it.
        left, node = np.flatnonzero(~starts), self.root_of[~starts]
        while len(left):
            key = np.bitwise_count(items[left] ^ items[node]).astype(np.int64)
            order = np.lexsort((left, key, node))
            left, node, key = left[order], node[order], key[order]
            first = np.r_[True, (node[1:] != node[:-1]) | (key[1:] != key[:-1])]
            child = left[first]
            self.parent[child], self.key[child] = node[first], key[first]
            below = child[np.cumsum(first) - 1]
            left, node = left[~first], below[~first]
        order = np.lexsort((self.key, self.parent))
        order = order[np.searchsorted(self.parent[order], 0) :]
        self.children = order
        # Children of a node are next to each other, sorted by key; (parent, key) in one number finds a range of them.
        self.at = self.parent[order] * 128 + self.key[order]

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query item, found item) with a distance of at most radius, within the queries' shards, in bounded pieces."""
        stack = [(queries[a : a + PAIRS], self.root_of[queries[a : a + PAIRS]]) for a in range(0, len(queries), PAIRS)]
        while stack:
            query, node = stack.pop()
            d = np.bitwise_count(self.items[query] ^ self.items[node]).astype(np.int64)
            hit = d <= radius
            yield query[hit], node[hit]
            lo = np.searchsorted(self.at, node * 128 + np.maximum(d - radius, 0))
            n = np.searchsorted(self.at, node * 128 + d + radius, side="right") - lo
            on = n > 0
            query, lo, n = query[on], lo[on], n[on]
            cut = np.flatnonzero(np.diff(np.cumsum(n) // PAIRS, prepend=0))
            for q, a, k in zip(*(np.split(x, cut) for x in (query, lo, n))):
                if len(q):
                    offset = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                    stack.append((np.repeat(q, k), self.children[np.repeat(a, k) + offset]))


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each the smallest item of its component so far) after the links a-b."""
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return label
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def stars(shard: np.ndarray, items: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, smallest of its local component) that connect what is linked within each shard."""
    trees, label = Trees(shard, items), np.arange(len(items))
    for a, b in trees.search(np.arange(len(items)), radius):
        label = merge(label, a, b)
    off = np.flatnonzero(label != np.arange(len(items)))
    return off, label[off]


def _blocks(width: int, count: int) -> list[int]:
    """Masks of `count` blocks that cover the lowest `width` positions."""
    edges = [round(i * width / count) for i in range(count + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]


def agreeing(radius: int, n: int, width: int = 64) -> int:
    """How many blocks a shard is keyed by: the fewest with which n even fingerprints give small shards."""
    c = 1
    while c < 3 and n / 2 ** (width * c / (radius + c)) > SHARD_FINGERPRINTS:
        c += 1
    return c


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _deal(found: DataFrame, masks: list[int]) -> DataFrame:
    """A row (rep, fp, shard, used) per mask: the shard is keyed by the mask and the fingerprint's bits under it."""
    each = F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("used")
    return found.select("rep", "fp", each).withColumn("shard", F.xxhash64("used", F.col("fp").bitwiseAND(F.col("used"))))


def _redeal(crowds: DataFrame, radius: int, parts: int) -> DataFrame:
    """Deals crowds by the bits their shard doesn't fix: a row for each of radius + 1 parts of these."""

    def masks(used: int) -> list[int]:
        free = [i for i in range(64) if not (used >> i) & 1]
        return [_signed(used | sum(1 << i for i in free[k::parts])) for k in range(parts)]

    kinds = [r["used"] for r in crowds.select("used").distinct().collect()]  # as many as there are masks, whatever the data
    if not kinds:
        return crowds
    table = F.create_map(*[x for u in kinds for x in (F.lit(u), F.array(*[F.lit(m) for m in masks(u & (1 << 64) - 1)]))])
    out = crowds.select("rep", "fp", F.col("shard").alias("above"), F.explode(F.element_at(table, F.col("used"))).alias("used"))
    return out.select("rep", "fp", F.xxhash64("above", "used", F.col("fp").bitwiseAND(F.col("used"))).alias("shard"), "used")


def _linked(radius: int):
    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Batches are sorted by shard; a shard that a batch ends in waits for the next."""
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            whole = pdf["shard"].to_numpy() != pdf["shard"].iloc[-1]
            rest = pdf[~whole]
            yield from _star_rows(pdf[whole], radius)
        if rest is not None:
            yield from _star_rows(rest, radius)

    return link


def _star_rows(pdf: pd.DataFrame, radius: int) -> Iterator[pd.DataFrame]:
    if len(pdf) > 1:
        rep = pdf["rep"].to_numpy()
        a, b = stars(pdf["shard"].to_numpy(), pdf["fp"].to_numpy(), radius)
        yield pd.DataFrame({"u": np.maximum(rep[a], rep[b]), "v": np.minimum(rep[a], rep[b])})


def links(found: DataFrame, radius: int = 4) -> DataFrame:
    """u, v (u > v): links that connect all that is reachable. found: rep (a number), fp, both distinct."""
    c = agreeing(radius, found.count())
    blocks = _blocks(64, radius + c)
    dealt = _deal(found, [sum(x) for x in combinations(blocks, c)])
    todo, ready = dealt, []
    for _ in range(2):
        todo = materialise(todo, "dealt")
        crowded = materialise(todo.groupBy("shard").agg(F.count("*").alias("n")).filter(F.col("n") > CROWD).select("shard"), "crowded")
        ready.append(todo.join(crowded, "shard", "left_anti"))
        todo = _redeal(todo.join(crowded, "shard", "left_semi"), radius, radius + 1)
    ready.append(todo)
    out = None
    for df in ready:
        one = df.select("shard", "rep", "fp").repartition("shard").sortWithinPartitions("shard", "rep").mapInPandas(_linked(radius), "u long, v long")
        out = one if out is None else out.unionByName(one)
    return out.distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, component (its smallest reachable node) of every node with an edge (u, v).

    Large-star and small-star rounds: each links all larger, then all not larger neighbours of a node to the smallest one.
    Smallest neighbours are map-side combined and joined back, so a node with very many neighbours isn't gathered in one
    task. Every round is a table in the shared folder.
    """
    edges = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    state = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "low")
        large = materialise(both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "large")
        low = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = materialise(small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def fingerprint_components(rows: DataFrame, radius: int = 4) -> DataFrame:
    """fp, component (smallest o reachable) of each distinct fingerprint. rows: o, fp."""
    found = materialise(rows.groupBy("fp").agg(F.min("o").alias("rep")), "distinct-fingerprints")
    linked = components(links(found, radius))
    whole = found.join(linked, found["rep"] == linked["node"], "left").select("fp", F.coalesce("component", "rep").alias("component"))
    return materialise(whole, "components")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable, itself included), fingerprint_bits.

    Null and empty texts, and those of blanks only, have fingerprint zero and link like any other. Rows with a null doc_id
    are kept and linked; their own id counts as larger than all others, and a component of only such rows has a null id.
    Repeated rows come back repeated. A bit that just half of the shingles set is 0. Texts are read whole, whatever their
    length. An empty table gives an empty result. Other columns are not read, whatever their names.
    """
    of = F.pandas_udf(_fingerprints, "long")
    rows = materialise(docs.select(F.coalesce(F.col(doc_id), F.lit(NO_ID)).cast("long").alias("o"), of(F.col(text)).alias("fp")), "fingerprints")
    whole = fingerprint_components(rows, radius)
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return rows.join(whole, "fp").select(known("o").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), known("component").alias("component_id"), F.col("fp").alias("fingerprint_bits"))


def op5_simhash(spark, sf_dir):
    return near_duplicates(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))).drop("fingerprint_bits")


QUERIES = {"op5_simhash": op5_simhash}
SQL: dict[str, str] = {}
