"""Near-dedup by similarity: SimHash links, and texts whose sets of word shingles have a Jaccard similarity of 0.8 or more.

SimHash with a small radius misses most near copies with a few changed words. So each distinct set of shingles also has a
MinHash signature, cut into bands; sets that agree on a band are candidates. A pair of similarity s meets with a
probability of 1 - (1 - s**ROWS)**BANDS, which is 0.999997 at 0.8 and more above. Candidates are confirmed on the exact
sets, so no pair below the similarity is linked by them.

Bands whose sets SimHash has joined already, and repeats of a band with the same sets, are left out. The sets of a small
band meet as pairs. In a band of more than CROWD sets, those linked to a set leave the rest before the next one looks for
its own, so a crowd of near copies takes about one look at each, not all pairs. Only candidates' sets are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import NO_ID, materialise

BANDS, ROWS = 24, 4
CROWD = 32  # sets of a band up to which they meet as pairs
_RANDOM = np.random.default_rng(42).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64)
_FLIP, _TIMES = _RANDOM[0], _RANDOM[1] | np.uint64(1)
_MIX = np.random.default_rng(43).integers(0, 1 << 64, ROWS + 1, np.uint64) | np.uint64(1)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of a whole text's word shingles; empty without words."""
    return np.unique(simhash.shingle_hashes(text, width))


def bands(found: np.ndarray) -> np.ndarray:
    """A key per band of the MinHash signature of a set."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 1 << 12):  # bounded memory for very long texts
        low = np.minimum(low, ((found[at : at + (1 << 12), None] ^ _FLIP) * _TIMES).min(axis=0))
    return (low.reshape(BANDS, ROWS) * _MIX[:ROWS]).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _MIX[ROWS]


def _digest(found: np.ndarray) -> int | None:
    h = xxhash.xxh64_intdigest(found.tobytes(), 42)
    return None if not len(found) else h - (1 << 64) if h >> 63 else h


def _digests(width: int):
    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            sets = [shingle_set(t, width) for t in texts]
            fp = np.array([simhash.fingerprint(t) for t in texts], np.uint64).view(np.int64)
            yield pd.DataFrame({"fp": fp, "s": pd.array([_digest(x) for x in sets], "Int64"), "bands": [bands(x).view(np.int64) if len(x) else [] for x in sets]})

    return F.pandas_udf(digests, "fp long, s long, bands array<long>")


def _sets(width: int):
    def sets(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = [shingle_set(t, width) for t in texts]
            yield pd.DataFrame({"s": pd.array([_digest(x) for x in found], "Int64"), "shingles": [x.view(np.int64) for x in found]})

    return F.pandas_udf(sets, "s long, shingles array<long>")


def crowd_links(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that connect all sets which chains of similar ones connect. Each set found is taken from the rest."""
    sizes = np.array([len(x) for x in sets], np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    left, out, todo = np.ones(len(sets), bool), [], []
    while left.any():
        if not todo:
            todo.append(int(left.argmax()))
            left[todo[0]] = False
            flat, owner = flat[left[owner]], owner[left[owner]]
        one = todo.pop()
        own = np.sort(sets[one])
        both = np.bincount(owner[own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat], minlength=len(sets))
        near = np.flatnonzero(left & (both >= similarity * (sizes + sizes[one] - both) - 1e-9))
        if len(near):
            out += [(one, x) for x in near.tolist()]
            todo += near.tolist()
            left[near] = False
            flat, owner = flat[left[owner]], owner[left[owner]]
    return out


def _crowds(similarity: float):
    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Batches are sorted by key; a key that a batch ends in waits for the next."""
        rest: list[pd.DataFrame] = []

        def linked(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
            for _, g in pdf.groupby("key", sort=False):
                s = g["s"].to_numpy()
                found = crowd_links([np.asarray(x, np.int64) for x in g["shingles"]], similarity)
                yield pd.DataFrame({"x": [s[a] for a, _ in found], "y": [s[b] for _, b in found]}, dtype="int64")

        for pdf in batches:
            last = pdf["key"].to_numpy() == pdf["key"].iloc[-1]
            if not last.all() or (rest and rest[-1]["key"].iloc[-1] != pdf["key"].iloc[-1]):
                yield from linked(pd.concat([*rest, pdf[~last]], ignore_index=True))
                rest = []
            rest.append(pdf[last])
        if rest:
            yield from linked(pd.concat(rest, ignore_index=True))

    return link


def similar_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 5, similarity: float = 0.8, radius: int = 4) -> DataFrame:
    """doc_id, component_id (smallest doc_id reachable, itself included) over SimHash links and links by similarity.

    Null ids, repeated rows, empty texts and empty tables are treated as in simhash.near_duplicates, whose components are
    parts of these. A text of fewer words than the width is one shingle.
    """
    o = F.coalesce(F.col(doc_id), F.lit(NO_ID)).cast("long")
    rows = materialise(docs.select(o.alias("o"), _digests(width)(F.col(text)).alias("d")).select("o", "d.*"), "digests")
    rows = materialise(rows.join(simhash.fingerprint_components(rows, radius), "fp").select("o", "s", "bands", "component"), "labelled")
    sets = materialise(rows.filter("s IS NOT NULL").groupBy("s").agg(F.min("o").alias("rep"), F.min("component").alias("component"), F.first("bands").alias("bands")), "sets")
    keys = sets.select("s", "component", F.explode("bands").alias("key"))
    alike = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("s").alias("low"), F.bit_xor(F.xxhash64("s")).alias("all"), F.min("component").alias("a"), F.max("component").alias("b")).filter("n > 1 AND a <> b")
    alike = materialise(alike.groupBy("n", "low", "all").agg(F.min("key").alias("key")).select("key", "n"), "alike")
    met = materialise(keys.join(alike, "key"), "met")

    few = met.filter(F.col("n") <= CROWD)
    other = few.select("key", F.col("s").alias("y"), F.col("component").alias("other"))
    pairs = few.select("key", F.col("s").alias("x"), "component").join(other, "key").filter("x < y AND component <> other").select("x", "y").distinct()
    pairs = materialise(pairs, "pairs")
    crowds = met.filter(F.col("n") > CROWD).select("key", "s")
    wanted = pairs.select(F.col("x").alias("s")).unionByName(pairs.select(F.col("y").alias("s"))).unionByName(crowds.select("s")).distinct()
    wanted = materialise(sets.select("s", "rep").join(wanted, "s", "left_semi"), "wanted")
    texts = docs.select(o.alias("rep"), F.col(text).alias("t")).join(wanted.select("rep").distinct(), "rep", "left_semi")
    shingles = materialise(texts.select(_sets(width)("t").alias("d")).select("d.*").dropDuplicates(["s"]), "shingles")

    one, two = (shingles.select(F.col("s").alias(c), F.col("shingles").alias("of_" + c)) for c in "xy")
    both = F.size(F.array_intersect("of_x", "of_y"))
    sure = pairs.join(one, "x").join(two, "y").filter(both >= similarity * (F.size("of_x") + F.size("of_y") - both) - 1e-9).select("x", "y")
    dealt = crowds.join(shingles, "s").select("key", "s", "shingles").repartition("key").sortWithinPartitions("key")
    sure = materialise(sure.unionByName(dealt.mapInPandas(_crowds(similarity), "x long, y long")), "similar")

    of = lambda c, as_: sets.select(F.col("s").alias(c), F.col("component").alias(as_))
    links = sure.join(of("x", "u"), "x").join(of("y", "v"), "y").select("u", "v")
    same = rows.join(sets.select("s", F.col("component").alias("v")), "s").select(F.col("component").alias("u"), "v")
    joined = simhash.components(links.unionByName(same.filter("u <> v")))
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    out = rows.join(joined, rows["component"] == joined["node"], "left").select("o", F.coalesce(joined["component"], rows["component"]).alias("c"))
    return out.select(known("o").alias("doc_id"), known("c").alias("component_id"))
