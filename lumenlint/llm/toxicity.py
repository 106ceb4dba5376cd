"""Toxicity by the nearest labelled examples, with exact TF-IDF cosine over a block-max inverted index.

1. A bounded sample of labelled rows (`max_examples`, half of each class) is drawn by a hash of the id.
2. All terms of the examples' whole texts are the dimensions of the vector space, without a cap. A further dimension says
   how many telling words a text has, in steps (`COUNTS`).
3. One pass over all documents counts how many hold each term. A term weighs (1 + log count) x idf x relevance, where the
   relevance is how surely the examples' classes differ in it (the root of the log-likelihood ratio, above `CHANCE`), and
   a small `FLOOR` for all other terms. So every text with any term of the examples has nearest ones.
4. The examples' unit vectors form the index: postings by term, in blocks of examples, with each term's largest weight per
   block. Terms that many examples share are a matrix instead, which a batch of queries is multiplied by; these exact parts
   of the scores and the largest weights of all other terms bound each block. A query's best blocks are scored first, then
   all blocks whose bound reaches the worst of the k best so far: the top k is exact.
5. The k nearest vote, weighted by squared similarity and by how many labelled rows an example stands for. Leave-one-out
   votes of the examples calibrate the scores by isotonic regression. A text without any term of the space has no nearest
   example; its score is the share of toxic rows among such examples.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, spread, table

TERM = re.compile(r"[^\W_]+")
#: A text with telling words (relevant ones that lean toxic) has one more term, for the largest of these counts that their
#: number reaches. Cosine alone can't tell a text that uses one by chance from one that is full of them.
COUNTS = (1, 2, 3, 4, 6)
COUNT_WEIGHT = 1.5
#: Root of the log-likelihood ratio that chance alone hardly gives any of the terms, and what such terms weigh.
CHANCE, FLOOR = 4.0, 0.01
BLOCK = 32  # examples of a block
FIRST = 4  # blocks scored first
OFTEN = 16  # a term of more than 1/OFTEN of the examples is a row of the matrix
TOGETHER = 64  # queries that the matrix is multiplied by at once

Vector = tuple[np.ndarray, np.ndarray]  # distinct dimensions and their weights


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (n[0] of them), start[1], ..."""
    return np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)


def _alike_together(vectors: list[Vector], n_terms: int) -> list[int]:
    """An order in which like examples are near each other, which makes block bounds tight.

    Vectors are projected to a few random directions; sets are cut in halves along their main direction down to a block.
    """
    directions = np.random.default_rng(7).standard_normal((n_terms, 48)).astype(np.float32)
    x = np.array([w.astype(np.float32) @ directions[ids] for ids, w in vectors], np.float32).reshape(len(vectors), 48)
    todo, out = [np.arange(len(vectors))], []
    while todo:
        some = todo.pop()
        if len(some) <= BLOCK:
            out += some.tolist()
            continue
        centred = x[some] - x[some].mean(axis=0)
        main = np.linalg.eigh(centred.T @ centred)[1][:, -1]
        by = some[np.argsort(centred @ main, kind="stable")]
        half = -(-len(by) // BLOCK // 2) * BLOCK  # whole blocks
        todo += [by[half:], by[:half]]
    return out


class BlockMaxIndex:
    """Examples as sparse unit vectors; exact top k by dot product."""

    def __init__(self, vectors: list[Vector], n_terms: int):
        self.order = np.array(_alike_together(vectors, n_terms), np.int64)
        self.n, self.blocks = len(vectors), -(-len(vectors) // BLOCK)
        ids = [vectors[i][0] for i in self.order]
        term = np.concatenate([*ids, np.zeros(0, np.int64)]).astype(np.int64)
        at = np.repeat(np.arange(self.n), [len(x) for x in ids])
        weight = np.concatenate([*(vectors[i][1] for i in self.order), np.zeros(0)])
        by = np.lexsort((at, term))
        term, self.at, self.weight = term[by], at[by].astype(np.int32), weight[by]
        # Terms of many examples are rows of a matrix, all others lists; an entry is the run of a term's postings in a block.
        held = np.bincount(term, minlength=n_terms)
        often = np.flatnonzero(held * OFTEN > self.n)
        self.row = np.full(n_terms, -1, np.int64)
        self.row[often] = np.arange(len(often))
        self.dense = np.zeros((len(often), self.n))
        in_rows = self.row[term] >= 0
        self.dense[self.row[term[in_rows]], self.at[in_rows]] = self.weight[in_rows]
        term, self.at, self.weight = term[~in_rows], self.at[~in_rows], self.weight[~in_rows]
        block = self.at // BLOCK
        begins = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (block[1:] != block[:-1])]) if len(term) else np.zeros(0, np.int64)
        self.begin = np.append(begins, len(term))
        self.block = block[begins]
        self.most = np.maximum.reduceat(self.weight, begins) if len(term) else np.zeros(0)
        self.entry = np.searchsorted(term[begins], np.arange(n_terms + 1))

    def top(self, queries: list[Vector], k: int, without: list[int] | None = None) -> list[list[tuple[float, int]]]:
        """(similarity, example) of each query's k nearest with a similarity above 0, best first; ties by example number."""
        out: list[list[tuple[float, int]]] = []
        for lo in range(0, len(queries) if self.n else 0, TOGETHER):
            some = queries[lo : lo + TOGETHER]
            q = np.zeros((len(some), len(self.dense)))
            for i, (ids, weights) in enumerate(some):
                row = self.row[ids]
                q[i, row[row >= 0]] = weights[row >= 0]
            part = q @ self.dense
            most = np.maximum.reduceat(part, np.arange(self.blocks) * BLOCK, axis=1)
            out += [self._nearest(query, part[i], most[i], k, without[lo + i] if without else -1) for i, query in enumerate(some)]
        return out or [[] for _ in queries]

    def _nearest(self, query: Vector, score: np.ndarray, bound: np.ndarray, k: int, without: int) -> list[tuple[float, int]]:
        """score: by the terms of the matrix, of each example; bound: its largest in each block."""
        rare = self.row[query[0]] < 0
        ids, weights = query[0][rare], query[1][rare]
        first = self.entry[ids]
        n = self.entry[ids + 1] - first
        entries, q = _ranges(first, n), np.repeat(weights, n)
        block, begin = self.block[entries], self.begin[entries]
        size = self.begin[entries + 1] - begin
        bound = bound + np.bincount(block, q * self.most[entries], self.blocks)

        def visit(use: np.ndarray) -> np.ndarray:
            at = _ranges(begin[use], size[use])
            return np.bincount(self.at[at], np.repeat(q[use], size[use]) * self.weight[at], self.n)

        seen = np.zeros(self.blocks, bool)
        seen[np.argpartition(-bound, min(FIRST, self.blocks) - 1)[:FIRST]] = True
        score = score + visit(seen[block])
        worst = np.partition(score, -k - 1)[-k - 1] if self.n > k else 0.0  # one more than k, as `without` may be among them
        rest = (~seen & (bound >= worst - 1e-9))[block]
        if rest.any():
            score += visit(rest)
        score = np.round(score, 12)
        if without >= 0:
            score[self.order == without] = 0.0
        found = np.flatnonzero(score > 0)
        if len(found) > k:
            found = found[score[found] >= np.partition(score[found], -k)[-k]]
        return sorted(((float(score[i]), int(self.order[i])) for i in found), key=lambda x: (-x[0], x[1]))[:k]


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled-adjacent-violators fit of y by x, as the points of a non-decreasing line."""
    pools: list[list[float]] = []
    for i in np.argsort(x, kind="stable").tolist():
        pools.append([x[i], x[i], y[i] * w[i], w[i]])
        while len(pools) > 1 and (pools[-2][1] == pools[-1][0] or pools[-2][2] / pools[-2][3] >= pools[-1][2] / pools[-1][3]):
            _, hi, s, n = pools.pop()
            pools[-1] = [pools[-1][0], hi, pools[-1][2] + s, pools[-1][3] + n]
    return np.array([v for lo, hi, _, _ in pools for v in (lo, hi)]), np.array([v for _, _, s, n in pools for v in (s / n, s / n)])


def relevance(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Root of the log-likelihood ratio that a term is as frequent in both classes; below 0 if it leans clean. Counts are of examples."""
    held, n = toxic + clean, n_toxic + n_clean
    if not n_toxic or not n_clean:
        return np.zeros(len(held))
    part = lambda k, of, all_: np.where(k > 0, k * np.log(np.maximum(k, 1e-12) * n / np.maximum(of * all_, 1e-12)), 0.0)
    ratio = 2 * (part(toxic, held, n_toxic) + part(clean, held, n_clean) + part(n_toxic - toxic, n - held, n_toxic) + part(n_clean - clean, n - held, n_clean))
    return np.sqrt(np.maximum(ratio, 0)) * np.where(toxic * n_clean >= clean * n_toxic, 1, -1)


class Space:
    """The examples' terms as dimensions, and the steps of COUNTS after them."""

    def __init__(self, counts: list[dict[str, int]], labels: list[int]):
        self.number = {t: i for i, t in enumerate(sorted(set().union(*counts)))}
        held = np.zeros((2, len(self.number)))
        for c, y in zip(counts, labels):
            held[y, [self.number[t] for t in c]] += 1
        self.relevance = relevance(held[1], held[0], sum(labels), len(labels) - sum(labels))
        self.telling = self.relevance > CHANCE
        self.size = len(self.number) + len(COUNTS)
        self.weight = np.zeros(self.size)

    def count(self, counts: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """Dimensions a text has, and how often."""
        number = self.number
        ids = np.fromiter(map(number.get, counts, repeat(-1)), np.int64, len(counts))
        tfs = np.fromiter(counts.values(), np.int64, len(counts))
        known = ids >= 0
        ids, tfs = ids[known], tfs[known]
        told = int(tfs[self.telling[ids]].sum())
        return (np.append(ids, len(number) + sum(told >= n for n in COUNTS) - 1), np.append(tfs, 1)) if told else (ids, tfs)

    def weigh(self, df: np.ndarray, rows: int) -> None:
        """Sets the dimensions' weights. df: how many of all `rows` documents have a dimension."""
        idf = np.log((rows + 1) / (df + 1))
        factor = FLOOR + np.maximum(0, np.abs(self.relevance) - CHANCE) / 10
        self.weight = idf * np.append(factor, np.full(len(COUNTS), COUNT_WEIGHT))

    def vector(self, ids: np.ndarray, tfs: np.ndarray) -> Vector:
        w = (1 + np.log(tfs)) * self.weight[ids]
        ids, w = ids[w > 0], w[w > 0]
        return ids, w / np.sqrt((w * w).sum()) if len(w) else w


def terms_of(text: str | None) -> Counter:
    return Counter(TERM.findall(text.lower())) if text else Counter()


class Scorer:
    """The index with the examples' labels, weights and the calibration."""

    def __init__(self, space: Space, ids: list[int], labels: list[int], counts: list[dict[str, int]], weights: tuple[float, float], k: int):
        self.space, self.ids, self.labels, self.k = space, ids, np.array(labels, np.int64), k
        vectors = [space.vector(*space.count(c)) for c in counts]
        self.each = np.array([weights[y] for y in labels])
        empty = np.array([not len(v[0]) for v in vectors], bool)
        share = lambda at: float((self.each * self.labels)[at].sum() / max(self.each[at].sum(), 1e-9)) if len(labels) else 0.0
        self.overall = share(np.ones(len(labels), bool))
        self.prior = share(empty) if empty.any() else self.overall
        self.index = BlockMaxIndex(vectors, space.size)
        known = np.flatnonzero(~empty)
        votes = np.array([self.vote(near) for near in self.index.top([vectors[i] for i in known], k, known.tolist())])
        self.line = isotonic(votes, self.labels[known].astype(float), self.each[known]) if len(known) else (np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def vote(self, near: list[tuple[float, int]]) -> float:
        if not near:
            return self.overall
        at = [i for _, i in near]
        w = np.array([s * s for s, _ in near]) * self.each[at]
        return float(((w * self.labels[at]).sum() + 0.05 * self.overall) / (w.sum() + 0.05))

    def score(self, texts: list[str | None]) -> list[tuple[float, list[tuple[float, int]]]]:
        """Score and the nearest (similarity, example) of each text."""
        found = self.index.top([self.space.vector(*self.space.count(terms_of(t))) for t in texts], self.k)
        return [(float(np.interp(self.vote(near), *self.line)), near) if near else (self.prior, []) for near in found]


def _examples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        found = [terms_of(t) for t in pdf["text"]]
        yield pd.DataFrame({"id": pdf["id"], "toxic": pdf["toxic"], "terms": [list(c) for c in found], "tfs": [list(c.values()) for c in found]})


def _frequencies(shared):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """How many documents of the task have each dimension; all of them as number -1."""
        df, rows = np.zeros(shared.value.size, np.int64), 0
        for pdf in batches:
            for t in pdf["text"]:
                df[shared.value.count(terms_of(t))[0]] += 1
            rows += len(pdf)
        at = np.flatnonzero(df)
        yield pd.DataFrame({"dimension": np.append(at, -1).astype(np.int32), "n": np.append(df[at], rows)})

    return count


def score_toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", max_examples: int = 2000, k: int = 15) -> DataFrame:
    """One row per row of docs: doc_id, score (0 to 1), predicted (1 from 0.5 on), evidence (doc_id, toxic, similarity).

    labels: doc_id and a label of 0 or 1; null labels and ids are left out, repeated ids count once (toxic if any row is).
    Only text makes a score: null and empty texts, like all without a term of the examples, get the share of toxic rows
    among such examples, or of all if there are none. Whole texts are read, whatever their length. Of examples equally
    near, the one with the smaller id comes first. Repeated rows get equal scores; of rows that repeat an example's id,
    the smallest text is the example. Other columns of docs are not read, whatever their names. With no labels at all
    every score is 0. An empty table gives an empty result. At most max_examples examples (and, by chance of the draw, a
    few more) reach the driver, with their distinct terms and counts.
    """
    spark = docs.sparkSession
    clean = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.max(F.when(F.col(label) > 0, 1).otherwise(0)).alias("toxic"))
    n = {r["toxic"]: r["n"] for r in clean.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = [min(1.0, max_examples / 2 / n.get(y, 1)) for y in (0, 1)]
    u = F.xxhash64(F.lit("toxicity"), "id").cast("double") / 2.0**64 + 0.5
    drawn = materialise(clean.filter(u < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0])), "examples")
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    sample = own.join(F.broadcast(drawn), F.col("doc_id") == F.col("id")).groupBy("id").agg(F.max("toxic").cast("int").alias("toxic"), F.min("text").alias("text"))
    rows = sorted(sample.mapInPandas(_examples, "id long, toxic int, terms array<string>, tfs array<int>").collect(), key=lambda r: r["id"])
    counts = [dict(zip(r["terms"], r["tfs"])) for r in rows]
    ys = [r["toxic"] for r in rows]

    space = Space(counts, ys)
    held = own.select("text").mapInPandas(_frequencies(spark.sparkContext.broadcast(space)), "dimension int, n long").groupBy("dimension").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(space.size)
    df[held["dimension"][held["dimension"] >= 0]] = held["n"][held["dimension"] >= 0]
    space.weigh(df, int(held["n"][held["dimension"] < 0].sum()))
    scorer = Scorer(space, [r["id"] for r in rows], ys, counts, tuple(n.get(y, 0) / max(1, ys.count(y)) for y in (0, 1)), k)
    shared = spark.sparkContext.broadcast(scorer)

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = [x for lo in range(0, len(texts), TOGETHER) for x in shared.value.score(texts.iloc[lo : lo + TOGETHER].tolist())]
            at = [np.array([i for _, i in near], np.int64) for _, near in out]
            yield pd.DataFrame({"score": [s for s, _ in out], "doc_id": [ids[i] for i in at], "toxic": [shared.value.labels[i] for i in at], "similarity": [np.array([s for s, _ in near]) for _, near in out]})

    # Three flat arrays cross from Python faster than an array of structs.
    ids = np.array([r["id"] for r in rows], np.int64)
    scored = F.pandas_udf(score, "score double, doc_id array<long>, toxic array<long>, similarity array<double>")
    found = own.select("doc_id", scored("text").alias("s"))
    evidence = F.transform(F.arrays_zip(F.col("s.doc_id"), F.col("s.toxic"), F.col("s.similarity")), lambda x: F.struct(x["doc_id"].alias("doc_id"), x["toxic"].cast("int").alias("toxic"), x["similarity"].alias("similarity")))
    return found.select("doc_id", "s.score", F.when(F.col("s.score") >= 0.5, 1).otherwise(0).alias("predicted"), evidence.alias("evidence"))


def op1_toxicity(spark, sf_dir):
    fold = lambda c: F.coalesce(F.pmod(F.crc32(F.col(c).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
    labels = table(spark, sf_dir, "labels").filter(~fold("doc_id"))
    out = score_toxicity(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), labels.select("doc_id", "toxic"))
    return out.select("doc_id", fold("doc_id").alias("held_out"), "score", "predicted", F.to_json("evidence").alias("evidence"))


QUERIES = {"op1_toxicity": op1_toxicity}
SQL: dict[str, str] = {}
