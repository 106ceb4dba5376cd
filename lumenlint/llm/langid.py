"""Language identification with a bidirectional gated recurrent network over bytes.

Two gated recurrent layers read a text's bytes forwards and backwards; their states at each position give the position's
language probabilities, which a document pools. The network is trained in numpy by backpropagation through time, on a
bounded sample of labelled documents (`max_docs`, `steps` x `batch` windows).

Texts are read whole, in windows of `WINDOW` bytes that the recurrence starts anew in; each window also reads the
`LEAD` bytes before and after it, which warm the states up and aren't labelled again. Windows are alike in length, so
any text, however long, is labelled in bounded memory.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread, table

WINDOW, LEAD, HIDDEN = 240, 8, 8
LETTER = re.compile(r"[^\W\d_]")
PAD = 256  # a symbol before and after a text
ROWS = 1024  # windows computed at once
WIDTHS = 60  # windows are padded to a multiple of so many bytes, which depends on the window alone


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.multiply(x, 0.5, out=x)
    np.tanh(x, out=x)
    np.add(x, 1, out=x)
    return np.multiply(x, 0.5, out=x)


class Layer:
    """One direction: z and r gates and candidate n. h' = (1 - z) n + z h, n = tanh(W x + r * (U h + c))."""

    def __init__(self, rng: np.random.Generator, hidden: int):
        self.e = rng.normal(0, 0.3, (PAD + 1, 3 * hidden)).astype(np.float32)  # W x + b, by byte
        self.u = (rng.normal(0, 1, (3 * hidden, hidden)) / np.sqrt(hidden)).astype(np.float32)
        self.c = np.zeros((hidden, 1), np.float32)

    def arrays(self) -> list[np.ndarray]:
        return [self.e, self.u, self.c]

    def states(self, x: np.ndarray, trace: list | None = None) -> np.ndarray:
        """x: time x rows of symbols. States as time x hidden x rows; trace gets what the backward pass needs."""
        k, (steps, rows) = self.u.shape[1], x.shape
        h = np.zeros((k, rows), np.float32)
        out = np.empty((steps, k, rows), np.float32)
        by_gate = np.ascontiguousarray(self.e.T)
        for t in range(steps):
            a = by_gate.take(x[t], axis=1)
            g = self.u @ h
            gates = _sigmoid(a[: 2 * k] + g[: 2 * k])
            z, r = gates[:k], gates[k:]
            s = g[2 * k :] + self.c
            n = np.tanh(a[2 * k :] + r * s)
            if trace is not None:
                trace.append((h, z, r, s, n))
            h = n + z * (h - n)
            out[t] = h
        return out

    def back(self, x: np.ndarray, trace: list, dout: np.ndarray) -> list[np.ndarray]:
        """Gradients of e, u and c through time."""
        k = self.u.shape[1]
        de, du, dc = np.zeros_like(self.e), np.zeros_like(self.u), np.zeros_like(self.c)
        dh = np.zeros_like(dout[0])
        for t in range(len(x) - 1, -1, -1):
            h, z, r, s, n = trace[t]
            dh = dh + dout[t]
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (h - n) * z * (1 - z)
            dr = dn * s * r * (1 - r)
            ds = dn * r
            dg = np.concatenate([dz, dr, ds])
            np.add.at(de, x[t], np.concatenate([dz, dr, dn]).T)
            du += dg @ h.T
            dc += ds.sum(axis=1, keepdims=True)
            dh = dh * z + self.u.T @ dg
        return [de, du, dc]


class Network:
    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs, self.forward, self.backward = langs, Layer(rng, hidden), Layer(rng, hidden)
        self.w = (rng.normal(0, 1, (len(langs), 2 * hidden)) / np.sqrt(2 * hidden)).astype(np.float32)
        self.b = np.zeros((len(langs), 1), np.float32)

    def arrays(self) -> list[np.ndarray]:
        return [*self.forward.arrays(), *self.backward.arrays(), self.w, self.b]

    def logits(self, x: np.ndarray) -> np.ndarray:
        """x: time x rows. time x languages x rows."""
        k = self.w.shape[1] // 2
        return self.w[:, :k] @ self.forward.states(x) + self.w[:, k:] @ self.backward.states(x[::-1])[::-1] + self.b

    def step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Loss and gradients for windows x with the languages y; every position is to name its document's language."""
        k, count = self.w.shape[1] // 2, x.size
        fwd: list = []
        bwd: list = []
        hf, hb = self.forward.states(x, fwd), self.backward.states(x[::-1], bwd)[::-1]
        p = softmax(self.w[:, :k] @ hf + self.w[:, k:] @ hb + self.b)
        rows = np.arange(x.shape[1])
        loss = -float(np.log(p[:, y, rows] + 1e-9).mean())
        p[:, y, rows] -= 1
        p /= count
        over = lambda h: np.einsum("tlr,tkr->lk", p, h, optimize=True)
        dw = np.concatenate([over(hf), over(hb)], axis=1)
        df, db = self.w[:, :k].T @ p, self.w[:, k:].T @ p
        return loss, [*self.forward.back(x, fwd, df), *self.backward.back(x[::-1], bwd, db[::-1]), dw, p.sum(axis=(0, 2))[:, None]]

    def fit(self, texts: list[bytes], labels: list[int], steps: int, batch: int, length: int, rate: float, seed: int = 11) -> list[float]:
        """Adam over random windows, languages drawn evenly."""
        rng = np.random.default_rng(seed)
        by = [[i for i, y in enumerate(labels) if y == k] for k in range(len(self.langs))]
        first, second, losses = [np.zeros_like(a) for a in self.arrays()], [np.zeros_like(a) for a in self.arrays()], []
        for turn in range(1, steps + 1):
            y = rng.integers(0, len(by), batch)
            x = np.full((length, batch), PAD, np.int64)
            for j, k in enumerate(y.tolist()):
                text = texts[by[k][rng.integers(len(by[k]))]]
                at = int(rng.integers(0, max(1, len(text) - length + 1)))
                piece = np.frombuffer(text[at : at + length], np.uint8)
                x[: len(piece), j] = piece
            loss, grads = self.step(x, y)
            losses.append(loss)
            now = rate * min(1.0, 2.0 * (1 - turn / (steps + 1)))
            size = np.sqrt(sum(float((g * g).sum()) for g in grads))
            for a, g, m, v in zip(self.arrays(), grads, first, second):
                g = g * min(1.0, 1.0 / max(size, 1e-9))
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                a -= now * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)
        return losses

    def predict(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities over all positions of each text: texts x languages. Empty texts get zeros."""
        out = np.zeros((len(texts), len(self.langs)))
        total = np.zeros(len(texts))
        for x, owner, kept in windows(texts):
            p = softmax(self.logits(x)[LEAD:-LEAD])
            mask = np.arange(len(p))[:, None] < kept
            np.add.at(out, owner, (p * mask[:, None, :]).sum(axis=0).T)
            np.add.at(total, owner, kept)
        return out / np.maximum(total, 1)[:, None]

    def positions(self, text: bytes) -> np.ndarray:
        """The index of the most probable language at each byte."""
        return np.concatenate([np.zeros(0, np.int64), *(softmax(self.logits(x)[LEAD:-LEAD])[:n, :, i].argmax(axis=1) for x, _, kept in windows([text]) for i, n in enumerate(kept))])


def softmax(x: np.ndarray) -> np.ndarray:
    """Over axis 1."""
    x = x - x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    return np.divide(x, x.sum(axis=1, keepdims=True), out=x)


def windows(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(time x rows symbols, text of each row, bytes labelled in each row), at most ROWS rows at once."""
    starts = [(i, a) for i, t in enumerate(texts) for a in range(0, len(t), WINDOW)]
    # Windows of one width go together, so that no text's result depends on the others in its batch.
    by_width: dict[int, list[tuple[int, int]]] = {}
    for i, a in starts:
        by_width.setdefault(-(-min(WINDOW, len(texts[i]) - a) // WIDTHS) * WIDTHS + 2 * LEAD, []).append((i, a))
    for width, some in ((w, s[at : at + ROWS]) for w, s in by_width.items() for at in range(0, len(s), ROWS)):
        kept = np.array([min(WINDOW, len(texts[i]) - a) for i, a in some])
        x = np.full((len(some), width), PAD, np.int16)
        for j, (i, a) in enumerate(some):
            lo = max(0, a - LEAD)
            piece = np.frombuffer(texts[i], np.uint8, min(len(texts[i]), a - LEAD + width) - lo, lo)
            x[j, lo - a + LEAD : lo - a + LEAD + len(piece)] = piece
        yield np.ascontiguousarray(x.T), np.array([i for i, _ in some]), kept


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", max_docs: int = 4000, doc_bytes: int = 4096, steps: int = 260, batch: int = 192, length: int = 64, rate: float = 0.02, row_key: str = "doc_id") -> Network | None:
    """A network fitted on about max_docs rows with a language, drawn evenly by a hash; None if there are none.

    For fitting (only), a document gives one piece of doc_bytes / 2 characters, at a place drawn by its hash; predictions
    read whole texts.
    """
    usable = labelled.filter(F.col(lang).isNotNull() & F.coalesce(F.col(text), F.lit("")).rlike(r"\p{L}")).select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(F.lit("langid"), F.col(row_key)).alias("h"))
    counts = usable.groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("h")).orderBy("lang").collect()
    if not counts:
        return None
    share = max_docs / len(counts)
    bound = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(float(min(1.0, share / r["n"]))))])
    # A row is drawn if its hash is in the lower part of its language's range, or is the lowest.
    lowest = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(r["h"]))])
    drawn = usable.filter(((F.col("h").cast("double") / 2.0**64 + 0.5) < bound[F.col("lang")]) | (F.col("h") == lowest[F.col("lang")]))
    piece = F.substring("text", (F.pmod("h", F.greatest(F.char_length("text") - doc_bytes // 2, F.lit(0)) + 1) + 1).cast("int"), F.lit(doc_bytes // 2))
    rows = drawn.select("h", "lang", piece.alias("text")).collect()
    rows.sort(key=lambda r: (r["h"], r["text"]))
    langs = [r["lang"] for r in counts]
    net = Network(langs)
    net.fit([r["text"].encode("utf-8", "surrogatepass") for r in rows], [langs.index(r["lang"]) for r in rows], steps, batch, length, rate)
    return net


def predictor(net: Network | None):
    """A function from text to struct(lang_pred, score): `und` and 0 where the text is null or has no letter, or nothing was learned."""

    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            texts = texts.tolist()
            known = [i for i, t in enumerate(texts) if net is not None and t and LETTER.search(t)]
            langs, scores = np.full(len(texts), "und", object), np.zeros(len(texts))
            for at in range(0, len(known), 512):
                some = known[at : at + 512]
                p = net.predict([texts[i].encode("utf-8", "surrogatepass") for i in some])
                langs[some], scores[some] = np.array(net.langs, object)[p.argmax(axis=1)], np.clip(p.max(axis=1), 0, 1)
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    return F.pandas_udf(predict, "lang_pred string, score double")


def identify(docs: DataFrame, net: Network | None, text: str = "text", into: str = "language") -> DataFrame:
    """docs with a struct column `into`: lang_pred, score (mean probability of that language over all bytes).

    Null texts and texts without a letter are `und` with score 0. Ties go to the language that sorts first. Repeated rows
    get the same; other columns stay as they are and are never read, but for one called `into`, which the result replaces.
    Texts are read whole, in windows, whatever their length. An empty table gives an empty result.
    """
    return docs.withColumn(into, predictor(net)(F.col(text)))


def op4_langid(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    net = learn(docs.filter(~held).select("doc_id", "text", "lang"))
    return identify(spread(docs).select("doc_id", "text", F.coalesce(held, F.lit(False)).alias("held_out")), net).select("doc_id", "held_out", "language.*")


QUERIES = {"op4_langid": op4_langid}
SQL: dict[str, str] = {}
