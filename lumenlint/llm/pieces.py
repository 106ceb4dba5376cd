"""Encoding and decoding with merge-type (BPE) SentencePiece models.

The model file is read by a small parser of its own. A text is normalised (the identity rule of such models, with the
dummy prefix and escaped blanks), and its characters are merged: of all adjacent pairs of symbols that form a piece, the
one with the best score goes first, the leftmost among equals. `encode_unit` does this with an agenda, a heap ordered by
score; `encode_units` does the same merges for many short units in step, on arrays.

No piece of such a vocabulary has a blank after another character, so texts fall apart before each run of blanks, and at
characters that no longer piece contains. These units are encoded once and kept in a bounded memory per process. A
vocabulary without this property is encoded whole.

One document of each Arrow batch, of any length and chosen by a hash, and each document with a unit longer than
`STEP_CHARS` that isn't in memory, is checked against the sentencepiece library; a difference stops the job.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread, table

BLANK = "▁"
STEP_CHARS = 48  # units of at most so many characters are encoded in step
MEMORY_UNITS = 250_000  # units kept per process, half of them since the memory was last turned over
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message."""
    at, end = 0, len(data)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < end:
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            at += n
            yield tag >> 3, data[at - n : at]
        else:
            n = 4 if kind == 5 else 8
            at += n
            yield tag >> 3, data[at - n : at]


class Model:
    """A merge-type model: pieces, their scores and kinds, and the tables that merging needs."""

    def __init__(self, data: bytes):
        self.data = data
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        prefix, squeeze, charsmap, kind = True, True, b"", 1
        for number, value in _fields(data):
            if number == 1:
                got = dict(_fields(value))
                self.pieces.append(bytes(got.get(1, b"")).decode())
                scores.append(struct.unpack("<f", got[2])[0] if 2 in got else 0.0)
                self.kinds.append(got.get(3, NORMAL))
            elif number == 2:
                got = dict(_fields(value))
                kind, self.fallback = got.get(3, 1), bool(got.get(35, 0))
            elif number == 3:
                got = dict(_fields(value))
                charsmap, prefix, squeeze = got.get(2, b""), bool(got.get(3, 1)), bool(got.get(4, 1))
        if kind != 2 or charsmap or squeeze or not prefix or not self.fallback or USER in self.kinds or UNUSED in self.kinds:
            raise ValueError("only merge-type models with the identity rule, a dummy prefix and byte fallback are supported")
        self.bos, self.eos, self.unk = (self.pieces.index(x) for x in ("<s>", "</s>", "<unk>"))
        self.byte_ids = [self.pieces.index(f"<0x{b:02X}>") for b in range(256)]
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == NORMAL}
        # Symbols are numbered by piece; characters that are no piece but part of one get numbers after these.
        chars = sorted({c for p in self.ids for c in p} - set(self.ids))
        self.symbol = {c: self.ids.get(c, 0) for p in self.ids for c in p} | {c: len(self.pieces) + i for i, c in enumerate(chars)}
        self.strange = len(self.pieces) + len(chars)  # any character that is in no piece
        self.symbol_of = np.full(0x110000, self.strange, np.int32)
        self.symbol_of[[ord(c) for c in self.symbol]] = list(self.symbol.values())
        order = sorted(self.ids.values(), key=lambda i: (-scores[i], i))
        same = {s: r for r, s in enumerate(sorted({-scores[i] for i in order}))}
        pairs = {}
        full = self.symbol | self.ids
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                a, b = full.get(p[:k]), full.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * (self.strange + 1) + b] = (same[-scores[i]], i)
        self.pairs = pairs
        keys = np.array(sorted(pairs), np.int64)
        self.pair_rank = np.array([pairs[k][0] for k in keys.tolist()] + [1 << 40], np.int64)
        self.pair_into = np.array([pairs[k][1] for k in keys.tolist()] + [0], np.int64)
        # An open-addressed table finds a pair in one or two looks.
        self.bits = (4 * len(keys)).bit_length()
        self.slot_key, self.slot_at = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, len(keys), np.int64)
        todo, at = np.arange(len(keys)), self._hash(keys)
        self.probes = 0
        while len(todo):
            self.probes += 1
            free = self.slot_key[at] == -1
            first = np.unique(np.where(free, at, -1), return_index=True)
            put = first[1][first[0] >= 0]
            self.slot_key[at[put]], self.slot_at[at[put]] = keys[todo[put]], todo[put]
            left = np.ones(len(todo), bool)
            left[put] = False
            todo, at = todo[left], (at[left] + 1) & ((1 << self.bits) - 1)
        long = [p for p in self.ids if len(p) > 1]
        alone = "".join(c for c in "\n\t\r\x0b\x0c" if not any(c in p for p in long))
        cut = re.escape(alone)
        self.units = re.compile(f"{BLANK}*[^{BLANK}{cut}]+|{BLANK}+" + (f"|[{cut}]" if alone else "")) if not any(BLANK in p.lstrip(BLANK) for p in long) else re.compile("(?s).+")
        self.text_of = [p.replace(BLANK, " ") if k == NORMAL else "" for p, k in zip(self.pieces, self.kinds)]
        self.text_of[self.unk] = " ⁇ "
        self.byte_of = {i: b for b, i in enumerate(self.byte_ids)}

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Where pair_rank and pair_into hold each pair; their last entry stands for none. Negative symbols have no pairs."""
        keys = left.astype(np.int64) * (self.strange + 1) + right
        keys[(left < 0) | (right < 0)] = -2
        at = self._hash(keys)
        found = self.slot_at[at]
        found[self.slot_key[at] != keys] = len(self.pair_rank) - 1
        miss = np.flatnonzero((self.slot_key[at] != keys) & (self.slot_key[at] != -1))
        for _ in range(self.probes):
            if not len(miss):
                break
            at[miss] = (at[miss] + 1) & ((1 << self.bits) - 1)
            same = self.slot_key[at[miss]] == keys[miss]
            found[miss[same]] = self.slot_at[at[miss[same]]]
            miss = miss[~same & (self.slot_key[at[miss]] != -1)]
        return found

    def ids_of(self, symbols: list[int], chars: str) -> list[int]:
        """Ids of the symbols left; chars: the character of each symbol that is no piece, else anything."""
        out: list[int] = []
        for s, c in zip(symbols, chars):
            out += [s] if s < len(self.pieces) else [self.byte_ids[b] for b in c.encode("utf-8", "surrogatepass")]
        return out

    def encode_unit(self, unit: str) -> list[int]:
        """Merges by an agenda of adjacent pairs, ordered by score and then position."""
        symbols = [self.symbol.get(c, self.strange) for c in unit]
        n, wide = len(symbols), self.strange + 1
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda: list[tuple[int, int, int, int, int]] = []

        def push(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (got := self.pairs.get(symbols[a] * wide + symbols[b])):
                heapq.heappush(agenda, (got[0], a, b, symbols[a] * wide + symbols[b], got[1]))

        for i in range(n - 1):
            push(i, i + 1)
        while agenda:
            _, a, b, pair, into = heapq.heappop(agenda)
            if symbols[a] < 0 or symbols[b] < 0 or after[a] != b or symbols[a] * wide + symbols[b] != pair:
                continue  # one of the two has been merged meanwhile
            symbols[a], symbols[b] = into, -1
            after[a] = after[b]
            if after[b] >= 0:
                before[after[b]] = a
            push(before[a], a)
            push(a, after[a])
        left = [i for i in range(n) if symbols[i] >= 0]
        return self.ids_of([symbols[i] for i in left], [unit[i] for i in left])

    def encode_units(self, units: list[str]) -> list[list[int]]:
        return [np.frombuffer(b, "<u4").tolist() for b in self.merged(units)[0]]

    def merged(self, units: list[str]) -> tuple[list[bytes], list[int]]:
        """encode_unit for units of at most STEP_CHARS characters each, one merge of every unit at a time.

        Ids as little-endian unsigned 32-bit integers, and which units have characters that became bytes.
        """
        out, with_bytes = [b""] * len(units), []
        by_length: dict[int, list[int]] = {}
        for i, u in enumerate(units):
            by_length.setdefault(-(-len(u) // 4) * 4, []).append(i)
        for width, members in by_length.items():
            lengths = np.array([len(units[i]) for i in members])
            symbols = np.full((len(members), width + 1), -1, np.int32)
            points = np.frombuffer("".join([units[i] for i in members]).encode("utf-32-le", "surrogatepass"), "<u4")
            symbols[:, :width][np.arange(width) < lengths[:, None]] = self.symbol_of[points]
            pair = self.look_up(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(len(members), width)
            rows = np.arange(len(members))
            done_rows, column = np.arange(len(members)), np.arange(width + 1)
            final = np.full_like(symbols, -1)
            while len(rows):
                rank = self.pair_rank[pair]
                best = rank.argmin(axis=1)
                on = rank[done_rows, best] < 1 << 40
                if not on.all():
                    final[rows[~on]] = symbols[~on]
                    rows, symbols, pair, best = rows[on], symbols[on], pair[on], best[on]
                    done_rows = np.arange(len(rows))
                    if not len(rows):
                        break
                symbols[done_rows, best] = self.pair_into[pair[done_rows, best]]
                # What stands right of the merged pair moves one place to the left.
                source = column[None, :] + (column[None, :] > best[:, None])
                source[:, -1] = width
                symbols = np.take_along_axis(symbols, source, axis=1)
                symbols[:, -1] = -1
                pair = np.take_along_axis(pair, np.minimum(source[:, :-1], width - 1), axis=1)
                pair[:, -1] = len(self.pair_rank) - 1
                for at in (best - 1, best):
                    ok = (at >= 0) & (at < width)
                    r, a = done_rows[ok], at[ok]
                    pair[r, a] = self.look_up(symbols[r, a], symbols[r, a + 1])
            ends = (final >= 0).sum(axis=1) * 4
            data, size = final.astype("<u4").tobytes(), 4 * (width + 1)
            for row, (i, end) in enumerate(zip(members, ends.tolist())):
                out[i] = data[row * size : row * size + end]
            for row in np.flatnonzero((final >= len(self.pieces)).any(axis=1)).tolist():
                i, at, ids = members[row], 0, []
                for s in final[row, : ends[row] // 4].tolist():
                    ids += self.ids_of([s], units[i][at])
                    at += len(self.pieces[s]) if s < len(self.pieces) else 1
                out[i] = struct.pack(f"<{len(ids)}I", *ids)
                with_bytes.append(i)
        return out, with_bytes

    def split(self, text: str) -> list[str]:
        """The units of a normalised text."""
        return self.units.findall(BLANK + text.replace(" ", BLANK)) if text else []

    def joined(self, ids: list[int]) -> str:
        """The pieces' texts, runs of bytes read as UTF-8."""
        text_of = self.text_of
        parts, run = [], bytearray()
        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                run.append(b)
                continue
            if run:
                parts.append(_utf8(bytes(run)))
                run.clear()
            parts.append(text_of[i])
        if run:
            parts.append(_utf8(bytes(run)))
        return "".join(parts)

    def decode(self, ids: list[int]) -> str:
        """Text of ids, special ones left out; the dummy prefix goes."""
        out = self.joined(ids) if self.bytes_in(ids) else "".join([self.text_of[i] for i in ids])
        # The prefix is the blank that begins the first piece, whatever that piece is.
        first = next((i for i in ids if self.kinds[i] != CONTROL), None)
        return out[1:] if first is not None and self.pieces[first].startswith(BLANK) else out

    def bytes_in(self, ids: list[int]) -> bool:
        return not self.byte_of.keys().isdisjoint(ids)


def _utf8(data: bytes) -> str:
    """Bytes as text; each byte that starts no valid character becomes U+FFFD, as the library has it."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(data):
            for n in (1, 2, 3, 4):
                try:
                    out.append(data[at : at + n].decode())
                    at += n
                    break
                except UnicodeDecodeError:
                    pass
            else:
                out.append("�")
                at += 1
        return "".join(out)


class Encoder:
    """A model with the memory of a process."""

    def __init__(self, data: bytes):
        import sentencepiece

        self.model, self.long = Model(data), set()
        #: unit: its ids as bytes. What `memory` lacks may be in `older`.
        self.memory, self.older = {}, {}
        #: The few units that don't decode to themselves, and what they decode to.
        self.odd: dict[str, str] = {}
        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)

    def _learn(self, units: set[str]) -> None:
        short, long = [u for u in units if len(u) <= STEP_CHARS], [u for u in units if len(u) > STEP_CHARS]
        found, odd = self.model.merged(short)
        self.memory.update(zip(short, found))
        self.memory.update((u, struct.pack(f"<{len(ids)}I", *ids)) for u, ids in zip(long, map(self.model.encode_unit, long)))
        # Merges join the texts of pieces, so only a unit with bytes may decode to something else. Its characters became
        # bytes whole, and no run of bytes goes on from one unit to the next.
        for u in [*(short[i] for i in odd), *long]:
            text = self.model.joined(np.frombuffer(self.memory[u], "<u4").tolist())
            if text != u.replace(BLANK, " "):
                self.odd[u] = text

    def encode(self, texts: list[str]) -> list[bytes]:
        return [ids for ids, _ in self.encode_decode(texts)]

    def encode_decode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """Ids of each text as little-endian unsigned 32-bit integers, with begin and end, and what they decode to.

        self.long: the texts with new long units.
        """
        self.long = set()
        model = self.model
        begin, end = (struct.pack("<I", x) for x in (model.bos, model.eos))
        out: list[tuple[bytes, str]] = []
        at = 0
        while at < len(texts):  # so many texts at once that their units surely fit the memory
            chars, split = 0, []
            while at < len(texts) and (not split or chars + len(texts[at]) <= MEMORY_UNITS // 2):
                chars += len(texts[at])
                split.append(model.split(texts[at]))
                at += 1
            used = set().union(*split)
            new = used - self.memory.keys()
            if new and len(self.memory) + len(new) > MEMORY_UNITS // 2:
                self.older, self.memory, new = self.memory, {}, used
                self.odd = {u: t for u, t in self.odd.items() if u in self.older}
            known = new & self.older.keys()
            self.memory.update((u, self.older[u]) for u in known)
            new -= known
            if new:
                self._learn(new)
                new = {u for u in new if len(u) > STEP_CHARS}
            if new:
                self.long.update(len(out) + i for i, units in enumerate(split) if not new.isdisjoint(units))
            memory = self.memory
            for units in split:
                odd = self.odd and not self.odd.keys().isdisjoint(units)
                text = "".join([self.odd.get(u, u) for u in units] if odd else units).replace(BLANK, " ")
                # The dummy prefix goes, as in Model.decode.
                prefixed = units and model.pieces[int.from_bytes(memory[units[0]][:4], "little")].startswith(BLANK)
                out.append((b"".join([begin, *[memory[u] for u in units], end]), text[1:] if prefixed else text))
        return out

    def check(self, text: str, ids: bytes, decoded: str) -> None:
        want = self.library.encode(text, add_bos=True, add_eos=True)
        if want != np.frombuffer(ids, "<u4").tolist() or self.library.decode(want) != decoded:
            raise ValueError(f"the library encodes or decodes a text otherwise: {text[:80]!r}")


@lru_cache(maxsize=2)
def _encoder(data: bytes) -> Encoder:
    return Encoder(data)


BATCH_BYTES = 8 << 20  # of texts that reach Python at once


def encoder_udf(data: bytes, with_ids: bool, with_text: bool):
    """A function from text to struct(n_tokens, ids_sha256, decoded_sha256[, ids][, decoded]). Null is an empty text.

    Results leave in pieces of 256 rows, so ids and texts of one piece are in memory, not those of a whole Arrow batch.
    """
    columns = ["n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids, *["decoded"] * with_text]

    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(data)
        for texts in batches:
            texts = ["" if t is None else t for t in texts]
            if not texts:
                yield pd.DataFrame([], columns=columns)
            checked = min(range(len(texts)), key=lambda i: zlib.crc32(texts[i].encode("utf-8", "surrogatepass")), default=None)
            for at in range(0, len(texts), 256):
                some, rows = texts[at : at + 256], []
                for i, (t, (ids, decoded)) in enumerate(zip(some, encoder.encode_decode(some))):
                    if at + i == checked or i in encoder.long:
                        encoder.check(t, ids, decoded)
                    row = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest())
                    rows.append((*row, *[np.frombuffer(ids, "<i4")] * with_ids, *[decoded] * with_text))
                yield pd.DataFrame(rows, columns=columns)

    return F.pandas_udf(encode, "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", decoded string" * with_text)


def model_bytes(path: str | None = None) -> bytes:
    """The model file, read on the driver (0.5 MB) and sent along with the function. Default: the public 32k model."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def encode_pieces(docs: DataFrame, text: str = "text", model: str | None = None, with_ids: bool = True, with_text: bool = True, into: str = "pieces") -> DataFrame:
    """docs with a struct column `into`: n_tokens, ids_sha256, decoded_sha256 and, unless switched off, ids and decoded.

    The session's Arrow batches are set to BATCH_BYTES, which bounds a worker's memory for texts of any length.
    Ids are those of the sentencepiece library with begin and end. Null and empty texts have these two ids only, and
    decode to an empty text. Texts are encoded whole. Of pairs with equal scores the leftmost goes first. Repeated rows are
    encoded alike; other columns stay as they are, but for one called `into`, which the result replaces. An empty table
    gives an empty result.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return docs.withColumn(into, encoder_udf(model_bytes(model), with_ids, with_text)(F.col(text)))


def op6_sentencepiece(spark, sf_dir):
    out = encode_pieces(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), with_ids=False, with_text=False)
    return out.select("doc_id", "pieces.*")


QUERIES = {"op6_sentencepiece": op6_sentencepiece}
SQL: dict[str, str] = {}
