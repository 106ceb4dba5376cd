"""Quality rules as a bitmask ledger.

`measure` evaluates every rule once: it keeps the measurements and one failure bit per rule. A policy is a versioned mask
of the bits that count. Applying a policy, or comparing policies, reads the ledger only: `mask & policy = 0`. `ablations`
counts the distinct masks (at most 2 ** rules of them, whatever the number of documents) and derives from these what each
rule rejects, and what it alone rejects.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, spread, table

_WORD = re.compile(WORD)
#: A word without any letter. Letters are A-Z, a-z and all characters from U+00C0 on.
_NO_LETTER = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0DA-Za-zÀ-\U0010FFFF]+(?![^\x20\x09-\x0D])")
_BLANK = np.array([9, 10, 11, 12, 13, 32])
_SYMBOL = np.frombuffer(b"#*$%&|<>", np.uint8)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_no_letter", "n_upper", "n_latin", "n_bangs")
#: (name, the rule's failure over the measures), in the order of the bits. Append only: a bit keeps its meaning.
RULES = (
    ("too_short", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "10 * n_dup_lines > 6 * n_lines"),
    ("words_without_letters", "10 * n_no_letter > 2 * n_words"),
    ("capitals", "10 * n_upper > 3 * n_latin"),
    ("exclamations", "3 * n_bangs > n_words"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
)
BITS = {name: 1 << i for i, (name, _) in enumerate(RULES)}
#: Versioned policies: the bits that reject a document. A version never changes once published.
POLICIES = {"base-1": ("too_short", "repeated_windows"), "full-1": tuple(BITS)}


def repeat_words(ids: np.ndarray, width: int = 8) -> int:
    """Words that lie in a window of `width` (a power of 2) words found twice or more. Exact: windows get ids by doubling."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    span = 1
    while span < width:
        ids = np.unique(ids[:-span] * (len(ids) + 1) + ids[span:], return_inverse=True)[1]
        span *= 2
    again = np.bincount(ids)[ids] > 1
    if not again.any():
        return 0
    edges = np.zeros(n + width, np.int64)
    at = np.flatnonzero(again)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + width, -1)
    return int((np.cumsum(edges) > 0).sum())


def measures_of(text: str | None) -> tuple[int, ...]:
    """The measures of one whole text, in the order of MEASURES. Null is an empty text."""
    text = text or ""
    words = _WORD.findall(text)
    seen: dict[str, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    count = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    upper = int(count[65:91].sum())
    return (
        len(words),
        len(text) - int(count[_BLANK].sum()),
        int(count[_SYMBOL].sum()),
        len(lines) - len(set(lines)),
        repeat_words(ids) if len(seen) < len(words) else 0,
        len(lines),
        len(_NO_LETTER.findall(text)),
        upper,
        upper + int(count[97:123].sum()),
        int(count[33]),
    )


def _measured(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        yield pd.DataFrame([measures_of(t) for t in texts], columns=list(MEASURES), dtype="int64")


def failure_bits(m: str) -> Column:
    """The failure mask over the struct column m of measures."""
    fails = lambda rule: re.sub(r"\b(n_\w+|word_chars)\b", rf"{m}.\1", rule)
    return sum((F.when(F.expr(fails(rule)), F.lit(BITS[name])).otherwise(0) for name, rule in RULES), F.lit(0)).cast("long")


def ledger(docs: DataFrame, text: str = "text", into: str = "quality_ledger") -> DataFrame:
    """docs with a struct column `into`: every measure, and `mask` with a bit for each rule that fails.

    Every row gets a ledger entry: null and empty texts measure 0 everywhere and fail too_short. Texts are read whole.
    Repeated rows are measured alike. Other columns stay as they are, but for one called `into`, which the result
    replaces. There are no ties. An empty table gives an empty result.
    """
    measured = docs.withColumn(into, F.pandas_udf(_measured, ", ".join(f"{m} long" for m in MEASURES))(F.col(text)))
    return measured.withColumn(into, F.col(into).withField("mask", failure_bits(into)))


def passes(mask: Column, policy: str) -> Column:
    """True where no bit of the policy is set in the mask."""
    return mask.bitwiseAND(F.lit(sum(BITS[r] for r in POLICIES[policy]))) == 0


def ablations(ledgers: DataFrame, policy: str, into: str = "quality_ledger") -> DataFrame:
    """rule, failed, rejected_alone (documents that would stay without this rule), rejected, rows, of one policy."""
    chosen = sum(BITS[r] for r in POLICIES[policy])
    masks = ledgers.groupBy(F.col(into)["mask"].bitwiseAND(F.lit(chosen)).alias("mask")).agg(F.count("*").alias("n"))
    bits = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BITS[r]).cast("long").alias("bit")) for r in POLICIES[policy]])
    n_if = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    each = masks.select("mask", "n", F.explode(bits).alias("r")).select("mask", "n", "r.rule", "r.bit")
    return each.groupBy("rule").agg(n_if(F.col("mask").bitwiseAND(F.col("bit")) != 0).alias("failed"), n_if(F.col("mask") == F.col("bit")).alias("rejected_alone"), n_if(F.col("mask") != 0).alias("rejected"), F.sum("n").alias("rows"))


def op3_quality_rules(spark, sf_dir):
    out = ledger(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    m = F.col("quality_ledger")
    return out.select("doc_id", *[m[x].alias(x) for x in MEASURES[:5]], (~passes(m["mask"], "base-1")).alias("base_failed"), passes(m["mask"], "full-1").alias("kept"), m["mask"].alias("failure_mask"))


QUERIES = {"op3_quality_rules": op3_quality_rules}
_MEASURED_SQL = r"""
d AS (SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
      list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, w FROM d WHERE len(w) >= 9),
grp AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + 7], ' ')) AS c FROM win),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM grp WHERE c > 1) GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda v: length(v))), 0)::BIGINT AS word_chars,
      len(regexp_extract_all(x, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
      coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines,
      len(list_filter(w, lambda v: NOT regexp_matches(v, '[A-Za-z\x{C0}-\x{10FFFF}]'))) AS n_no_letter,
      len(regexp_extract_all(x, '[A-Z]')) AS n_upper, len(regexp_extract_all(x, '[A-Za-z]')) AS n_latin, len(regexp_extract_all(x, '!')) AS n_bangs
      FROM d LEFT JOIN rep USING (doc_id))"""
_MASK_SQL = " + ".join(f"CASE WHEN {rule} THEN {BITS[name]} ELSE 0 END" for name, rule in RULES)
SQL = {
    "op3_quality_rules": f"""WITH {_MEASURED_SQL}, k AS (SELECT *, ({_MASK_SQL})::BIGINT AS failure_mask FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failure_mask & 3 <> 0 AS base_failed, failure_mask = 0 AS kept, failure_mask FROM k"""
}
