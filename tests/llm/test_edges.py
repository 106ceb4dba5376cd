"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumenlint.llm import exact_dedup, langid, line_dedup, mixing, pieces, quality, sharding, simhash, toxicity, urls
from lumenlint.llm.registry import queries

LONG = " ".join(f"word{i}x{i * 7919 % 1013}" for i in range(30_000))
PASSAGE = "A line that many documents share."
DOCS = [
    (1, "Alpha beta gamma delta epsilon.\n" + PASSAGE, "en", "s1"),
    (2, None, None, None),
    (3, "", "en", ""),
    (4, LONG, "en", "s1"),
    (5, PASSAGE + "\nown words of five", "de", "s2"),
    (5, PASSAGE + "\nown words of five", "de", "s2"),
    (None, "alpha BETA gamma delta epsilon.\n" + PASSAGE.upper(), None, "s2"),
    (7, "alpha beta gamma delta epsilon.\n  " + PASSAGE + "\t", "fr", None),
    (8, " \t\n\x0b \n", "fr", "s3"),
    (9, "1234 5678 !!", "fr", "s3"),
]


@pytest.fixture(scope="module")
def docs(spark):
    # columns named like those the operators use inside
    return spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string").withColumns({c: F.lit(1) for c in ("size", "key", "shard", "fp", "o", "t", "lines", "hub", "row_id", "n_chars", "slot", "label", "score")})


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_exact_dedup(docs, none):
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs).collect()}
    assert (2, 3, 2, False) in got and (3, 3, 2, True) in got and (1, 1, 2, True) in got and (5, 5, 2, True) in got and (5, 5, 2, False) in got
    assert (None, 1, 2, False) in got
    assert exact_dedup.exact_dedup(none).count() == 0


def test_exact_dedup_keeps_the_largest_id_before_null(spark):
    same = spark.createDataFrame([(None, "X"), (1, "x"), (4, "X")], "doc_id long, text string")
    assert {(r.doc_id, r.keep_id, r.kept) for r in exact_dedup.exact_dedup(same).collect()} == {(None, 4, False), (1, 4, False), (4, 4, True)}


def test_line_dedup(docs, none):
    out = {}
    for r in line_dedup.dedup_lines(docs, into="cut").collect():
        out.setdefault(r.doc_id, []).append(r)
    assert out[1][0].cut.n_dropped == 0 and out[1][0].cut.n_lines == 2
    assert out[2][0].cut.text == "" and out[2][0].cut.n_lines == 1 and out[3][0].cut.n_lines == 1
    assert [r.cut.text for r in out[5]] == ["own words of five"] * 2
    assert out[None][0].cut.text == "" and out[7][0].cut.text == "" and out[7][0].cut.n_dropped == 2
    assert out[8][0].cut.text == DOCS[8][1] and out[4][0].cut.text == LONG
    assert line_dedup.dedup_lines(none).count() == 0


def test_line_dedup_with_a_shard_for_each_key(docs):
    rows = lambda df: sorted((str(r.doc_id), r.cut.text, r.cut.n_dropped) for r in df.collect())
    assert rows(line_dedup.dedup_lines(docs, into="cut")) == rows(line_dedup.dedup_lines(docs, shard_keys=1, into="cut"))


def test_line_dedup_keeps_the_callers_columns(spark):
    names = ("n_lines", "n_dropped", "__o", "__t", "__drops", "drops", "row", "o", "t", "key", "maybe", "a.b")
    docs = spark.createDataFrame([(1, PASSAGE), (2, PASSAGE + "\nx")], "doc_id long, text string").withColumns({c: F.lit(f"own {c}") for c in names})
    got = line_dedup.dedup_lines(docs).orderBy("doc_id").collect()
    assert [[r[c] for c in names] for r in got] == [[f"own {c}" for c in names]] * 2
    assert [(r.lines.text, r.lines.n_lines, r.lines.n_dropped) for r in got] == [(PASSAGE, 1, 0), ("x", 2, 1)]


def test_quality(docs, none):
    got = {r.doc_id: r.quality_ledger for r in quality.ledger(docs).collect()}
    assert got[2].n_words == 0 and got[2].mask == quality.BITS["too_short"] == got[3].mask
    assert got[4].n_words == 30_000 and got[4].mask == 0
    assert got[9].n_no_letter == 3
    assert quality.ledger(none).count() == 0


def test_langid(docs, none):
    net = langid.learn(docs, max_docs=50, steps=4, batch=8, length=16)
    got = {r.doc_id: r.language for r in langid.identify(docs, net).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (2, 3, 8, 9))
    assert got[4].lang_pred in ("en", "de", "fr") and 0 < got[4].score <= 1
    assert langid.learn(none) is None
    assert {r.language.lang_pred for r in langid.identify(docs, None).collect()} == {"und"}
    assert langid.identify(none, net).count() == 0


def test_simhash(docs, none):
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()]
    zero = {g for g in got if g[1] == "0" * 16}
    assert {g[0] for g in zero} == {2, 3, 8} and {g[2] for g in zero} == {2}
    assert len([g for g in got if g[0] == 5]) == 2
    by = {g[0]: g for g in got}
    assert by[None][1:] == by[1][1:] == by[7][1:] and by[1][2] == 1
    assert simhash.near_duplicates(none).count() == 0


def test_pieces(docs, none):
    got = {r.doc_id: r.pieces for r in pieces.encode_pieces(docs).collect()}
    assert got[2].ids == [1, 2] == got[3].ids and got[2].decoded == ""
    assert got[4].decoded == LONG and got[8].decoded == DOCS[8][1]
    assert got[2].ids_sha256 == hashlib.sha256(b"\1\0\0\0\2\0\0\0").hexdigest()
    assert pieces.encode_pieces(none).count() == 0


def test_sharding(docs, none):
    rows = sharding.shard(docs, shards=3).collect()
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert sorted(map(len, slots.values())) == [3, 3, 4] and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {(r.doc_id, r.size, r.text_crc32) for r in rows} == {(d[0], len((d[1] or "").encode()) + 8, zlib.crc32((d[1] or "").encode())) for d in DOCS}
    assert sharding.shard(none).count() == 0


def test_mixing(docs, none):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(DOCS) and all(0 <= r.taken <= 3 * r.size for r in rows)
    assert {r.source: r.source_size for r in rows}[None] == 11
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs).collect()))
    assert mixing.mix(none).count() == 0
    assert {r.taken for r in mixing.mix(docs.filter("doc_id IN (2, 3, 8)")).collect()} == {0}


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(i, i % 2) for i in (1, 2, 3, 4, 5, 7)] + [(1, None), (None, 1), (3, 0)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, labels).collect()
    assert len(got) == len(DOCS) and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
    assert {r.score for r in toxicity.score_toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.score_toxicity(none, labels).count() == 0


def test_urls(spark):
    model = urls.UrlModel(urls.seed())
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "HTTP://A.Example.COM/en/7?x"), (5, "http://example.net/de/81"), (6, "x://net/de/://b"), (7, "http://com"), (7, "http://com"), (8, "http://" + "a" * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({"host": F.lit("h"), "rule": F.lit("r"), "score": F.lit(1)})
    got = {r.page_id: r["filter"] for r in urls.judge(pages, urls.RULES, model).collect()}
    assert all(got[i].host == got[i].path == "" and got[i].rule is None for i in (1, 2, 3))
    assert (got[4].host, got[4].path, got[4].rule, got[4].verdict) == ("a.example.com", "/en/7", "example.com/en/7", "allow")
    assert (got[5].rule, got[5].verdict) == ("example.net/de/8", "block")
    assert (got[6].host, got[6].path, got[6].rule, got[6].verdict) == ("net", "/de/:", "net/de/", "allow") or got[6].path == "/de/://b"
    assert (got[7].host, got[7].path) == ("com", "")
    assert urls.judge(pages.limit(0), urls.RULES, model).count() == 0
    assert urls.UrlModel([]).score(["http://a.b/"]).tolist() == [0.0]


def test_pipeline_stages(docs, none, spark):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, "").count() == 0, name
        out = stage(spark, docs, "")
        if name != "encode":
            assert out.columns == docs.columns
            out.collect()


def test_pipeline_stages_keep_the_callers_columns(spark):
    names = ("n_lines", "n_dropped", "lines", "ledger", "__ledger", "__kept", "__id", "__copies", "pieces", "row", "id", "gone", "taken", "size", "maybe", "col", "a.b")
    body = " ".join(f"word{i} of a sentence that is long enough" for i in range(12))
    rows = [(1, PASSAGE + "\n" + body, "s"), (2, PASSAGE + "\n" + body.replace("sentence", "phrase"), "s"), (3, body, "s"), (None, body[::-1], "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(f"own {c}") for c in names})
    got = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, got, "")
        assert got.columns == docs.columns
        assert {tuple(r[c] for c in names) for r in got.collect()} <= {tuple(f"own {c}" for c in names)}, name
    assert corpus_pipeline.STAGES[-1][1](spark, got, "").columns == ["doc_id", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]


def test_pipeline_mix_takes_repeats_and_null_ids_one_by_one(spark):
    """The stage's words of each source are those mix takes, whatever rows repeat."""
    rows = [(i % 4 if i % 3 else None, " ".join(f"w{j}" for j in range(5 + i % 2)), "ab"[i % 5 > 0]) for i in range(60)] + [(None, None, None), (9, "", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = {r.source: r.n for r in mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("n")).collect() if r.n}
    got = {}
    for r in corpus_pipeline.mix_sources(spark, docs, "").collect():
        got[r.source] = got.get(r.source, 0) + len(r.text.split())
    assert got == want and sum(want.values()) > 250


def test_one_query_for_each_operator():
    assert {int(q[2:].split("_")[0]) for q in queries()} == set(range(1, 11))


