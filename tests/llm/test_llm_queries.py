"""The registered queries: their columns, and their SQL run by DuckDB."""

import math

import duckdb
import pytest

from lumenlint.llm import registry

SF = "/root/testdata/sf0.001"
COLUMNS = {
    1: "doc_id bigint, held_out boolean, score double, predicted int",
    2: "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string",
    3: "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    4: "doc_id bigint, held_out boolean, lang_pred string, score double",
    5: "doc_id bigint, fingerprint string, component_id bigint",
    6: "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    7: "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    8: "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    9: "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    10: "page_id bigint, host string, path string, rule string, verdict string",
}


@pytest.mark.parametrize("name", sorted(registry.queries(), key=lambda q: int(q[2:].split("_")[0])))
def test_query(spark, name):
    out = registry.queries()[name](spark, SF)
    types = dict(out.dtypes)
    for column in COLUMNS[int(name[2:].split("_")[0])].split(", "):
        c, t = column.split()
        assert types[c] == t, column
    table = "pages" if name.startswith("op10") else "documents"
    rows = [r.asDict() for r in out.collect()]
    assert len(rows) == spark.read.parquet(f"{SF}/{table}.parquet").count()
    sql = registry.oracle_sql().get(name)
    if sql:
        db = duckdb.connect()
        for t in ("documents", "pages", "labels"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        got = db.execute(sql)
        names = [d[0] for d in got.description]
        assert set(names) == set(types)
        plain = lambda r: tuple(round(r[c], 6) if isinstance(r[c], float) and math.isfinite(r[c]) else r[c] for c in sorted(names))
        assert sorted(map(plain, rows), key=str) == sorted((plain(dict(zip(names, r))) for r in got.fetchall()), key=str)
