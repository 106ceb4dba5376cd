"""Every query with SQL against DuckDB on a small scale, and the entry contract."""

import math

import duckdb
import pytest

import __spark_entry__
from lumenlint import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return db


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(columns), sorted(tuple(str(plain(r[i])) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    got = rows(df.columns, df.collect())
    if name in registry.oracle_sql():
        want = duck.sql(registry.oracle_sql()[name])
        assert got == rows(want.columns, want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
