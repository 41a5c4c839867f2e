"""Every query of the registry against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from rowloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    return c


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, data, name):
    df = registry.QUERIES[name](spark, data)
    rows = df.collect()
    if name not in registry.ORACLE:
        return
    want = con.sql(registry.ORACLE[name])
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    at = [want.columns.index(c) for c in names]
    assert sorted((tuple(plain(r[c]) for c in names) for r in rows), key=repr) == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_entry_needs_nothing_else(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
