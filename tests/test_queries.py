"""Every named query against its SQL, on the smallest tables."""

import duckdb
import pytest

from skillweft.plans import registry

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
QUERIES, SQL = registry()


@pytest.fixture(scope="module")
def oracle(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    return tuple(v) if isinstance(v, list) else round(v, 5) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf, oracle, name):
    df = QUERIES[name](spark, sf)
    cur = oracle.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    at = [names.index(c) for c in df.columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in cur.fetchall()), key=str)
    assert sorted((tuple(map(plain, r)) for r in df.collect()), key=str) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_has_rows(spark, sf, name):
    rows = QUERIES[name](spark, sf).collect()
    assert rows
    if name == "pii_mask":
        assert all(r.restores for r in rows)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
