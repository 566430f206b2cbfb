"""Registered queries of the engine against their SQL, over the smallest tables."""

import duckdb
import pytest

from seqlattice.plans import registry

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def compare(spark, folder, query, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    found = query(spark, folder)
    cols = sorted(found.columns)
    got = sorted((tuple(r[c] for c in cols) for r in found.collect()), key=str)
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(r[names.index(c)] for c in cols) for r in cur.fetchall()), key=str)
    assert got == want


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_sql(spark, small, name):
    compare(spark, small, registry.QUERIES[name], registry.ORACLE_SQL[name])
