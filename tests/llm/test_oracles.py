"""Queries of this folder that have SQL give what it gives on the smallest tables."""

import duckdb
import pytest

from tessera.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    found = con.execute(queries.ORACLE[name])
    names = [c[0] for c in found.description]
    rows = queries.QUERIES[name](spark, DATA).select(*names).collect()
    key = lambda r: [(v is None, str(v)) for v in r]
    assert sorted(map(tuple, rows), key=key) == sorted(found.fetchall(), key=key)
