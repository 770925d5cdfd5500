"""Every query with SQL gives what the SQL gives on the smallest tables."""

import duckdb
import pytest

from tessera.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def ordered(rows):
    return sorted(rows, key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    found = duck.execute(catalog.ORACLE[name])
    names = [c[0] for c in found.description]
    columns = sorted(df.columns)
    assert sorted(names) == columns
    assert ordered(tuple(r[c] for c in columns) for r in df.collect()) == ordered(tuple(r[names.index(c)] for c in columns) for r in found.fetchall())
