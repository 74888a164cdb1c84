"""Every query with SQL gives the rows that DuckDB gives."""

import duckdb
import pytest

from codeweft import catalog as queries

#: The second is for queries that find nothing in the first.
SF_DIRS = ("/root/testdata/sf0.001", "/root/testdata/sf0.01")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")


@pytest.fixture(scope="module")
def dbs():
    out = {}
    for folder in SF_DIRS:
        out[folder] = duckdb.connect()
        for t in TABLES:
            out[folder].execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return out


def rows(names, values):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(str(v[k]) for k in order) for v in values))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows(spark, dbs, name):
    for folder, db in dbs.items():
        df = queries.QUERIES[name](spark, folder)
        want = db.sql(queries.SQL[name])
        assert sorted(df.columns) == sorted(want.columns)
        got = rows(df.columns, df.collect())
        assert got == rows(want.columns, want.fetchall())
        if got:
            return
    raise AssertionError("nothing is found in either")
