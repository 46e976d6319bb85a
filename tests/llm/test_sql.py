"""The corpus queries that SQL can express, against it."""

import duckdb
import pytest

from tessella.llm import registry

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = registry.queries()[name](spark, sf)
    cursor = con.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(str([r[columns.index(c)] for c in sorted(columns)]) for r in cursor.fetchall())
    assert sorted(str([r[c] for c in sorted(columns)]) for r in df.collect()) == want
