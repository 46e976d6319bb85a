"""Each query against its SQL in DuckDB, over the smallest supplied tables."""

import math

import duckdb
import pytest

from tessella import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(x):
        if isinstance(x, float):
            return "null" if math.isnan(x) else f"{x:.6g}"
        return "null" if x is None else str(x)

    return sorted(tuple(value(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, sf, duck, name):
    df = catalog.queries()[name](spark, sf)
    got = canonical([tuple(r) for r in df.collect()], df.columns)
    cursor = duck.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == canonical(cursor.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_runs(spark, sf, name):
    assert catalog.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(catalog.queries()) <= set(entry.queries())


def test_partitioning_does_not_matter(spark, sf):
    from tessella.operators import cleaning
    from tessella.plans import views

    pages = views.pages(spark, sf)
    one = cleaning.drop_exact_duplicates(pages.coalesce(1)).orderBy("ord").collect()
    many = cleaning.drop_exact_duplicates(pages.repartition(7)).orderBy("ord").collect()
    assert one == many
