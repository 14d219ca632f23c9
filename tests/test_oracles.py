"""Every query that has SQL, against DuckDB over the same tables."""

import duckdb
import pytest

from tidemark.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(medium):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{medium}/{t}.parquet')")
    return con


def normal(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return [columns[i] for i in order], sorted((tuple(r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equal_rows(spark, duck, medium, name):
    df = catalog.QUERIES[name](spark, medium)
    got = normal(map(tuple, df.collect()), df.columns)
    cursor = duck.execute(catalog.ORACLES[name])
    want = normal(cursor.fetchall(), [d[0] for d in cursor.description])
    assert got == want and got[1]


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_queries_without_sql_give_rows(spark, medium, name):
    assert catalog.QUERIES[name](spark, medium).count() > 0


def test_names_match():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
