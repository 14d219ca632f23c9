"""The queries of this folder that have SQL, against DuckDB over the same tables."""

import duckdb
import pytest
from tidemark.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equal_rows(spark, medium, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{medium}/{t}.parquet')")
    df = queries.QUERIES[name](spark, medium)
    cursor = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    got = sorted(map(tuple, df.select(*columns).collect()), key=repr)
    assert got == sorted(cursor.fetchall(), key=repr) and got and set(columns) == set(df.columns)
