"""Every catalogue query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__
from shelf.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    show = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert show(df.select(*columns).collect()) == show(want.select(*map(duckdb.ColumnExpression, columns)).fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLE_SQL) <= set(__spark_entry__.oracle_sql())
