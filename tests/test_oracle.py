"""Every query of the catalog against its SQL statement in DuckDB."""

import duckdb
import pytest

from rankloom.plans.catalog import QUERIES
from rankloom.plans.checks import ORACLE_SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck(root):
    connection = duckdb.connect()
    for name in TABLES.split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{root}/{name}.parquet'")
    return connection


def _plain(value):
    return value + 0.0 if isinstance(value, float) else value


def test_every_query_has_a_statement():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_statement(spark, duck, root, name):
    df = QUERIES[name](spark, root)
    columns = sorted(df.columns)
    got = sorted((tuple(_plain(row[c]) for c in columns) for row in df.collect()), key=repr)
    result = duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = sorted((tuple(_plain(row[i]) for i in order) for row in result.fetchall()), key=repr)
    assert got == want
