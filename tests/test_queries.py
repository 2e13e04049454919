"""Every query against its SQL in DuckDB, on the same tables."""

import math

import duckdb
import pytest

from jobweave import queries

ROOT = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{ROOT}/{t}.parquet'")
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = queries.queries()[name](spark, ROOT)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = duck.execute(queries.oracle_sql()[name])
    want = rows_of([d[0] for d in result.description], result.fetchall())
    assert got[0] == want[0]
    assert want[1] and got[1] == want[1]


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_query_without_sql_gives_rows(spark, name):
    assert queries.queries()[name](spark, ROOT).count() > 0
