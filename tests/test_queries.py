"""Every query with SQL against DuckDB on the same small tables; the others run and give rows."""

import os

import duckdb
import pytest

from studylake import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = plans.queries(), plans.oracle_sql()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for name in TABLES:
        if os.path.exists(f"{small}/{name}.parquet"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    return con


def plain(value):
    if value is None or str(value) in ("nan", "NaT", "<NA>"):
        return "NULL"
    if isinstance(value, float) and value == int(value):
        return str(int(value))
    return str(value)


def rows(frame, columns):
    return sorted(tuple(map(plain, r)) for r in frame[columns].astype(object).values.tolist())


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_equals_sql(spark, small, duck, name):
    got, want = QUERIES[name](spark, small).toPandas(), duck.execute(SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert rows(got, columns) == rows(want, columns)


#: Queries that may be empty on the smallest tables.
MAY_BE_EMPTY = {"f7_subsumed", "f8_duplicate_questions", "a10_catalogue"}


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL])
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0 or name in MAY_BE_EMPTY


def test_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)
