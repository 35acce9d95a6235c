"""Each registered query with SQL, on the smallest tables, against DuckDB."""

import math

import duckdb
import pytest

from groundswell.plans import catalogue, oracles, queries

DIR = "/root/testdata/sf0.001"
TABLES = "nation customer supplier part orders lineitem events embeddings".split()
QUERIES = queries.queries() | catalogue.queries()
SQL = oracles.oracle_sql() | catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def plain(rows):
    fix = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else round(float(v), 9) if isinstance(v, float) else v
    return sorted([tuple(fix(v) for v in r) for r in rows], key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DIR)
    cols = sorted(got.columns)
    rows = [tuple(r) for r in got.select(*cols).collect()]
    assert rows
    sql = SQL.get(name)
    if sql:
        found = duck.execute(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall()
        assert plain(rows) == plain(found)
