"""Every query with SQL against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from tensorloom.plans.catalog import oracle_sql, queries
from tests.conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, float):
        return f"{v + 0.0:.6g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = queries()[name](spark, DATA)
    got, columns = df.collect(), sorted(df.columns)
    result = duck.execute(oracle_sql()[name])
    names = [x[0] for x in result.description]
    assert columns == sorted(names)
    a = sorted(tuple(plain(r[c]) for c in columns) for r in got)
    b = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall())
    assert a == b


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_query_without_sql_runs(spark, name):
    rows = queries()[name](spark, DATA).collect()
    assert rows
    for column in {"loss", "p", "p_adjusted"} & set(rows[0].asDict()):
        assert all(0 <= r[column] <= 1 for r in rows)
    if "loss" in rows[0]:
        assert min(r.loss for r in rows) < 0.9
