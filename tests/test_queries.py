"""Every registered query on the smallest tables: rows equal the SQL, and the plan has no cross join."""

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SF
from tools.check import TABLES, rows_of

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    got, columns = rows_of(df.columns, df.collect())
    assert got
    if name in SQL:
        duck.execute(SQL[name])
        names = [d[0] for d in duck.description]
        want, wanted = rows_of(names, duck.fetchall())
        assert columns == wanted
        assert got == want


def test_entry(spark):
    assert entry.entry(spark).columns[:3] == ["dump_id", "trigger", "center_ms"]


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
