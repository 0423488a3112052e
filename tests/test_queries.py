"""Every registered query against its SQL, and plan rules that hold for all of them."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from tools.compare import TABLES, compare

QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def database(small):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet'")
    return con


def no_pair_products(plan):
    """No cross join in any form, and no row-at-a-time Python."""
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert operator not in plan, plan


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, small, database, name):
    verdict = compare(spark, database, name, small, no_pair_products)
    assert not verdict.startswith("FAIL"), verdict


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_has_rows(spark):
    assert entry_module.entry(spark).count() > 0
