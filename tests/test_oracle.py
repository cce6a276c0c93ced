"""Every catalogue query against its SQL."""

import pytest
from oracle_check import compare, connect

from siftline.plans import catalog, oracle

SF_DIR = "/root/testdata/sf0.001"
QUERIES = catalog.queries()
SQL = oracle.oracle_sql()


@pytest.fixture(scope="module")
def db():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, db, name):
    assert compare(QUERIES[name](spark, SF_DIR), db, SQL[name]) is None


def test_entry(spark):
    import __spark_entry__ as spark_entry

    assert spark_entry.entry(spark).columns == ["total", "hot", "warm", "junk", "potential_rate"]
    assert spark_entry.entry(spark).first().total == 200
    assert set(QUERIES) <= set(spark_entry.queries()) and set(SQL) <= set(spark_entry.oracle_sql())
    assert set(spark_entry.oracle_sql()) <= set(spark_entry.queries())
