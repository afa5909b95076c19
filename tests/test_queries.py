import sys, os
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

"""Every core query runs on the smallest tables and, where it has SQL, gives the same rows."""

import pytest
from oracle import SF, connect, same

from tarnstone import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    same(spark, QUERIES, SQL, name, con)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert len(df.columns) == len(set(df.columns))
    df.count()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
