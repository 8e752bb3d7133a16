import pytest
from codeloom.queries import ORACLES, QUERIES
from tests.oracle import connection, same


@pytest.fixture(scope="module")
def con():
    return connection()


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLES.keys()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    same(spark, con, QUERIES[name], ORACLES[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(ORACLES) <= set(e.oracle_sql()) <= set(e.queries())
