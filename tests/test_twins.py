import pytest

from lumenframe.plans.queries import ORACLES, QUERIES
from tests.twins import DATA, database, same


@pytest.fixture(scope="module")
def con():
    return database()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    assert same(QUERIES[name](spark, DATA), ORACLES[name], con) > 0


def test_every_key_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(ORACLES) <= set(QUERIES)


def test_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
