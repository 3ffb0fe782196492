import pytest

from corpusloom.plans import catalog
from tests import oracle

ALL, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def connection(data):
    return oracle.connect(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, data, connection, name):
    oracle.same(ALL[name](spark, data), connection, SQL[name])


@pytest.mark.parametrize("name", sorted(set(ALL) - set(SQL)))
def test_has_rows(spark, data, name):
    assert ALL[name](spark, data).count() > 0
