import pytest
from oracle import compare, connect

from chronoloom.plans import catalog

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    query, sql = catalog.queries()[name], catalog.oracles().get(name)
    if sql:
        compare(spark, con, query, sql, SMALL)
    else:
        assert query(spark, SMALL).count() >= 0
