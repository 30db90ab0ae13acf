import pytest

from tessel.plans.queries import ORACLE_SQL, QUERIES

from .compare import connect, differences


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, con, sf, name):
    assert differences(spark, con, sf, name, QUERIES, ORACLE_SQL) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_has_rows(spark, sf, name):
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert df.count() > 0
