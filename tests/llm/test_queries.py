import pytest

from tessel.llm.queries import ORACLE_SQL, QUERIES

from ..compare import connect, differences


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf, name):
    assert differences(spark, connect(sf), sf, name, QUERIES, ORACLE_SQL) == []


@pytest.mark.parametrize("n", range(1, 14))
def test_each_operator_has_a_query(n):
    assert sum(q.startswith(f"op{n}_") for q in QUERIES) == 1
