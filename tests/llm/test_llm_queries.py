import pytest

from seqlake.llm import queries

from ..duck import assert_same, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, con, name):
    assert_same(queries.queries()[name](spark, SF), con, queries.oracle_sql()[name])
