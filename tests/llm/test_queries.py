import pytest

from penumbra.llm import queries
from tests.test_queries import SF, compare, duck  # noqa: F401

pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, duck, name):  # noqa: F811
    compare(spark, duck, queries.QUERIES[name], queries.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, str(SF)).count() >= 0
