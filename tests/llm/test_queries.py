import pytest

from brindle.llm import registry
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    compare(spark, registry.queries()[name], registry.oracle_sql()[name])
