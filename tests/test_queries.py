import pytest

from brindle.plans import registry
from tests.oracle import compare

NAMES = sorted(registry.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, name):
    compare(spark, registry.queries()[name], registry.oracle_sql()[name])


def test_every_oracle_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
