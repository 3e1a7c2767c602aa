import pytest

from lectern.plans import registry
from tests.oracle import agrees


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_matches_its_sql(spark, name):
    agrees(spark, registry.QUERIES[name], registry.ORACLE[name])
