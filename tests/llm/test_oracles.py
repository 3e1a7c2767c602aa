import pytest

from lectern.llm import queries
from tests.oracle import agrees


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_its_sql(spark, name):
    agrees(spark, queries.QUERIES[name], queries.ORACLE[name])
