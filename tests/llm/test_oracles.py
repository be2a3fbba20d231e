import pytest

from tallyframe.llm import registry
from tests.conftest import SF, assert_same_rows


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    assert_same_rows(registry.QUERIES[name](spark, SF), duck, registry.ORACLE_SQL[name])
