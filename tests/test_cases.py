import pytest

from tests.cases import CASES
from tests.conftest import SF, assert_same_rows


@pytest.mark.parametrize("name", sorted(CASES))
def test_case(spark, duck, name):
    made, sql = CASES[name]
    assert_same_rows(made(spark, SF), duck, sql)
