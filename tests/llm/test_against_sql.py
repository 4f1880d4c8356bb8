import pytest

from poolwright.llm.oracle import ORACLE
from poolwright.llm.queries import QUERIES
from tests.oracle import check


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, data, name):
    check(QUERIES[name](spark, data), ORACLE[name], data)
