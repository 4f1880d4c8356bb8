import pytest

from poolwright.plans import catalogue
from tests.oracle import check


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_equals_its_sql(spark, data, name):
    check(catalogue.QUERIES[name](spark, data), catalogue.ORACLE[name], data)


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
