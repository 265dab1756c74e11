import pytest

from granary.plans import catalogue
from tests.conftest import SF


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, same, name):
    same(catalogue.QUERIES[name](spark, SF), catalogue.ORACLE_SQL[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
