import pytest

from spendlake import registry
from tests import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, name):
    assert compare.rows(registry.QUERIES[name](spark, SF).toPandas()) == compare.rows(compare.oracle(SF, registry.SQL[name]))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
