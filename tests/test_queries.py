import pytest

import __spark_entry__ as entry
from roadgrain.plans import registry
from tests.oracle import compare, connect

SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, data, con, name):
    compare(registry.queries()[name](spark, data), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_query_runs(spark, data, name):
    df = registry.queries()[name](spark, data)
    assert df.columns
    df.write.format("noop").mode("overwrite").save()


def test_entry(spark, data):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
