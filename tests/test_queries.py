"""Every query against its SQL on the smallest tables."""

import pytest
from comparison import SMALL, duck_rows, spark_rows

from tessera import plans

plans.load()


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_sql(spark, name):
    assert spark_rows(plans.QUERIES[name](spark, SMALL)) == duck_rows(plans.SQL[name])


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_query_without_sql_runs(spark, name):
    assert plans.QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(plans.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
