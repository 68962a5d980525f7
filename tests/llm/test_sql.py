"""Registered queries against SQL on the smallest tables."""

import pytest
from comparison import SMALL, duck_rows, spark_rows

from tessera.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert spark_rows(queries.queries()[name](spark, SMALL)) == duck_rows(queries.oracle_sql()[name])


def test_each_operator_has_a_query():
    assert sorted({int(n[2:].split("_")[0]) for n in queries.queries()}) == list(range(1, 11))
