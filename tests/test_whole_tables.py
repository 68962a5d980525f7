"""Lookups, deletions and positional writes over all rows of their tables, against SQL without filters."""

import duckdb
import pytest
from comparison import SMALL, duck_rows, spark_rows

from tessera import plans

plans.load()
WHOLE = {
    "point_lookup": "SELECT o_orderkey AS key, o_orderpriority AS value FROM orders",
    "deleted_objects": """WITH k AS (SELECT c_custkey AS key FROM customer UNION ALL SELECT c_custkey + 100000000 FROM customer WHERE c_custkey % 7 = 0)
SELECT key, key IN (SELECT o_custkey FROM orders) AS existed FROM k""",
    "positional_writes": """WITH v AS (SELECT n_nationkey, hex(n_name) AS h FROM nation)
SELECT lower(hex(n_nationkey::VARCHAR)) AS file, h[1:4] || '5858' || h[9:] || repeat('0', greatest(20 - len(h), 0)) AS data FROM v""",
}


@pytest.mark.parametrize("name", sorted(WHOLE))
def test_every_row_counts(spark, name):
    names, rows = spark_rows(plans.QUERIES[name](spark, SMALL))
    assert (names, rows) == duck_rows(WHOLE[name])
    if name == "deleted_objects":
        assert {r[names.index("existed")] for r in rows} == {False, True}


def test_long_names_are_written(spark, tmp_path):
    names = ["FIJI", "TEN LETTER", "UNITED KINGDOM", "SAO TOME AND PRINCIPE"]
    duckdb.execute(f"COPY (SELECT i::BIGINT AS n_nationkey, ({names!r})[i + 1] AS n_name FROM range({len(names)}) t(i)) TO '{tmp_path}/nation.parquet' (FORMAT parquet)")
    got = spark_rows(plans.QUERIES["positional_writes"](spark, str(tmp_path)))
    assert got == duck_rows(WHOLE["positional_writes"], str(tmp_path)) and len(got[1]) == len(names)
