import pytest
from pyspark.sql import functions as F

from tessera.operators import prefix


def requests(spark, *lists, model="test-model"):
    return spark.createDataFrame([(str(i), model, list(t)) for i, t in enumerate(lists)], "request string, model string, tokens array<bigint>")


def matched(spark, registered, probe, n=None):
    index = prefix.register_blocks(None, requests(spark, registered), 4, None if n is None else F.lit(n))
    return prefix.longest_prefix(requests(spark, probe), index, 4).first()["matched"]


@pytest.mark.parametrize(("registered", "n", "probe", "want"), [
    ((), None, range(1, 9), 0), (range(1, 9), 8, range(1, 9), 8), (range(1, 9), 4, range(1, 9), 4), (range(1, 9), 8, [1, 2, 3, 4, 9, 10, 11, 12], 4),
    (range(1, 5), 4, range(5, 9), 0), (range(1, 5), 4, [1, 2, 3], 0), (range(10, 90, 10), 0, range(10, 90, 10), 0),
])
def test_longest_prefix(spark, registered, n, probe, want):
    assert matched(spark, list(registered), list(probe), n) == want


def test_removed_first_block(spark):
    r = requests(spark, range(1, 9))
    index = prefix.register_blocks(None, r, 4)
    left = prefix.remove_blocks(index, prefix.blocks(r, 4).where("block_idx = 0"))
    assert prefix.longest_prefix(r, left, 4).first()["matched"] == 0
    both = prefix.matchable(left, prefix.register_prefixes(r, 4))
    assert prefix.longest_prefix(r, both, 4).first()["matched"] == 8


def test_models_are_apart(spark):
    a, b = requests(spark, range(1, 5), model="a"), requests(spark, range(1, 5), model="b")
    assert prefix.longest_prefix(a, prefix.register_blocks(None, b, 4), 4).first()["matched"] == 0
    assert prefix.register_blocks(None, requests(spark, range(1, 13)), 4).count() == 3


def test_new_tokens(spark):
    rows = spark.createDataFrame([(8, 0, 9), (8, 0, 8), (4, 8, 20), (0, 0, 0)], "m int, c int, t int")
    assert [r[0] for r in rows.select(prefix.new_tokens(F.col("m"), F.col("c"), F.col("t"))).collect()] == [8, 7, 0, 0]


def test_accumulated_blocks(spark):
    rows = [("a", 1, "new", [1, 2]), ("a", 2, "cached", [3]), ("a", 3, "resumed", [9]), ("a", 4, "cached", [10]), ("b", 1, "cached", [5])]
    df = spark.createDataFrame(rows, "request string, seq long, kind string, block_ids array<int>")
    assert {r["request"]: r["block_ids"] for r in prefix.accumulate_blocks(df).collect()} == {"a": [9, 10], "b": [5]}
