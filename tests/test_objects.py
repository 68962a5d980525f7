from pyspark.sql import functions as F

from tessera.operators import lookup, objects, striping
from tessera.sources import files


def test_generations(spark):
    puts = spark.createDataFrame([("k", 1, False), ("k", 2, False), ("k", 3, True), ("n", 1, True), ("n", 2, True)], "key string, seq long, if_absent boolean")
    got = {(r["key"], r["seq"]): (r["stored"], r["generation"]) for r in objects.apply_puts(puts).collect()}
    assert got == {("k", 1): (True, 1), ("k", 2): (True, 2), ("k", 3): (False, None), ("n", 1): (True, 1), ("n", 2): (False, None)}
    counters = spark.createDataFrame([("k", 10)], "key string, generation long")
    assert objects.apply_puts(puts.where("key = 'k' and seq = 1"), counters).first()["generation"] == 11


def test_compare_and_delete(spark):
    have = spark.createDataFrame([("a", 2), ("b", 2)], "key string, generation long")
    want = spark.createDataFrame([("a", 1), ("b", 2), ("c", 1)], "key string, generation long")
    left, done = objects.compare_and_delete(have, want)
    assert [tuple(r) for r in left.collect()] == [("a", 2)]
    assert {r["key"]: r["deleted"] for r in done.collect()} == {"a": False, "b": True, "c": False}


def test_rebucket_and_reassemble(spark):
    segs = spark.createDataFrame([("k", 0, 4), ("k", 1, 6), ("k", 2, 0)], "key string, seg int, length long")
    got = sorted(tuple(r) for r in striping.rebucket(segs, 4).select("stripe_index", "seg", "seg_offset", "stripe_offset", "length").collect())
    assert got == [(0, 0, 0, 0, 4), (1, 1, 0, 0, 4), (2, 1, 4, 0, 2)]
    parts = spark.createDataFrame([("k", 2, "ij"), ("k", 0, "abcd"), ("k", 1, "efgh")], "key string, stripe_index int, data string")
    assert bytes(striping.reassemble(parts).first()["data"]) == b"abcdefghij"


def test_slots(spark):
    r = spark.createDataFrame([("a", [0, 2, 5], 10), ("b", [1], 3)], "request string, block_ids array<int>, n int")
    got = {}
    for row in striping.slots(r, 4).collect():
        got.setdefault(row["request"], {})[row["pos"]] = row["slot"]
    assert (got["a"][0], got["a"][4], got["a"][8], len(got["a"])) == (0, 8, 20, 10) and sorted(got["b"].values()) == [4, 5, 6]


def test_assembled_stream(spark):
    rows = [("s", 1, "b", "h1", True), ("s", 0, "a", "h0", False), ("s", 2, "c", "h2", True), ("e", 0, None, "h", True)]
    got = {r["stream_id"]: r for r in striping.assemble_stream(spark.createDataFrame(rows, "stream_id string, seq long, data string, header string, is_last boolean")).collect()}
    assert (got["s"]["header"], bytes(got["s"]["data"]), got["s"]["status"]) == ("h0", b"ab", "ok") and got["e"]["status"] == "invalid_argument"


def test_batch_lookup_keeps_order_and_misses(spark):
    have = spark.createDataFrame([("key_0", "v")], "key string, data string")
    asked = spark.createDataFrame([(0, "key_0"), (1, "key_missing"), (2, "key_0")], "pos int, key string")
    assert [tuple(r) for r in lookup.batch_get(asked, have, ["key"], "data").orderBy("pos").select("data", "found").collect()] == [("v", True), (None, False), ("v", True)]


def test_universal_probe(spark):
    asked = spark.createDataFrame([("k",)], "key string")
    layers = spark.createDataFrame([("k", f"blocks_2_tp{i}") for i in range(4)], "key string, layer string")
    some = layers.where("layer = 'blocks_2_tp0'")
    got = lookup.universal_probe(asked, layers, some).first()
    assert (got["n_layers"], got["hit"], got["missing"]) == (4, False, ["blocks_2_tp1", "blocks_2_tp2", "blocks_2_tp3"])
    assert lookup.universal_probe(asked, layers, layers).first()["hit"]


def test_capacity_of_children(spark):
    kv = spark.createDataFrame([(0, 2), (1, 4)], "child int, size long")
    assert tuple(files.usage(kv, 2000).first()) == (6, 2000) and tuple(files.usage(kv.where("child = 0"), 1000).first()) == (2, 1000)


def test_lanes_round_trip(spark):
    segs = spark.createDataFrame([("a", i) for i in range(13)] + [("b", 0)], "key string, seg int")
    lanes = striping.lanes(segs, 4)
    sizes = {r["lane"]: r["n"] for r in lanes.where("key = 'a'").groupBy("lane").agg(F.count("seg").alias("n")).collect()}
    assert sizes == {0: 4, 1: 3, 2: 3, 3: 3}
    got = {r["key"]: (r["hit"], r["segs"]) for r in striping.gather_lanes(lanes, 4).collect()}
    assert got == {"a": (True, list(range(13))), "b": (True, [0])}
    assert not striping.gather_lanes(lanes.where("not (key = 'b' and lane = 3)"), 4).where("key = 'b'").first()["hit"]
