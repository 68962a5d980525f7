import json
import random

from pyspark.sql import functions as F

from tessera.operators import cache, health
from tessera.sources import files, metadata
from tessera.streaming import stateful


def test_local_files(spark, tmp_path):
    for key in ("key1", "key2"):
        (tmp_path / key).mkdir()
        (tmp_path / key / "layer_0.bin").write_bytes(b"hello" + key.encode())
        (tmp_path / key / "meta.json").write_text(json.dumps({"num_tokens": 16, "dtype": "float16", "shape": [2, 16, 64], "compressed": True, "compression_level": 1, "other": 1}))
    rows = {r["key"]: r for r in files.read_layers(spark, str(tmp_path)).collect()}
    assert bytes(rows["key1"]["data"]) == b"hellokey1" and rows["key2"]["layer"] == "layer_0" and rows["key1"]["size"] == 9
    meta = {r["key"]: r for r in files.read_meta(spark, str(tmp_path)).collect()}
    assert meta["key1"]["shape"] == [2, 16, 64] and meta["key1"]["num_layers"] is None


def test_shards(spark, tmp_path):
    o = spark.createDataFrame([(f"key_{i}", "l", bytearray(b"x" * 10)) for i in range(20)], "key string, layer string, data binary")
    files.write_shards(o, str(tmp_path / "s"), 4)
    back = files.read_shards(spark, str(tmp_path / "s"))
    assert back.count() == 20 and back.select("shard").distinct().count() == 4
    assert files.lookup_shards(spark, str(tmp_path / "s"), "key_3", 4).count() == 1 and files.lookup_shards(spark, str(tmp_path / "s"), "none", 4).count() == 0


def test_entries(spark):
    meta = spark.createDataFrame([("a", 5, 2)], "key string, size long, object_generation long")
    entries = metadata.to_entries(meta, "p:")
    assert {r["name"] for r in entries.collect()} == {"p:block_meta:a", "p:generation:a"}
    assert metadata.from_entries(entries, "p:").first()["size"] == 5 and metadata.counters(entries, "p:").first()["generation"] == 2


def test_logs(spark, tmp_path):
    metadata.write_log(spark.createDataFrame([(1, "x")], "a int, b string"), str(tmp_path / "log"))
    assert metadata.read_log(spark, str(tmp_path / "log")).first()["fields"] == {"A": "1", "B": "x"}
    assert spark.range(1).select(metadata.nano_text(F.lit(1_500_000_007).cast("long"))).first()[0] == "1970-01-01T00:00:01.500000007"


def streamed(spark, tmp_path, rows, schema, make, batches=3):
    """Rows through a file stream in batches; what the query gives."""
    folder = tmp_path / "in"
    cuts = [rows[i * len(rows) // batches : (i + 1) * len(rows) // batches] for i in range(batches)]
    for i, part in enumerate(cuts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(folder / f"b{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(folder / "*"))
    q = make(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination(120)
    return spark.read.parquet(str(tmp_path / "out")).collect()


def test_streamed_assembly(spark, tmp_path):
    rows = [("s", 1, bytearray(b"b"), None, False), ("s", 0, bytearray(b"a"), "h", False), ("t", 0, bytearray(b"x"), "g", False), ("s", 2, bytearray(b"c"), None, True), ("s", 3, bytearray(b"d"), None, True)]
    got = streamed(spark, tmp_path, rows, "stream_id string, seq long, data binary, header string, is_last boolean", stateful.assemble)
    assert [(r["stream_id"], r["header"], bytes(r["data"]), r["chunks"]) for r in got] == [("s", "h", b"abc", 3)]


def test_streamed_breaker_equals_batch(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i % 3, i, float(i), rng.random() > 0.3) for i in range(90)]
    schema = "child long, seq long, ts double, ok boolean"
    got = streamed(spark, tmp_path, rows, schema, lambda s: stateful.breaker(s, 7.0))
    want = health.breaker(spark.createDataFrame(rows, schema), 7.0).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_streamed_lru_equals_batch(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"c{i % 2}", i, rng.choice(["get", "put", "delete"]), f"k{rng.randrange(9)}", rng.randrange(1, 50)) for i in range(120)]
    schema = "cache string, seq long, op string, key string, size long"
    got = streamed(spark, tmp_path, rows, schema, lambda s: stateful.byte_lru(s, 100))
    assert sorted(map(tuple, got)) == sorted(map(tuple, cache.byte_lru(spark.createDataFrame(rows, schema), 100).collect()))


def test_state_of_streams_that_stop_goes(spark, tmp_path):
    """After its time an unfinished stream's parts are dropped, and its last chunk alone makes nothing whole."""
    import time

    folder, schema = tmp_path / "in", "stream_id string, seq long, data binary, header string, is_last boolean"
    folder.mkdir()
    put = lambda i, rows: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / f"b{i}"))
    put(0, [("old", 0, bytearray(b"a"), "h", False), ("new", 0, bytearray(b"x"), "g", True)])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "*"))
    q = stateful.assemble(stream, kept=1).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).start(str(tmp_path / "out"))
    out = lambda: {r["stream_id"] for r in spark.read.schema("stream_id string").parquet(str(tmp_path / "out")).collect()} if list((tmp_path / "out").glob("*.parquet")) else set()
    seen = lambda n: sum(p["numInputRows"] for p in q.recentProgress) >= n

    def until(ready):
        end = time.time() + 60
        while not ready():
            assert time.time() < end and q.isActive
            time.sleep(0.3)

    try:  # processing-time timeouts run batches without data on and on
        until(lambda: out() == {"new"})
        time.sleep(3)
        put(1, [("old", 1, bytearray(b"b"), None, True), ("other", 0, bytearray(b"y"), "f", True)])
        until(lambda: "other" in out() and seen(4))
    finally:
        q.stop()
    assert out() == {"new", "other"}
