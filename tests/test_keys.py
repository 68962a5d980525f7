import hashlib
import random
import urllib.parse
import zlib

import xxhash
from pyspark.sql import functions as F

from tessera.functions import keys, routing, xxh3

NAMES = ["tenant:a", "", "é/ü", "a b~*+%", "..", "日本"]


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_canonical_key_round_trip(spark):
    for ns in NAMES:
        for key in ("/prefix:64/layer:0", "x", "é"):
            c = keys.canonical_key(F.lit(ns), F.lit(key))
            a, b = keys.parse_canonical(c)
            assert tuple(one(spark, c, a, b)) == (f"{len(ns.encode())}:{ns}{key}", ns, key)


def test_canonical_key_that_is_none(spark):
    assert tuple(one(spark, *keys.parse_canonical(F.lit("9:ab")))) == (None, None)
    assert tuple(one(spark, *keys.parse_canonical(F.lit("x:ab")))) == (None, None)


def test_block_keys_equal_hashlib_and_linear_form(spark):
    tokens = list(range(1, 71))
    want = [hashlib.sha256(("m:" + ",".join(map(str, tokens[: (i + 1) * 16]))).encode()).hexdigest()[:32] for i in range(4)]
    df = spark.createDataFrame([(tokens,), ([],), ([1],)], "t array<bigint>")
    for column in (keys.block_keys(F.col("t"), "m"), keys.block_keys_linear(F.col("t"), F.lit("m"))):
        assert [r[0] for r in df.select(column).collect()] == [want, [], []]


def test_block_store_key(spark):
    got = one(spark, keys.block_store_key(F.lit("v1"), F.lit("tenant/a"), F.lit("qwen/32b"), F.lit("abc123"), F.lit("pref/456"), F.lit(2), F.lit(7)))[0]
    assert got == "kvbm:v1:tenant%2Fa:qwen%2F32b:abc123:pref%2F456:tp2:b7"
    assert one(spark, keys.block_store_key(F.lit("v1"), F.lit("n"), F.lit("m"), F.lit("s"), F.lit(""), F.lit(0), F.lit(0)))[0] == "kvbm:v1:n:m:s:-:tp0:b0"


def test_percent_encoding(spark):
    for text in NAMES:
        assert one(spark, keys.percent_encode(F.lit(text)))[0] == urllib.parse.quote(text, safe="")


def test_path_component(spark):
    want = {"/data/models/Qwen2.5-32B-Instruct": "_data_models_Qwen2.5-32B-Instruct", "": "_", ".": "_", "..": "_", "a.b": "a.b"}
    for text, safe in want.items():
        assert one(spark, keys.path_component(F.lit(text)))[0] == safe


def test_device_number_and_sizes(spark):
    assert one(spark, keys.device_number(F.lit("key")))[0] == (zlib.crc32(b"key") & 0x7FFFFFFF) + 1
    assert [one(spark, keys.parse_size(F.lit(x)))[0] for x in ("512m", "4K", "1g", "7")] == [512 << 20, 4096, 1 << 30, 7]


def test_md5_mod(spark):
    df = spark.createDataFrame([(f"k{i}",) for i in range(200)], "k string")
    for n in (1, 2, 3, 7, 13, 1000):
        got = [r[0] for r in df.select(routing.md5_mod(F.col("k"), n)).collect()]
        assert got == [int(hashlib.md5(f"k{i}".encode()).hexdigest(), 16) % n for i in range(200)]


def test_md5_mod_is_even(spark):
    df = spark.createDataFrame([(f"k{i}",) for i in range(1000)], "k string").groupBy(routing.md5_mod(F.col("k"), 2)).count()
    assert all(r["count"] > 300 for r in df.collect())


def test_xxh3(spark):
    df = spark.createDataFrame([("abc",), ("é",), (None,)], "k string")
    got = df.select(xxh3.xxh3_hex(F.col("k")), xxh3.xxh3_mod(F.col("k"), 7)).collect()
    assert [tuple(r) for r in got] == [*((xxhash.xxh3_64_hexdigest(k.encode()), xxhash.xxh3_64_intdigest(k.encode()) % 7) for k in ("abc", "é")), (None, None)]


def test_stripes_and_chunks(spark):
    assert len(one(spark, routing.stripe_list(F.lit(2048).cast("long"), 512))[0]) == 4
    assert [r["length"] for r in one(spark, routing.stripe_list(F.lit(12).cast("long"), 5))[0]] == [5, 5, 2]
    assert one(spark, routing.byte_chunks(F.lit(""), 4))[0] == [b""]
    assert one(spark, routing.partition_counts(F.lit(13), 4))[0] == [4, 3, 3, 3]
    assert one(spark, routing.partition_counts(F.lit(2), 4))[0] == [1, 1, 0, 0]


def test_rebuilt_layout(spark):
    from tessera.operators import placement

    rows = [("n", "k", 2, 1, 3000, True, 3, 1024), ("n", "one", 1, 1, 10, False, 0, 0), ("n", "old", 0, 1, 10, False, 0, 0), ("n", "none", 1, 1, 9000, True, 0, 1024)]
    df = spark.createDataFrame(rows, "namespace string, object_key string, object_generation long, layout_version long, size long, is_striped boolean, stripe_count int, chunk_size long")
    got = {}
    for r in placement.rebuilt_layout(df, 4).collect():
        got.setdefault(r["object_key"], []).append((r["status"], r["stripe_index"], r["device"], r["path"]))
    home = xxhash.xxh3_64_intdigest(b"1:nk") % 4
    h = hashlib.md5(b"1:nk").hexdigest()
    assert sorted(got["k"]) == [("ok", i, (home + i) % 4, f"/dev{(home + i) % 4}/data/n/{h[:2]}/{h[2:4]}/{h[4:]}.g2.l1.chunk{i}.bin") for i in range(3)]
    assert [x[0] for x in got["one"]] == ["ok"] and got["old"] == [("bad_version", None, None, None)] and got["none"] == [("no_layout", None, None, None)]


def test_xxh3_of_any_length_in_sql():
    """The SQL that queries are held against, by the xxhash module."""
    import duckdb

    from tessera.plans.xxh3_sql import hash_sql

    rng = random.Random(3)
    lengths = [*range(70), 96, 97, 128, 129, 144, 160, 240, 241, 255, 256, 257, 512, 513, 1023, 1024, 1025, 1088, 2048, 2049, 5000]
    texts = ["".join(rng.choice("abcdefgh|=:/é0123") for _ in range(n)) for n in lengths] + ["x" * n for n in lengths]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (x VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?)", [[x] for x in texts])
    got = dict(con.execute(f"SELECT x, {hash_sql('x')} FROM t").fetchall())
    assert got == {x: xxhash.xxh3_64_intdigest(x.encode()) for x in texts}
