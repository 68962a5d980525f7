"""The store, layer files, tiers and slab against plain models, and decision tables by their rows."""

import hashlib
import itertools
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.functions import xxh3
from tessera.operators import cache, checks, health, lookup, metrics, placement, striping
from tessera.sources import files
from tessera.sources.store import Store

OBJECTS = "key string, layer string, data string"


def state(store):
    return {(r["key"], r["layer"]): r["data"].decode() for r in store.objects().collect()}


@pytest.mark.parametrize("policy", ["block", "layer"])
def test_store_equals_model(spark, tmp_path, policy):
    rng, model = random.Random(7), {}
    store = Store(spark, f"file://{tmp_path}/s", shards=3, policy=policy, capacity=99)
    assert state(store) == {} and tuple(store.usage().first()) == (0, 99) and store.keys().count() == 0
    for step in range(6):
        if step % 3 == 2:
            gone = [(f"k{rng.randrange(12)}",) for _ in range(4)]
            store.delete(spark.createDataFrame(gone, "key string"))
            model = {k: v for k, v in model.items() if (k[0],) not in gone}
        else:
            rows = {(f"k{rng.randrange(10)}", rng.choice(["", "a", "b"])): f"v{step}" * rng.randrange(4) for _ in range(12)}
            store.put(spark.createDataFrame([(*k, v) for k, v in rows.items()], OBJECTS))
            model |= rows
        assert state(store) == model
        assert store.usage().first()["used"] == sum(map(len, model.values()))
    assert {r["key"] for r in store.keys().collect()} == {k for k, _ in model}
    asked = [(f"k{i}",) for i in range(13)]
    assert {r["key"]: r["found"] for r in store.exists(spark.createDataFrame(asked, "key string")).collect()} == {k: any(k == m for m, _ in model) for (k,) in asked}
    for (key, layer), value in model.items():
        assert [r["data"].decode() for r in store.get(key, layer).collect()] == [value]
    assert store.get("none").count() == 0
    batch = [(i, f"k{i % 11}", "a") for i in range(20)]
    got = {r["pos"]: (None if r["data"] is None else r["data"].decode(), r["found"]) for r in store.get_batch(spark.createDataFrame(batch, "pos int, key string, layer string")).collect()}
    assert got == {i: (model.get((k, y)), (k, y) in model) for i, k, y in batch}


def test_a_lookup_reads_one_shard(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", shards=4)
    store.put(spark.createDataFrame([(f"k{i}", "l", "x") for i in range(40)], OBJECTS))
    plan = store.get("k3", "l")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [shard#" in plan and " IN (-1," in plan


def test_what_is_not_published_is_not_read(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    one = lambda v: spark.createDataFrame([("k", "l", v)], OBJECTS)
    store.put(one("old"))
    hidden = store.stage(one("new"))
    failing = one("x").select("key", "layer", F.raise_error(F.lit("lost")).cast("string").alias("data"))
    with pytest.raises(Exception, match="lost"):
        store.put(failing)
    assert state(store) == {("k", "l"): "old"}
    # two writers: both commits stay, the later one counts
    other = Store(spark, f"file://{tmp_path}/s")
    assert other.put(one("other")) == 2 and store.publish(hidden) == 3
    assert state(store) == {("k", "l"): "new"}


def test_layer_files_and_their_metadata(spark, tmp_path):
    rows = spark.createDataFrame([("a", "l0", "one", 16), ("a", "l1", "two", 16), ("b", "l0", "x", 4)], "key string, layer string, data string, num_tokens int")
    for root in (str(tmp_path / "plain"), f"file://{tmp_path}/uri"):
        assert sorted(tuple(r) for r in files.write_layers(rows, root).collect()) == [("a", "l0", 3), ("a", "l1", 3), ("b", "l0", 1)]
        assert sorted((r["key"], r["layer"], bytes(r["data"])) for r in files.read_layers(spark, root).collect()) == [("a", "l0", b"one"), ("a", "l1", b"two"), ("b", "l0", b"x")]
        assert sorted((r["key"], r["num_tokens"]) for r in files.read_meta(spark, root).collect()) == [("a", 16), ("b", 4)]
        gone = files.delete_layers(spark.createDataFrame([("a",), ("c",)], "key string"), root)
        assert sorted(tuple(r) for r in gone.collect()) == [("a", True), ("c", False)]
        assert [r["key"] for r in files.read_layers(spark, root).collect()] == ["b"]
    assert not list(tmp_path.rglob("*.tmp"))


def test_memory_tier_equals_model(spark):
    rng = random.Random(9)
    rows = [(f"c{rng.randrange(2)}", i, rng.choice(["get", "get", "put", "put_if_absent", "delete", "exists"]), f"k{rng.randrange(7)}", rng.randrange(1, 60), rng.random() > 0.1) for i in range(500)]
    got = {(r["cache"], r["seq"]): (r["outcome"], r["evicted"], r["used"]) for r in cache.memory_tier(spark.createDataFrame(rows, "cache string, seq long, op string, key string, size long, ok boolean"), 100).collect()}
    stores, caches = {}, {}
    for c, seq, op, key, size, ok in rows:
        store, held = stores.setdefault(c, {}), caches.setdefault(c, [])  # held: (key, size), least recent first
        find = next((x for x in held if x[0] == key), None)

        def fill(n):
            out = 0
            while n <= 100 and sum(s for _, s in held) + n > 100:
                held.pop(0)
                out += 1
            if n <= 100:
                held.append((key, n))
            return out

        evicted = 0
        if op == "get":
            outcome = "memory" if find else "storage" if key in store else "miss"
            if find:
                held.remove(find)
                held.append(find)
            elif key in store:
                evicted = fill(store[key])
        elif op == "exists":
            outcome = "found" if key in store else "absent"
        elif op == "delete":
            outcome = "deleted" if store.pop(key, None) is not None else "absent"
            if find:
                held.remove(find)
        elif op == "put_if_absent" and key in store:
            outcome = "exists"
        elif not ok:
            outcome = "failed"
        else:
            outcome, store[key] = "stored", size
            if find:
                held.remove(find)
            evicted = fill(size)
        assert got[c, seq] == (outcome, evicted, sum(s for _, s in held)), (seq, op)


def test_slab_budget():
    s = cache.SlabCache(4096, 4 * 4096)
    assert s.budget == 4 * 4096 and cache.SlabCache(9 * 4096, 4096).budget == 9 * 4096
    assert [s.access("put", k, 4096) for k in "abcd"] == [("slab", 0)] * 4
    assert s.access("put", "e", 4096) == ("slab", 1) and s.access("get", "a", 0) == ("miss", 0)
    assert s.access("put", "z", 0) == ("empty", 0) and s.access("get", "b", 0) == ("slab", 0)
    s = cache.SlabCache(9 * 4096, 4096)
    assert [s.access("put", k, 4096)[0] for k in "ab"] == ["slab", "heap"] and s.access("get", "b", 0) == ("heap", 0)
    assert s.access("delete", "a", 0) == ("deleted", 0) and s.access("put", "b", 4000) == ("slab", 0) and s.used == 4000


def test_evict_and_retry_equals_model(spark):
    rng = random.Random(3)
    rows = [(f"c{i % 2}", i, f"n{i}", rng.randrange(1, 20) * 4096) for i in range(120)]
    total = 32 * 4096
    got = {r["seq"]: (r["place"] is not None, r["rounds"], r["evicted"]) for r in cache.evict_and_retry(spark.createDataFrame(rows, "cache string, seq long, id string, size long"), total).collect()}
    lists = {}
    for c, seq, name, size in rows:
        used, order = lists.setdefault(c, (cache.BestFit(total), []))
        ok, rounds, evicted = used.alloc(name, size) is not None, 0, 0
        while not ok and rounds < 5:
            rounds += 1
            freed = 0
            while freed < min(size * 2**rounds, total) and order:
                old, n = order.pop(0)
                used.free(old)
                freed, evicted = freed + n, evicted + 1
            ok = used.alloc(name, size) is not None
        if ok:
            order.append((name, size))
        assert got[seq] == (ok, rounds, evicted)


def test_guarded_calls(spark):
    calls = spark.createDataFrame([(0, 0, 0.0, True), (0, 1, 1.0, False), (0, 2, 2.0, True), (0, 3, 9.0, True), (1, 4, 0.0, True)], "child long, seq long, ts double, ok boolean")
    got = health.guarded(calls, health.breaker(calls, 5.0), F.lit("value"), F.lit("miss"))
    assert {r["seq"]: r["result"] for r in got.collect()} == {0: "value", 1: "miss", 2: "miss", 3: "value", 4: "value"}


def test_hashed_identities(spark):
    """Etags, handles, epochs and layout hashes by the xxhash module over the texts that they hash."""
    h = lambda s: xxhash.xxh3_64_hexdigest(s.encode())
    df = spark.createDataFrame([("2:nskey", 3, 1, 10, 99)], "c string, g long, l long, s long, t long")
    row = df.select(xxh3.content_etag(F.col("c"), F.col("g"), F.col("s"), F.col("t")), xxh3.object_handle(F.col("c"), F.col("g"), F.col("l"), F.col("s"), F.col("t"))).first()
    md5 = hashlib.md5(b"2:nskey").hexdigest()
    assert tuple(row) == (h("2:nskey|generation=3|size=10|created_at=99"), f"ctxobj-v1-{md5}-g3-l1-" + h("2:nskey|generation=3|layout=1|size=10|created_at=99"))
    nodes = spark.createDataFrame([(1, "b", "e2", ""), (0, "a", "e1", "r1")], "idx int, node_id string, grpc_endpoint string, rdma_endpoint string")
    text = "policy=hash_v1|striping_threshold=4096|striping_chunk_size=1024|devices=8|node0=a:e1:r1|node1=b:e2:"
    assert placement.epoch(placement.epoch_seed(nodes, "hash", 4096, 1024, 8)).first()[0] == h(text)
    objects = spark.createDataFrame([("k", 2, 1, 7, "hash_v1")], "key string, generation long, layout long, epoch long, policy string")
    chunks = spark.createDataFrame([("k", 1, "n1", 4, 512, "p1"), ("k", 0, "n0", 3, 0, "p0")], "key string, stripe_index int, node_id string, device_id int, offset long, storage_handle string")
    assert placement.layout_hash(objects, chunks).first()["layout_hash"] == h("k|g2|l1|epoch7|hash_v1|2|0:n0:3:0:p0|1:n1:4:512:p1")
    base = xxhash.xxh3_64_intdigest(b"2:nskey")
    assert [r[0] for r in df.select(F.explode(F.array(*map(F.lit, range(5)))).alias("i"), "c").select(placement.data_node(F.col("c"), F.col("i"), 3)).collect()] == [(base % 3 + i) % 3 for i in range(5)]
    cut = spark.createDataFrame([("ns", "key", i, i * 512, 512) for i in range(4)], "namespace string, object_key string, stripe_index int, offset long, length long")
    for r in placement.stripe_locations(cut, 3, 4, F.lit(2), F.lit(1)).collect():
        i = r["stripe_index"]
        assert (r["node"], r["device"]) == ((base % 3 + i) % 3, (base % 4 + i) % 4)
        assert r["storage_handle"] == f"/dev{r['device']}/data/ns/{md5[:2]}/{md5[2:4]}/{md5[4:]}.g2.l1.chunk{i}.bin"


def test_specs_by_one_block_and_of_a_wrong_length(spark):
    specs = spark.createDataFrame([("r", [5, 3]), ("s", [3])], "request string, block_ids array<long>")
    data = spark.createDataFrame([("k", 5, "K5"), ("k", 3, "K3"), ("v", 5, "V55"), ("v", 3, "V33")], "layer string, block_id long, data string")
    layers = [("k", 2), ("v", 3)]
    got = striping.gather_specs(specs, data, layers)
    assert {r["request"]: bytes(r["data"]) for r in got.collect()} == {"r": b"K5K3V55V33", "s": b"K3V33"}
    back = striping.scatter_specs(specs, got, layers).where("request = 'r'")
    assert sorted((r["layer"], r["block_id"], bytes(r["data"])) for r in back.collect()) == [("k", 3, b"K3"), ("k", 5, b"K5"), ("v", 3, b"V33"), ("v", 5, b"V55")]
    cut = got.withColumn("data", F.substring("data", 1, 4))
    assert {r["data"] for r in striping.scatter_specs(specs, cut, layers).collect()} == {None}


def test_bytes_are_joined_as_they_are(spark):
    parts = [bytes(range(256)), b"", bytes(range(255, -1, -1)), "é€".encode()]
    df = spark.createDataFrame([("k", i, bytearray(p)) for i, p in enumerate(parts)], "key string, stripe_index int, data binary")
    assert bytes(striping.reassemble(df).first()["data"]) == b"".join(parts)


def test_upper_median(spark):
    for n in (1, 2, 3, 4, 9, 10):
        values = random.Random(n).sample(range(100), n)
        assert spark.createDataFrame([(v,) for v in values], "x int").agg(metrics.upper_median("x")).first()[0] == sorted(values)[n // 2]


def decided(spark, rows, schema, rule):
    """rows: inputs and the expected outcome last."""
    names = [f.strip().split(" ")[0] for f in schema.split(", ")]
    df = spark.createDataFrame([(i, *r[:-1]) for i, r in enumerate(rows)], f"_i int, {schema}")
    got = {r["_i"]: r["got"] for r in df.select("_i", rule(*(F.col(n) for n in names)).alias("got")).collect()}
    assert [got[i] for i in range(len(rows))] == [r[-1] for r in rows]


def test_identity_table(spark):
    """Five fields make an identity; three of them the content."""
    base = ("h", 1, "e", 1, 10)
    kind = "object_handle string, object_generation long, content_etag string, layout_version long, size long"
    other = {0: "layout_only", 1: "changed", 2: "changed", 3: "layout_only", 4: "changed"}
    rows = [(base, base, "same"), ((None,) * 5, (None,) * 5, "same")]
    for k, want in other.items():
        changed = tuple("x" if isinstance(v, str) else 9 for v in base)
        rows.append((base, base[:k] + (changed[k],) + base[k + 1 :], want))
        rows.append((base, base[:k] + (None,) + base[k + 1 :], want))
    rows.append((base, ("x", 1, "e", 2, 10), "layout_only"))
    struct = "struct<" + ",".join(f.replace(" ", ":") for f in kind.split(", ")) + ">"
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(rows)], f"i int, a {struct}, b {struct}")
    got = {r["i"]: r["k"] for r in df.select("i", lookup.identity_class(F.col("a"), F.col("b")).alias("k")).collect()}
    assert [got[i] for i in range(len(rows))] == [r[2] for r in rows]


def test_placement_table(spark):
    struct = "struct<key:string,placement_epoch:long,placement_policy_id:string,layout_hash:string>"
    now = ("k", 1, "p", "x")
    rows = [(None, "ok"), (now, "ok"), ((None, 1, "p", "x"), "invalid_argument"), (("j", 1, "p", "x"), "stale"), (("k", 2, "p", "x"), "stale"), (("k", 1, "q", "x"), "stale"), (("k", 1, "p", "y"), "stale"), (("k", None, "p", "x"), "stale"), ((None, 2, "q", "y"), "invalid_argument")]
    df = spark.createDataFrame([(i, a, now) for i, (a, _) in enumerate(rows)], f"i int, a {struct}, b {struct}")
    got = {r["i"]: r["s"] for r in df.select("i", lookup.placement_state(F.col("a"), F.col("b")).alias("s")).collect()}
    assert [got[i] for i in range(len(rows))] == [w for _, w in rows]


def test_cached_read_table(spark):
    """Every combination of cached descriptor, lookup, read and identity."""
    def want(cached, look, read, kind, strict):
        if not cached:
            return "lookup_then_read"
        if look == "error":
            return "raise_lookup" if strict else "return_read" if read == "ok" else "miss_evict"
        if look == "missing":
            return "miss_evict"
        return {"stale": "reread", "error": "raise_read", "none": "reread"}.get(read) or {"same": "return_read", "layout_only": "return_read_refresh", "changed": "reread"}[kind]

    cases = list(itertools.product((True, False), ("ok", "missing", "error"), ("ok", "none", "stale", "error"), ("same", "layout_only", "changed")))
    for strict in (True, False):
        decided(spark, [(*c, want(*c, strict)) for c in cases], "c boolean, look string, read string, kind string", lambda c, look, read, kind, s=strict: lookup.cached_read(c, look, kind, read, s))


def test_checks(spark):
    decided(spark, [(0, False), (1, True), (1 << 32, True), ((1 << 32) + 1, False), (-1, False), (None, False)], "size long", checks.put_size)
    decided(spark, [(0, 5, "ok"), (5, 5, "ok"), (5, 4, "length_mismatch"), (-1, 4, "ok")], "a long, b long", placement.chunk_write)
    decided(spark, [("p", True, 0, "p", "ok"), ("p", False, 9, "q", "unmanaged_path"), ("p", True, 8, "p", "device_out_of_range"), ("p", True, -1, "p", "device_out_of_range"), ("p", True, 7, "q", "handle_mismatch")],
            "handle string, managed boolean, device int, expected string", lambda h, m, d, e: checks.chunk_handle(h, m, d, 8, e))
    decided(spark, [(0, 8, 8, 0), (1, 8, 8, -2), (0, 8, None, -4), (0, 8, 9, -6), (0, 0, 0, 0)], "offset long, asked long, size long", checks.object_get)
    decided(spark, [("grpc", True, (0, True)), ("grpc", False, (0, False)), ("rdma", True, (0, False))], "transport string, found boolean", checks.object_exists)
    decided(spark, [(8, 8, (8, None)), (7, 8, (None, "target_too_small")), (9, None, (None, None))], "target long, size long", checks.read_into)
    decided(spark, [("not_found", "NOT_FOUND"), ("already_exists", "ALREADY_EXISTS"), ("invalid_argument", "INVALID_ARGUMENT"), ("disk", "INTERNAL"), (None, "OK")], "e string", placement.status_code)


def test_put_if_absent_after_a_delete(spark):
    """A counter outlives its object: a put if absent is stored and follows it."""
    from tessera.operators import objects

    puts = spark.createDataFrame([("gone", 1, True), ("gone", 2, True), ("there", 1, True), ("there", 2, False), ("new", 1, True)], "key string, seq long, if_absent boolean")
    counters = spark.createDataFrame([("gone", 2), ("there", 1)], "key string, generation long")
    live = spark.createDataFrame([("there", 10)], "key string, generation long")
    got = {(r["key"], r["seq"]): (r["stored"], r["generation"]) for r in objects.apply_puts(puts, counters, live).collect()}
    assert got == {("gone", 1): (True, 3), ("gone", 2): (False, None), ("there", 1): (False, None), ("there", 2): (True, 11), ("new", 1): (True, 1)}


def test_scans_of_few_partitions_are_spread(spark, tmp_path):
    from tessera.sources.shared import spread

    spark.range(1000).coalesce(1).write.parquet(f"{tmp_path}/one")
    one = spark.read.parquet(f"{tmp_path}/one")
    assert one.rdd.getNumPartitions() == 1 and spread(one).rdd.getNumPartitions() == 3 * spark.sparkContext.defaultParallelism
    assert sorted(r["id"] for r in spread(one).collect()) == list(range(1000))
    many = spark.range(1000).repartition(50)
    many.write.parquet(f"{tmp_path}/many")
    joined = one.join(one.withColumnRenamed("id", "other"), one["id"] == F.col("other"))
    for df in (spark.range(0, 100, 1, 40), joined):
        assert spread(df) is df


def test_a_shared_folder_is_needed_on_a_cluster(monkeypatch, spark):
    from tessera.sources import shared

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):  # noqa: N802
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()  # noqa: N815

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session())
    assert shared.shared_dir(spark).startswith("file:")
