"""Queries of lookups, probes, predicates and sets."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from tessera.operators import checks, lookup, metrics, placement
from tessera.plans import query
from tessera.plans.tables import OBJ, objects, table


def _asked(spark, d):
    """Line items ask for orders by position; one in seven keys is shifted out of range."""
    t = table(spark, d, "lineitem")
    key = F.when(F.col("l_partkey") % 7 == 0, F.col("l_orderkey") + 100_000_000).otherwise(F.col("l_orderkey"))
    return t.select(F.col("l_orderkey").alias("batch"), F.col("l_linenumber").alias("pos"), key.alias("key"))


ASKED = "asked AS (SELECT l_orderkey AS batch, l_linenumber AS pos, CASE WHEN l_partkey % 7 = 0 THEN l_orderkey + 100000000 ELSE l_orderkey END AS key FROM lineitem)"
ORDERS = "o AS (SELECT o_orderkey AS key, o_orderpriority AS value, o_custkey % 3 AS tier, o_custkey % 4 AS child FROM orders)"


def _orders(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("value"), (F.col("o_custkey") % 3).alias("tier"), (F.col("o_custkey") % 4).alias("child"))


@query("JOIN-01", f"WITH {ORDERS} SELECT key, value FROM o")
def point_lookup(spark, d):
    """Every order is asked for once, and a shifted key that misses for each seventh."""
    o = _orders(spark, d)
    misses = o.where("key % 7 = 0").select((F.col("key") + 100_000_000).alias("key"))
    return lookup.get(o.select("key", "value"), o.select("key").unionByName(misses), ["key"])


@query("JOIN-02 API-10 PYC-04 IOX-02", f"WITH {ASKED}, {ORDERS} SELECT batch, pos, asked.key, value, o.key IS NOT NULL AS found FROM asked LEFT JOIN o ON asked.key = o.key")
def batch_lookup(spark, d):
    return lookup.batch_get(_asked(spark, d), _orders(spark, d), ["key"], "value")


@query("JOIN-03 SRC-05", f"WITH {ASKED}, {ORDERS} SELECT batch, pos, asked.key, value, CASE tier WHEN 0 THEN 'memory' WHEN 1 THEN 'disk' WHEN 2 THEN 'disk' END AS tier FROM asked LEFT JOIN o ON asked.key = o.key")
def tiered_lookup(spark, d):
    o = _orders(spark, d)
    return lookup.tiered_get(_asked(spark, d), [("memory", o.where("tier = 0")), ("disk", o)], ["key"], "value")


@query("JOIN-06 HA-02 SRC-07", f"WITH {ASKED}, {ORDERS} SELECT batch, pos, asked.key, (asked.key % 4) AS child, CASE WHEN asked.key % 4 <> 2 THEN value END AS value, o.key IS NOT NULL AND asked.key % 4 <> 2 AS found FROM asked LEFT JOIN o ON asked.key = o.key")
def routed_lookup(spark, d):
    asked = _asked(spark, d).withColumn("child", F.col("key") % 4)
    held = _orders(spark, d).drop("child").withColumn("child", F.col("key") % 4)
    children = spark.range(4).select(F.col("id").alias("child"), (F.col("id") != 2).alias("up"))
    return lookup.routed_get(asked, held, children, ["key"], "value").select("batch", "pos", "key", "child", "value", "found")


@query("JOIN-05 WIN-08", f"WITH {ASKED}, {ORDERS} SELECT batch, pos, asked.key, value, asked.key % 8 AS device FROM asked JOIN o ON asked.key = o.key")
def device_ordered_reads(spark, d):
    rows = lookup.get(_orders(spark, d).select("key", "value"), _asked(spark, d), ["key"]).withColumn("device", F.col("key") % 8).withColumn("path", F.col("key").cast("string"))
    return lookup.device_order(rows).select("batch", "pos", "key", "value", "device")


@query("PRD-01 PRD-02 API-04 MEM-06", f"WITH {ASKED}, {ORDERS} SELECT DISTINCT asked.key, o.key IS NOT NULL AS found FROM asked LEFT JOIN o ON asked.key = o.key")
def exists_in_tiers(spark, d):
    o = _orders(spark, d)
    return lookup.exists(_asked(spark, d).select("key").distinct(), o.where("tier = 0").unionByName(o.where("tier > 0")), ["key"])


@query("PRD-03 MUT-08 STG-08", "SELECT l_orderkey AS key, bool_and(l_linestatus = 'F') AS whole FROM lineitem GROUP BY l_orderkey")
def verified_objects(spark, d):
    t = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), "l_linestatus").alias("path"), "l_linestatus")
    whole, broken = lookup.verified(t, t.where("l_linestatus = 'F'"))
    return whole.withColumn("whole", F.lit(True)).unionByName(broken.withColumn("whole", F.lit(False)))


DESC = """dsc AS (SELECT doc_id, size, doc_id % 7 AS g FROM obj)"""


@query("PRD-07 PRD-09 PRD-10 MEM-02 RDM-05 API-06 PYC-03", f"""WITH {OBJ}, {DESC} SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'changed' WHEN doc_id % 5 = 0 THEN 'layout_only' ELSE 'same' END AS identity, doc_id % 11 = 0 OR doc_id % 5 = 0 AS stale FROM dsc""")
def descriptor_identity(spark, d):
    o = objects(spark, d)
    side = lambda generation, layout: F.struct(F.lit("h").alias("object_handle"), generation.alias("object_generation"), F.lit("e").alias("content_etag"), layout.alias("layout_version"), F.col("size"))
    g = F.col("doc_id") % 7
    a, b = side(g, F.lit(1)), side(F.when(F.col("doc_id") % 11 == 0, g + 1).otherwise(g), F.when(F.col("doc_id") % 5 == 0, 2).otherwise(1))
    kind = lookup.identity_class(a, b)
    return o.select("doc_id", kind.alias("identity"), (kind != "same").alias("stale"))


@query("PRD-08", f"WITH {OBJ} SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'ok' WHEN doc_id % 7 = 0 THEN 'invalid_argument' WHEN doc_id % 5 = 0 OR doc_id % 3 = 0 THEN 'stale' ELSE 'ok' END AS state FROM obj")
def placement_staleness(spark, d):
    o = objects(spark, d)
    i = F.col("doc_id")
    place = lambda key, epoch: F.struct(key.alias("key"), epoch.alias("placement_epoch"), F.lit("hash_v1").alias("placement_policy_id"), F.lit("x").alias("layout_hash"))
    now = place(F.col("object_key"), F.lit(3))
    asked = place(F.when(i % 7 == 0, F.lit(None).cast("string")).when(i % 3 == 0, F.concat(F.col("object_key"), F.lit("x"))).otherwise(F.col("object_key")), F.when(i % 5 == 0, 4).otherwise(3))
    return o.select("doc_id", lookup.placement_state(F.when(i % 13 != 0, asked), now).alias("state"))


@query("KEY-16 API-05 PYC-02 PYC-09 PLC-09 PLC-10", f"WITH {OBJ} SELECT object_key AS key, 'h' || doc_id AS object_handle, doc_id % 5 + 1 AS object_generation, 'e' || size AS content_etag, 1 AS layout_version, size, size > 4096 AS is_striped, CASE WHEN size > 4096 THEN ((size + 1023) // 1024)::INT ELSE 0 END AS stripe_count, CASE WHEN size > 4096 THEN 1024 ELSE 0 END AS chunk_size FROM obj")
def descriptors(spark, d):
    o = objects(spark, d)
    n = F.ceil(F.col("size") / 1024).cast("int")
    paths = F.when(F.col("size") > 4096, F.transform(F.sequence(F.lit(1), n), lambda i: i.cast("string")))
    meta = o.select(F.col("object_key").alias("key"), F.concat(F.lit("h"), F.col("doc_id").cast("string")).alias("object_handle"), (F.col("doc_id") % 5 + 1).alias("object_generation"), F.concat(F.lit("e"), F.col("size").cast("string")).alias("content_etag"), F.lit(1).alias("layout_version"), "size", paths.alias("chunk_paths"), F.lit(1024).cast("long").alias("chunk_size"))
    return placement.descriptor(meta)


CHUNKS = "ch AS (SELECT l_orderkey AS key, CASE WHEN l_suppkey % 5 = 0 THEN '' ELSE 'ep' || (l_suppkey % 3) END AS endpoint, 'n' || (l_suppkey % 3) AS node_id FROM lineitem)"


def _chunks(spark, d):
    t = table(spark, d, "lineitem")
    m = (F.col("l_suppkey") % 3).cast("string")
    return t.select(F.col("l_orderkey").alias("key"), F.when(F.col("l_suppkey") % 5 == 0, "").otherwise(F.concat(F.lit("ep"), m)).alias("endpoint"), F.concat(F.lit("n"), m).alias("node_id"), F.lit("ep0").alias("primary"))


@query("PRD-14 PRD-15 JOIN-11 PYC-06", f"WITH {CHUNKS} SELECT key, count(*) > 1 AND count(DISTINCT CASE WHEN endpoint = '' THEN 'ep0' ELSE endpoint END) > 1 AS fanout, bool_or(NOT (node_id = 'n0' OR endpoint = 'ep0')) AS remote FROM ch GROUP BY key")
def placement_fanout(spark, d):
    c = _chunks(spark, d)
    return placement.needs_fanout(c).join(placement.has_remote(c, "n0", "ep0"), "key")


@query("PRD-12 JOIN-12", """WITH p AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '/mnt/a/x' || page_id WHEN 1 THEN '/mnt/ab/y' WHEN 2 THEN '/mnt/a/sub/z' ELSE '/other' END AS path FROM pages)
SELECT page_id, path, CASE page_id % 4 WHEN 0 THEN '/mnt/a' WHEN 2 THEN '/mnt/a/sub' END AS root, CASE page_id % 4 WHEN 0 THEN 1 WHEN 2 THEN 2 ELSE 0 END AS ring, page_id % 4 IN (0, 2) AS managed FROM p""")
def longest_root(spark, d):
    m = F.col("page_id") % 4
    path = F.when(m == 0, F.concat(F.lit("/mnt/a/x"), F.col("page_id").cast("string"))).when(m == 1, "/mnt/ab/y").when(m == 2, "/mnt/a/sub/z").otherwise("/other")
    roots = spark.createDataFrame([("/mnt/z", 0), ("/mnt/a", 1), ("/mnt/a/sub", 2)], "root string, ring int")
    return lookup.longest_root(table(spark, d, "pages").select("page_id", path.alias("path")), roots).withColumn("managed", F.col("root").isNotNull())


@query("PRD-17 RDM-06", "SELECT l_orderkey, l_linenumber, (l_quantity - 10) * 1e8 > 0 AND (l_quantity - 10) * 1e8 <= 4294967296 AS let_in FROM lineitem")
def put_sizes(spark, d):
    size = ((F.col("l_quantity") - 10) * 100_000_000).cast("long")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", checks.put_size(size).alias("let_in"))


SIDES = "(VALUES ('read'), ('write'), ('notify'), (NULL)) o(operation), (VALUES ('dram'), ('vram')) a(local), (VALUES ('object'), ('file')) b(remote), (VALUES (1), (2)) c(n_local), (VALUES (1), (2)) e(n_remote)"


@query("PRD-16", f"""SELECT operation, local, remote, n_local, n_remote, CASE WHEN operation IS NULL OR operation = 'notify' OR local = 'vram' OR remote = 'file' THEN 'invalid_param' WHEN n_local = n_remote THEN 'ok' ELSE 'mismatch' END AS status FROM {SIDES}""")
def transfer_cases(spark, d):
    """Every combination of a transfer's inputs."""
    rows = list(itertools.product(("read", "write", "notify", None), ("dram", "vram"), ("object", "file"), (1, 2), (1, 2)))
    cases = spark.createDataFrame(rows, "operation string, local string, remote string, n_local int, n_remote int")
    return cases.select("*", checks.transfer(*(F.col(c) for c in cases.columns)).alias("status"))


@query("PRD-13", f"""WITH {OBJ} SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN 'unmanaged_path' WHEN doc_id % 4 = 2 THEN 'device_out_of_range' WHEN doc_id % 4 = 3 THEN 'handle_mismatch' ELSE 'ok' END AS status FROM obj""")
def chunk_handles(spark, d):
    """Each object's first chunk, with a handle outside all roots, a device that isn't there, or another generation's path."""
    from tessera.functions import keys

    i = F.col("doc_id")
    o = objects(spark, d)
    device = F.when(i % 4 == 2, F.lit(8)).otherwise((i % 8).cast("int"))
    root = F.concat(F.lit("/dev"), device.cast("string"))
    path = lambda g: keys.versioned_path(root, F.col("namespace"), F.col("object_key"), g, F.lit(1), F.lit(0))
    handle = F.when(i % 4 == 1, F.concat(F.lit("/tmp"), path(F.lit(3)))).when(i % 4 == 3, path(F.lit(2))).otherwise(path(F.lit(3)))
    managed = handle.startswith("/dev")
    return o.select("doc_id", checks.chunk_handle(handle, managed, device, 8, path(F.lit(3))).alias("status"))


@query("CON-14", f"""WITH {OBJ} SELECT doc_id, CASE WHEN doc_id % 3 > 0 AND size <= 500 THEN size END AS read, CASE WHEN doc_id % 3 > 0 AND size > 500 THEN 'target_too_small' END AS error FROM obj""")
def reads_into(spark, d):
    """Objects read into buffers of 500 bytes; every third isn't there."""
    size = F.when(F.col("doc_id") % 3 != 0, F.col("size"))
    return objects(spark, d).select("doc_id", checks.read_into(F.lit(500), size).alias("r")).select("doc_id", "r.read", "r.error")


@query("NAT-02 NAT-03", f"""WITH {ASKED}, {ORDERS} SELECT batch, pos, asked.key, CASE WHEN pos = 7 THEN -2 WHEN o.key IS NULL THEN -4 WHEN len(value) <> 8 THEN -6 ELSE 0 END AS got, CASE WHEN pos = 7 THEN -2 ELSE 0 END AS put,
0::BIGINT AS exists_size, o.key IS NOT NULL AND pos % 2 = 0 AS exists_found FROM asked LEFT JOIN o ON asked.key = o.key""")
def object_client_calls(spark, d):
    """Gets of eight bytes, puts, and existence by either transport; the seventh call of a batch gives an offset."""
    rows = lookup.batch_get(_asked(spark, d), _orders(spark, d), ["key"], "value")
    offset = F.when(F.col("pos") == 7, 5).otherwise(0)
    there = checks.object_exists(F.when(F.col("pos") % 2 == 0, "grpc").otherwise("rdma"), F.col("found"))
    return rows.select(
        "batch", "pos", "key", checks.object_get(offset, F.lit(8), F.octet_length("value")).alias("got"), checks.object_put(offset, F.lit(True)).alias("put"),
        there["size"].alias("exists_size"), there["found"].alias("exists_found"))


SLOTS = """sl AS (SELECT batch, pos, asked.key, CASE WHEN tier > 0 AND asked.key % 5 = 0 OR o.key IS NULL AND asked.key % 5 = 0 THEN 'storage' END AS error,
CASE WHEN tier = 0 THEN 'memory' WHEN tier > 0 AND asked.key % 5 > 0 THEN 'storage' END AS tier, value FROM asked LEFT JOIN o ON asked.key = o.key)"""


def _server(spark, d):
    o = _orders(spark, d)
    return lookup.server_batch_get(_asked(spark, d), o.where("tier = 0"), o, F.col("key") % 5 == 0, ["key"], "value")


@query("JOIN-04 API-01 MEM-01", f"WITH {ASKED}, {ORDERS}, {SLOTS} SELECT batch, pos, key, CASE WHEN tier IS NOT NULL THEN value END AS value, tier IS NOT NULL AS found, tier, error FROM sl")
def server_batches(spark, d):
    """Storage fails for every fifth key; what memory has is served all the same."""
    return _server(spark, d)[0]


@query("JOIN-04", f"WITH {ASKED}, {ORDERS}, {SLOTS} SELECT batch, count(*) FILTER (WHERE tier = 'memory') AS hits, count(*) FILTER (WHERE tier IS DISTINCT FROM 'memory') AS misses, count(error) AS errors FROM sl GROUP BY batch")
def server_counters(spark, d):
    return _server(spark, d)[1]


@query("API-12 AGG-10", f"WITH {ASKED}, {ORDERS}, {SLOTS} SELECT 'get' || (batch % 3) AS op, CASE WHEN error IS NOT NULL THEN 'INTERNAL' WHEN tier IS NULL THEN 'not_found' ELSE 'ok' END AS status, count(*) AS requests FROM sl GROUP BY ALL")
def request_outcomes(spark, d):
    calls = _server(spark, d)[0].withColumn("op", F.concat(F.lit("get"), (F.col("batch") % 3).cast("string")))
    return metrics.request_outcomes(calls)


@query("AGG-10", f"""WITH {ASKED}, {ORDERS}, {SLOTS} SELECT 'memory' AS "from", 'storage' AS "to", 'miss' AS reason, count(*) AS count FROM sl WHERE tier IS DISTINCT FROM 'memory'
UNION ALL SELECT 'storage', 'none', CASE WHEN error IS NULL THEN 'miss' ELSE 'error' END, count(*) FROM sl WHERE tier IS NULL GROUP BY 3""")
def read_fallbacks(spark, d):
    return metrics.fallbacks(_server(spark, d)[0])


@query("JOIN-04 MEM-01", f"WITH {ASKED}, {ORDERS}, {SLOTS} SELECT DISTINCT key, value FROM sl WHERE tier = 'storage'")
def server_fills(spark, d):
    return _server(spark, d)[2]


@query("AGG-03 SET-01", "SELECT DISTINCT key FROM (SELECT source AS key FROM documents UNION ALL SELECT split_part(url, '/', 3) FROM pages UNION ALL SELECT lang FROM documents) WHERE key IS NOT NULL")
def list_keys(spark, d):
    docs, pages = table(spark, d, "documents"), table(spark, d, "pages")
    return docs.select(F.col("source").alias("key")).union(pages.select(F.split_part("url", F.lit("/"), F.lit(3)))).union(docs.select("lang")).where("key is not null").distinct()


@query("SET-02", "SELECT doc_id FROM labels INTERSECT SELECT doc_id FROM documents")
def labelled_documents(spark, d):
    return table(spark, d, "labels").select("doc_id").intersect(table(spark, d, "documents").select("doc_id"))


@query("SET-03", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def unlabelled_documents(spark, d):
    return table(spark, d, "documents").select("doc_id").where("doc_id is not null").join(table(spark, d, "labels"), "doc_id", "left_anti")


@query("STR-05 PYC-07 LRU-06", """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'lookup_then_read' WHEN event_id % 7 = 0 THEN 'raise_lookup' WHEN event_id % 5 = 0 THEN 'miss_evict' WHEN event_id % 11 = 0 THEN 'reread' WHEN event_id % 13 = 0 THEN 'raise_read'
WHEN event_id % 17 = 0 THEN 'reread' WHEN event_id % 3 = 0 THEN 'return_read' WHEN event_id % 3 = 1 THEN 'return_read_refresh' ELSE 'reread' END AS action FROM events""")
def cached_reads(spark, d):
    i = F.col("event_id")
    look = F.when(i % 7 == 0, "error").when(i % 5 == 0, "missing").otherwise("ok")
    read = F.when(i % 11 == 0, "stale").when(i % 13 == 0, "error").when(i % 17 == 0, "none").otherwise("ok")
    same = F.when(i % 3 == 0, "same").when(i % 3 == 1, "layout_only").otherwise("changed")
    return table(spark, d, "events").select("event_id", lookup.cached_read(i % 4 != 0, look, same, read).alias("action"))
