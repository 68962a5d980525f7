"""Queries of keys, digests and paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import keys, xxh3
from tessera.operators import placement
from tessera.plans import query
from tessera.plans.tables import BLK, BLOCK, OBJ, REQ, objects, requests, table
from tessera.plans.xxh3_sql import hex_sql


@query("KEY-01 KEY-03", f"WITH {REQ}, {BLK} SELECT request, block_idx, block_key FROM blk")
def key_blocks(spark, d):
    r = requests(spark, d)
    return r.select("request", F.posexplode(keys.block_keys(F.col("tokens"), F.col("model"), BLOCK)).alias("block_idx", "block_key"))


@query("KEY-03", f"WITH {REQ}, {BLK} SELECT request, block_idx, block_key FROM blk")
def key_blocks_linear(spark, d):
    r = requests(spark, d)
    return r.select("request", F.posexplode(keys.block_keys_linear(F.col("tokens"), F.col("model"), BLOCK)).alias("block_idx", "block_key"))


@query("KEY-02 PFX-09", f"WITH {REQ} SELECT request, len(tokens) // {BLOCK} * {BLOCK} AS cacheable, substr(sha256(model || ':' || array_to_string(tokens[1:len(tokens) // {BLOCK} * {BLOCK}], ',')), 1, 32) AS prefix_key FROM req")
def key_prefix(spark, d):
    r = requests(spark, d).withColumn("cacheable", keys.cacheable(F.col("tokens"), BLOCK))
    return r.select("request", "cacheable", keys.prefix_key(F.col("tokens"), F.col("cacheable"), F.col("model")).alias("prefix_key"))


@query("KEY-04 KEY-07 MEM-05 STG-11", f"WITH {OBJ} SELECT doc_id, strlen(namespace) || ':' || namespace || object_key AS canonical, namespace AS parsed_namespace, object_key AS parsed_key, md5(strlen(namespace) || ':' || namespace || object_key) AS digest FROM obj")
def key_canonical(spark, d):
    o = objects(spark, d).withColumn("canonical", keys.canonical_key(F.col("namespace"), F.col("object_key")))
    ns, key = keys.parse_canonical(F.col("canonical"))
    return o.select("doc_id", "canonical", ns.alias("parsed_namespace"), key.alias("parsed_key"), keys.object_digest(F.col("namespace"), F.col("object_key")).alias("digest"))


@query("KEY-05 SRC-08 CON-12", "SELECT page_id, 'kvbm:v1:' || url_encode(url) || ':model%2F' || (page_id % 3) || ':' || md5(url) || ':' || (CASE WHEN page_id % 4 = 0 THEN '-' ELSE url_encode('p/' || page_id) END) || ':tp' || (page_id % 8) || ':b' || (page_id % 100) AS storage_key FROM pages")
def key_block_store(spark, d):
    p = table(spark, d, "pages")
    prefix = F.when(F.col("page_id") % 4 == 0, "").otherwise(F.concat(F.lit("p/"), F.col("page_id").cast("string")))
    key = keys.block_store_key(F.lit("v1"), F.col("url"), F.concat(F.lit("model/"), (F.col("page_id") % 3).cast("string")), F.md5(F.col("url").cast("binary")), prefix, F.col("page_id") % 8, F.col("page_id") % 100)
    return p.select("page_id", key.alias("storage_key"))


@query("KEY-06 KEY-10", """SELECT l_orderkey, l_linenumber, strlen(l_orderkey::VARCHAR) || ':' || l_orderkey || 'blocks_' || l_quantity::INT || (CASE WHEN l_linenumber % 2 = 0 THEN '_tp' || (l_linenumber % 4) ELSE '' END) AS flat_key,
'blocks_' || l_quantity::INT || (CASE WHEN l_linenumber % 2 = 0 THEN '_tp' || (l_linenumber % 4) ELSE '' END) || '_p' || (l_linenumber % 8) || 'of8' AS lane FROM lineitem""")
def key_layers(spark, d):
    t = table(spark, d, "lineitem")
    layer = keys.layer_name(F.col("l_quantity").cast("int"), F.col("l_linenumber") % 4, F.when(F.col("l_linenumber") % 2 == 0, 4).otherwise(1))
    return t.select("l_orderkey", "l_linenumber", keys.backend_key(F.col("l_orderkey").cast("string"), layer).alias("flat_key"), keys.lane_name(layer, F.col("l_linenumber") % 8, F.lit(8)).alias("lane"))


@query("KEY-11", "SELECT page_id, CASE WHEN regexp_replace(url, '[^A-Za-z0-9._-]', '_', 'g') IN ('', '.', '..') THEN '_' ELSE regexp_replace(url, '[^A-Za-z0-9._-]', '_', 'g') END AS safe FROM pages")
def key_path_component(spark, d):
    return table(spark, d, "pages").select("page_id", keys.path_component(F.col("url")).alias("safe"))


@query("KEY-12", "SELECT page_id, CASE WHEN starts_with(e, 'http://') OR starts_with(e, 'https://') THEN e ELSE 'http://' || e END AS uri FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE split_part(url, '://', 2) END AS e FROM pages)")
def key_endpoint_uri(spark, d):
    e = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.split_part("url", F.lit("://"), F.lit(2)))
    return table(spark, d, "pages").select("page_id", keys.endpoint_uri(e).alias("uri"))


def crc_sql(x: str) -> str:
    """CRC-32 of a text's bytes, with the table of its polynomial."""
    table = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    # the first element is the state, the others are bytes
    values = f"list_concat([4294967295::BIGINT], list_transform(range(octet_length(encode({x}))), lambda i: ('0x' || hex(encode({x})[i + 1 : i + 1]))::BIGINT))"
    return f"xor(list_reduce({values}, lambda c, b: xor(c >> 8, list_extract({table}, (xor(c, b) & 255) + 1)::BIGINT)), 4294967295::BIGINT)"


@query("KEY-13", f"WITH {OBJ} SELECT doc_id, (({crc_sql('object_key')} & 2147483647) + 1) AS device FROM obj")
def key_device_number(spark, d):
    return objects(spark, d).select("doc_id", keys.device_number(F.col("object_key")).alias("device"))


PATHS = f"""WITH {OBJ}, g AS (SELECT *, md5(strlen(namespace) || ':' || namespace || object_key) AS h, '/dev' || (doc_id % 4) AS root, doc_id % 5 + 1 AS generation FROM obj),
p AS (SELECT *, root || '/data/' || (CASE WHEN namespace = '' THEN '_' ELSE regexp_replace(namespace, '[^A-Za-z0-9._-]', '_', 'g') END) || '/' || h[1:2] || '/' || h[3:4] || '/' || h[5:] AS stem FROM g)
SELECT doc_id, stem || '.g' || generation || '.l1.bin' AS versioned, stem || '.g' || generation || '.l1.chunk' || (doc_id % 3) || '.bin' AS chunk, stem || '.bin' AS plain FROM p"""


@query("SRC-09 STG-10 PRD-13", PATHS)
def key_paths(spark, d):
    root, ns, key = F.concat(F.lit("/dev"), (F.col("doc_id") % 4).cast("string")), F.col("namespace"), F.col("object_key")
    g = F.col("doc_id") % 5 + 1
    return objects(spark, d).select("doc_id", keys.versioned_path(root, ns, key, g, F.lit(1)).alias("versioned"), keys.versioned_path(root, ns, key, g, F.lit(1), F.col("doc_id") % 3).alias("chunk"), keys.plain_path(root, ns, key).alias("plain"))


CANONICAL = "strlen(namespace) || ':' || namespace || object_key"


@query("KEY-08 KEY-09 STG-01", f"""WITH {OBJ}, k AS (SELECT *, {CANONICAL} AS c, doc_id % 5 + 1 AS g FROM obj),
s AS (SELECT *, c || '|generation=' || g || '|size=' || size || '|created_at=' || created_at AS e, c || '|generation=' || g || '|layout=1|size=' || size || '|created_at=' || created_at AS o FROM k)
SELECT doc_id, {hex_sql('e')} AS content_etag, 'ctxobj-v1-' || md5(c) || '-g' || g || '-l1-' || {hex_sql('o')} AS object_handle FROM s""")
def key_etag_and_handle(spark, d):
    o = objects(spark, d).withColumn("canonical", keys.canonical_key(F.col("namespace"), F.col("object_key"))).withColumn("generation", F.col("doc_id") % 5 + 1)
    return o.select(
        "doc_id", xxh3.content_etag(F.col("canonical"), F.col("generation"), F.col("size"), F.col("created_at")).alias("content_etag"),
        xxh3.object_handle(F.col("canonical"), F.col("generation"), F.lit(1), F.col("size"), F.col("created_at")).alias("object_handle"))


@query("KEY-09", f"WITH {OBJ} SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'h' || doc_id ELSE 'v1:' || strlen(namespace) || ':' || namespace || object_key || ':g' || (doc_id % 5 + 1) || ':l1' END AS handle FROM obj")
def key_handle_fallback(spark, d):
    given = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("h"), F.col("doc_id").cast("string"))).otherwise("")
    return objects(spark, d).select("doc_id", xxh3.handle_or_fallback(given, keys.canonical_key(F.col("namespace"), F.col("object_key")), F.col("doc_id") % 5 + 1, F.lit(1)).alias("handle"))


def _nodes(spark, d):
    s = table(spark, d, "supplier")
    name = F.col("s_suppkey").cast("string")
    return s.select(F.col("s_suppkey").alias("idx"), F.concat(F.lit("node-"), name).alias("node_id"), F.concat(F.lit("10.0.0."), name).alias("grpc_endpoint"), F.concat(F.lit("10.1.0."), name).alias("rdma_endpoint"))


EPOCH_SEED = """SELECT 'policy=hash_v1|striping_threshold=1024|striping_chunk_size=512|devices=4' || string_agg('|node' || s_suppkey || '=node-' || s_suppkey || ':10.0.0.' || s_suppkey || ':10.1.0.' || s_suppkey, '' ORDER BY s_suppkey) AS seed FROM supplier"""


@query("KEY-14", EPOCH_SEED)
def placement_epoch_seed(spark, d):
    return placement.epoch_seed(_nodes(spark, d), "hash", 1024, 512, 4)


@query("KEY-14 PLC-07", f"WITH s AS ({EPOCH_SEED}) SELECT CASE WHEN h = '0000000000000000' THEN '0000000000000001' ELSE h END AS epoch_hex FROM (SELECT {hex_sql('seed')} AS h FROM s)")
def placement_epoch(spark, d):
    return placement.epoch(placement.epoch_seed(_nodes(spark, d), "hash", 1024, 512, 4))


@query("KEY-15", f"""WITH c AS (SELECT l_orderkey::VARCHAR AS key, l_linenumber AS n FROM lineitem),
s AS (SELECT key, key || '|g1|l1|epoch7|hash_v1|' || count(*) || string_agg('|' || n || ':node-' || (n % 3) || ':' || (n % 4) || ':' || (n * 512) || ':/d' || n, '' ORDER BY n) AS seed FROM c GROUP BY key)
SELECT key, {hex_sql('seed')} AS layout_hash FROM s""")
def placement_layout_hash(spark, d):
    t = table(spark, d, "lineitem").withColumn("key", F.col("l_orderkey").cast("string"))
    o = t.select("key").distinct().select("key", F.lit(1).alias("generation"), F.lit(1).alias("layout"), F.lit(7).alias("epoch"), F.lit("hash_v1").alias("policy"))
    n = F.col("l_linenumber")
    c = t.select("key", n.alias("stripe_index"), F.concat(F.lit("node-"), (n % 3).cast("string")).alias("node_id"), (n % 4).alias("device_id"), (n * 512).alias("offset"), F.concat(F.lit("/d"), n.cast("string")).alias("storage_handle"))
    return placement.layout_hash(o, c)


@query("SRC-12 STG-09", f"WITH {OBJ} SELECT doc_id, lower(hex(object_key)) AS file FROM obj")
def key_hex_name(spark, d):
    return objects(spark, d).select("doc_id", keys.hex_name(F.col("object_key")).alias("file"))


@query("CON-13", "SELECT p_partkey, p_size * (CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 1024 WHEN 2 THEN 1048576 ELSE 1073741824 END)::BIGINT AS bytes FROM part")
def parse_sizes(spark, d):
    unit = F.element_at(F.array(*map(F.lit, ("", "k", "m", "G"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", keys.parse_size(F.concat(F.col("p_size").cast("string"), unit)).alias("bytes"))
