"""Queries of configuration, metadata and positional writes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import placement
from tessera.plans import query
from tessera.plans.tables import table
from tessera.sources import files, metadata


@query("KEY-17 PLC-09", "SELECT o_orderkey AS key, CASE WHEN o_orderkey % 4 = 0 THEN 1700000000 ELSE o_orderkey END AS created_at, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey % 100 END AS num_tokens, 0 AS num_layers, CASE WHEN o_orderkey % 3 = 0 THEN 'bfloat16' ELSE 'float16' END AS dtype, false AS compressed FROM orders")
def metadata_defaults(spark, d):
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").select(
        k.alias("key"), F.when(k % 4 != 0, k).alias("created_at"), F.when(k % 3 != 0, k % 100).alias("num_tokens"), F.lit(None).cast("int").alias("num_layers"),
        F.when(k % 3 != 0, "float16").alias("dtype"), F.lit(None).cast("boolean").alias("compressed"))
    return metadata.with_defaults(o, 1_700_000_000)


@query("SRC-11 STG-11", "SELECT o_orderkey::VARCHAR AS key, o_custkey AS size, o_orderkey % 5 + 1 AS object_generation, o_orderpriority AS dtype FROM orders")
def metadata_entries(spark, d):
    """To JSON entries and back."""
    meta = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("key"), F.col("o_custkey").alias("size"), (F.col("o_orderkey") % 5 + 1).alias("object_generation"), F.col("o_orderpriority").alias("dtype"))
    return metadata.from_entries(metadata.to_entries(meta, "x:"), "x:").select("key", "size", "object_generation", "dtype")


SETTINGS = """s AS (SELECT c_custkey AS config, CASE c_custkey % 3 WHEN 0 THEN 'native' WHEN 1 THEN 'nested' ELSE 'dotted' END AS origin, CASE c_custkey % 4 WHEN 0 THEN 'block_size' WHEN 1 THEN 'kv_service_timeout_ms' ELSE 'other' END AS name, c_custkey::VARCHAR AS value FROM customer)"""


@query("RTE-15 CON-13", f"""WITH {SETTINGS}, t AS (SELECT config // 5 AS config, CASE origin WHEN 'native' THEN 0 WHEN 'nested' THEN 1 ELSE 2 END AS rank, name, value FROM s), n(name, def) AS (VALUES ('block_size', '16'), ('storage_capacity_gb', '0'), ('kv_service_timeout_ms', '1000')),
b AS (SELECT config, name, arg_min(value, rank * 1000000 + value::INT) AS value FROM t GROUP BY config, name)
SELECT c.config, n.name, coalesce(b.value, def) AS value FROM (SELECT DISTINCT config FROM t) c CROSS JOIN n LEFT JOIN b ON b.config = c.config AND b.name = n.name""")
def resolved_config(spark, d):
    k = F.col("c_custkey")
    origin = F.when(k % 3 == 0, "native").when(k % 3 == 1, "nested").otherwise("dotted")
    name = F.when(k % 4 == 0, "block_size").when(k % 4 == 1, "kv_service_timeout_ms").otherwise("other")
    s = table(spark, d, "customer").select(F.floor(k / 5).alias("config"), origin.alias("origin"), name.alias("name"), k.cast("string").alias("value"))
    # one value for each origin, as a configuration has
    s = s.groupBy("config", "origin", "name").agg(F.min_by("value", F.col("value").cast("int")).alias("value"))
    return metadata.resolve_config(s)


@query("SRC-14", """WITH c AS (SELECT s_suppkey AS config, s_suppkey % 3 AS n_devices, CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE 'e' END AS endpoint, CASE WHEN s_suppkey % 5 = 0 THEN 'random' ELSE 'hash' END AS strategy FROM supplier)
SELECT config, unnest(list_filter([CASE WHEN n_devices < 1 THEN 'devices' END, CASE WHEN endpoint = '' THEN 'endpoint' END, CASE WHEN strategy = 'random' THEN 'strategy' END], lambda x: x IS NOT NULL)) AS rule FROM c""")
def config_violations(spark, d):
    k = F.col("s_suppkey")
    c = table(spark, d, "supplier").select(
        k.alias("config"), (k % 3).alias("n_devices"), F.when(k % 4 == 0, "").otherwise("e").alias("endpoint"), F.when(k % 5 == 0, "random").otherwise("hash").alias("strategy"),
        F.lit("tier_a").alias("executor"), F.lit("memory://x").alias("metadata_url"))
    return metadata.violations(c)


@query("RTE-16", "SELECT s_suppkey AS config, CASE WHEN s_suppkey % 4 >= 2 THEN 'ha' WHEN s_suppkey % 4 = 1 THEN 'remote' WHEN s_suppkey % 3 > 1 THEN 'sharded' ELSE 'local' END AS kind, s_suppkey % 2 > 0 AS memory_tier FROM supplier")
def backend_kinds(spark, d):
    k = F.col("s_suppkey")
    return metadata.backend_kind(table(spark, d, "supplier").select(k.alias("config"), (k % 4).alias("n_endpoints"), (k % 3).alias("n_paths"), (k % 2).alias("memory_bytes")))


@query("PLC-06", "SELECT s_suppkey AS node, CASE WHEN s_suppkey % 3 = 0 THEN 'env' || s_suppkey WHEN s_suppkey % 3 = 1 THEN 'cfg' ELSE 'local' END AS node_id FROM supplier")
def local_nodes(spark, d):
    k = F.col("s_suppkey")
    env = F.when(k % 3 == 0, F.concat(F.lit("env"), k.cast("string"))).otherwise("")
    return table(spark, d, "supplier").select(k.alias("node"), placement.local_node(env, F.when(k % 3 == 1, "cfg"), F.lit("local")).alias("node_id"))


@query("PLC-07", """WITH c AS (SELECT s_nationkey AS cluster, (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1)::INT AS idx, CASE WHEN s_suppkey % 3 = 0 THEN 'ep' || s_suppkey ELSE 'n' || s_suppkey END AS node_id, 'ep' || s_suppkey AS grpc_endpoint FROM supplier WHERE s_nationkey % 2 = 0)
SELECT * FROM c UNION ALL SELECT n_nationkey, 0, 'local', 'ep' FROM nation WHERE n_nationkey NOT IN (SELECT cluster FROM c)""")
def data_nodes(spark, d):
    """Nations as clusters with their suppliers as nodes; odd ones have none configured."""
    k = F.col("s_suppkey").cast("string")
    s = table(spark, d, "supplier").where("s_nationkey % 2 = 0")
    w = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    nodes = s.select(F.col("s_nationkey").alias("cluster"), (F.row_number().over(w) - 1).alias("idx"), F.when(F.col("s_suppkey") % 3 == 0, "").otherwise(F.concat(F.lit("n"), k)).alias("node_id"), F.concat(F.lit("ep"), k).alias("grpc_endpoint"))
    local = table(spark, d, "nation").select(F.col("n_nationkey").alias("cluster"), F.lit("local").alias("node_id"), F.lit("ep").alias("grpc_endpoint"))
    return placement.data_nodes(nodes, local)


@query("SRC-12", """WITH v AS (SELECT n_nationkey, hex(n_name) AS h FROM nation)
SELECT lower(hex(n_nationkey::VARCHAR)) AS file, h[1:4] || '5858' || h[9:] || repeat('0', greatest(20 - len(h), 0)) AS data FROM v""")
def positional_writes(spark, d):
    """XX at byte 2 of each name, and an empty write at byte 10 that extends shorter ones by zero bytes."""
    n = table(spark, d, "nation")
    k = F.col("n_nationkey").cast("string")
    values = n.select(k.alias("key"), F.col("n_name").cast("binary").alias("data"))
    first = n.select(k.alias("key"), F.lit(1).cast("long").alias("seq"), F.lit(2).cast("long").alias("at"), F.lit("XX").cast("binary").alias("data"))
    last = n.select(k.alias("key"), F.lit(2).cast("long").alias("seq"), F.lit(10).cast("long").alias("at"), F.lit("").cast("binary").alias("data"))
    return files.overlay(values, first.unionByName(last)).select("file", F.hex("data").alias("data"))


@query("SRC-15", "SELECT event_id, split_part(trim(replace(replace(props, '{\"k\": ', 'K='), '}', '')), '=', 2) AS k FROM events")
def log_fields(spark, d):
    """`KEY=VALUE` lines as maps; here from a column, as read_log does from files."""
    line = F.concat(F.lit("ID="), F.col("event_id").cast("string"), F.lit(" K="), F.get_json_object("props", "$.k"))
    return table(spark, d, "events").select("event_id", F.str_to_map(line, F.lit(" "), F.lit("="))["K"].alias("k"))
