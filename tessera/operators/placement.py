"""Descriptors and placements of objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import xxh3


def descriptor(meta: DataFrame) -> DataFrame:
    """From (key, object_handle, object_generation, content_etag, layout_version, size, chunk_paths,
    chunk_size), null chunk_paths for a whole object."""
    striped = F.col("chunk_paths").isNotNull()
    return meta.select(
        "key", "object_handle", "object_generation", "content_etag", "layout_version", "size", striped.alias("is_striped"),
        F.when(striped, F.size("chunk_paths")).otherwise(0).alias("stripe_count"), F.when(striped, F.col("chunk_size")).otherwise(F.lit(0).cast("long")).alias("chunk_size"))


def needs_fanout(chunks: DataFrame) -> DataFrame:
    """chunks (key, endpoint, primary): more than one chunk, on more than one endpoint; an empty one is the primary."""
    at = F.coalesce(F.nullif("endpoint", F.lit("")), "primary")
    return chunks.groupBy("key").agg(((F.count(F.lit(1)) > 1) & (F.count_distinct(at) > 1)).alias("fanout"))


def has_remote(chunks: DataFrame, node: str, endpoint: str) -> DataFrame:
    local = (F.col("node_id") == node) | (F.col("endpoint") == endpoint)
    return chunks.groupBy("key").agg(F.bool_or(~local).alias("remote"))


def data_node(key: Column, stripe: Column, n: int) -> Column:
    """The node of a stripe: the key's own, then in turn."""
    return F.pmod(xxh3.xxh3_mod(key, n) + stripe, F.lit(n)).cast("int")


def data_nodes(configured: DataFrame, local: DataFrame) -> DataFrame:
    """configured (cluster, idx, node_id, grpc_endpoint), local (cluster, node_id, grpc_endpoint): the nodes of each
    cluster in order, an empty id being the endpoint; the local node where none is configured."""
    own = configured.select("cluster", "idx", F.coalesce(F.nullif("node_id", F.lit("")), "grpc_endpoint").alias("node_id"), "grpc_endpoint")
    alone = local.join(configured.select("cluster").distinct(), "cluster", "left_anti")
    return own.unionByName(alone.select("cluster", F.lit(0).cast("int").alias("idx"), "node_id", "grpc_endpoint"))


def stripe_locations(cut: DataFrame, nodes: int, devices: int, generation: Column, layout: Column) -> DataFrame:
    """cut (namespace, object_key, stripe_index, offset, length) -> the location that a write of each stripe
    gives back: its node, device and storage handle."""
    from tessera.functions import keys, routing

    canonical = keys.canonical_key(F.col("namespace"), F.col("object_key"))
    device = routing.chunk_device(xxh3.xxh3_mod(canonical, devices), F.col("stripe_index"), devices)
    handle = keys.versioned_path(F.concat(F.lit("/dev"), device.cast("string")), F.col("namespace"), F.col("object_key"), generation, layout, F.col("stripe_index"))
    return cut.select("namespace", "object_key", "stripe_index", "offset", "length", data_node(canonical, F.col("stripe_index"), nodes).alias("node"), device.alias("device"), handle.alias("storage_handle"))


def local_node(env: Column, config: Column, default: Column) -> Column:
    return F.coalesce(F.nullif(env, F.lit("")), F.nullif(config, F.lit("")), default)


def policy_id(strategy: str) -> str:
    return f"{strategy}_v1"


def epoch_seed(nodes: DataFrame, strategy: str, threshold: int, chunk: int, devices: int) -> DataFrame:
    """One row: the text that the placement epoch hashes, nodes (idx, node_id, grpc_endpoint, rdma_endpoint) in order."""
    each = F.array_sort(F.collect_list(F.struct("idx", "node_id", "grpc_endpoint", "rdma_endpoint")))
    parts = F.transform(each, lambda n: F.concat(F.lit("|node"), n["idx"].cast("string"), F.lit("="), F.concat_ws(":", n["node_id"], n["grpc_endpoint"], n["rdma_endpoint"])))
    head = f"policy={policy_id(strategy)}|striping_threshold={threshold}|striping_chunk_size={chunk}|devices={devices}"
    return nodes.agg(F.concat(F.lit(head), F.array_join(parts, "")).alias("seed"))


def epoch(seeds: DataFrame) -> DataFrame:
    """The epoch as 16 hex digits; never zero."""
    h = xxh3.xxh3_hex(F.col("seed"))
    return seeds.select(F.when(h == "0" * 16, "0" * 15 + "1").otherwise(h).alias("epoch_hex"))


def layout_hash(objects: DataFrame, chunks: DataFrame) -> DataFrame:
    """objects (key, generation, layout, epoch, policy) and chunks (key, stripe_index, node_id, device_id, offset,
    storage_handle) -> key, layout_hash."""
    each = F.array_sort(F.collect_list(F.struct("stripe_index", "node_id", "device_id", "offset", "storage_handle")))
    text = F.transform(each, lambda c: F.concat(F.lit("|"), F.concat_ws(":", c["stripe_index"].cast("string"), c["node_id"], c["device_id"].cast("string"), c["offset"].cast("string"), c["storage_handle"])))
    parts = chunks.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.array_join(text, "").alias("body"))
    rows = objects.join(parts, "key")
    seed = F.concat(F.col("key"), F.lit("|g"), F.col("generation").cast("string"), F.lit("|l"), F.col("layout").cast("string"), F.lit("|epoch"), F.col("epoch").cast("string"), F.lit("|"), F.col("policy"), F.lit("|"), F.col("n").cast("string"), F.col("body"))
    return rows.select("key", xxh3.xxh3_hex(seed).alias("layout_hash"))


def status_code(error: Column) -> Column:
    """Errors as status codes; whatever else is internal."""
    return F.when(error == "not_found", "NOT_FOUND").when(error == "already_exists", "ALREADY_EXISTS").when(error == "invalid_argument", "INVALID_ARGUMENT").when(error.isNull(), "OK").otherwise("INTERNAL")


def chunk_write(expected: Column, actual: Column) -> Column:
    """A chunk's length must be the expected one, where that isn't 0."""
    return F.when((expected > 0) & (expected != actual), "length_mismatch").otherwise("ok")


def rebuilt_layout(descriptors: DataFrame, devices: int) -> DataFrame:
    """descriptors (namespace, object_key, object_generation, layout_version, size, is_striped, stripe_count,
    chunk_size) -> status, and for valid ones the device and path of each stripe, as they were written."""
    from tessera.functions import keys, routing

    bad = (F.col("object_generation") <= 0) | (F.col("layout_version") <= 0)
    lacks = F.col("is_striped") & ((F.col("stripe_count") <= 0) | (F.col("chunk_size") <= 0))
    rows = descriptors.withColumn("status", F.when(bad, "bad_version").when(lacks, "no_layout").otherwise("ok"))
    rows = rows.withColumn("home", xxh3.xxh3_mod(keys.canonical_key(F.col("namespace"), F.col("object_key")), devices))
    n = F.when(F.col("status") != "ok", 0).when(F.col("is_striped"), F.col("stripe_count")).otherwise(1)
    rows = rows.withColumn("stripe_index", F.explode_outer(F.when(n > 0, F.sequence(F.lit(0), n - 1))))
    device = routing.chunk_device(F.col("home"), F.col("stripe_index"), devices)
    root, ns, key = F.concat(F.lit("/dev"), device.cast("string")), F.col("namespace"), F.col("object_key")
    g, v = F.col("object_generation"), F.col("layout_version")
    path = F.when(F.col("is_striped"), keys.versioned_path(root, ns, key, g, v, F.col("stripe_index"))).otherwise(keys.versioned_path(root, ns, key, g, v))
    return rows.select("namespace", "object_key", "status", "stripe_index", F.when(F.col("stripe_index").isNotNull(), device).alias("device"), F.when(F.col("stripe_index").isNotNull(), path).alias("path"))
