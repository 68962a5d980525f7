"""Object metadata as JSON values of a key-value store, configurations, and line logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

META = (
    "device_id int, file_path string, size bigint, object_handle string, object_generation bigint, content_etag string, layout_version bigint, "
    "created_at bigint, last_accessed_at bigint, ttl_seconds bigint, num_tokens int, num_layers int, dtype string, compressed boolean, "
    "striping struct<chunk_size:bigint,chunk_devices:array<int>,chunk_paths:array<string>,total_size:bigint>"
)


def to_entries(meta: DataFrame, prefix: str = "") -> DataFrame:
    """key and metadata columns -> entries (name, value): JSON values and generation counters."""
    body = meta.select("key", F.to_json(F.struct(*(c for c in meta.columns if c != "key"))).alias("value"), "object_generation")
    values = body.select(F.concat(F.lit(f"{prefix}block_meta:"), "key").alias("name"), "value")
    return values.unionByName(body.select(F.concat(F.lit(f"{prefix}generation:"), "key").alias("name"), F.col("object_generation").cast("string").alias("value")))


def from_entries(entries: DataFrame, prefix: str = "") -> DataFrame:
    """The metadata of entries; fields that a value lacks are null. A key's counter outlives its value."""
    head = f"{prefix}block_meta:"
    rows = entries.where(F.col("name").startswith(head))
    return rows.select(F.substring("name", len(head) + 1, 1 << 30).alias("key"), F.from_json("value", META).alias("m")).select("key", "m.*")


def counters(entries: DataFrame, prefix: str = "") -> DataFrame:
    head = f"{prefix}generation:"
    return entries.where(F.col("name").startswith(head)).select(F.substring("name", len(head) + 1, 1 << 30).alias("key"), F.col("value").cast("long").alias("generation"))


def with_defaults(meta: DataFrame, now: int) -> DataFrame:
    """Missing metadata is bfloat16 with zeros; a creation time is kept only if positive."""
    return meta.select(
        "key", F.when(F.col("created_at") > 0, F.col("created_at")).otherwise(F.lit(now)).alias("created_at"), F.coalesce("num_tokens", F.lit(0)).alias("num_tokens"),
        F.coalesce("num_layers", F.lit(0)).alias("num_layers"), F.coalesce("dtype", F.lit("bfloat16")).alias("dtype"), F.coalesce("compressed", F.lit(False)).alias("compressed"))


#: Known fields of a configuration and their defaults; other fields are dropped.
FIELDS = {"block_size": "16", "storage_capacity_gb": "0", "kv_service_timeout_ms": "1000"}


def resolve_config(settings: DataFrame) -> DataFrame:
    """settings (config, origin native, nested or dotted, name, value): native wins over nested over dotted;
    unknown names are dropped and known ones that are missing take their defaults."""
    rank = F.when(F.col("origin") == "native", 0).when(F.col("origin") == "nested", 1).otherwise(2)
    best = settings.where(F.col("name").isin(*FIELDS)).groupBy("config", "name").agg(F.min_by("value", rank).alias("value"))
    known = F.create_map(*[F.lit(x) for kv in FIELDS.items() for x in kv])
    every = settings.select("config").distinct().select("config", F.explode(known).alias("name", "default"))
    return every.join(best, ["config", "name"], "left").select("config", "name", F.coalesce("value", "default").alias("value"))


#: Rules of a server configuration: the name and the condition that breaks it.
RULES = {
    "devices": "coalesce(n_devices, 0) < 1",
    "endpoint": "coalesce(endpoint, '') = ''",
    "strategy": "strategy NOT IN ('hash', 'round_robin')",
    "executor": "executor NOT IN ('tier_a', 'tier_b', 'tier_c')",
    "metadata": "metadata_url NOT LIKE 'redis://%' AND metadata_url NOT LIKE 'memory://%'",
}


def violations(configs: DataFrame) -> DataFrame:
    """configs (config, ...) -> config, rule: every rule that is broken."""
    broken = F.array_compact(F.array(*(F.when(F.expr(cond), F.lit(name)) for name, cond in RULES.items())))
    return configs.select("config", F.explode(broken).alias("rule"))


def backend_kind(configs: DataFrame) -> DataFrame:
    """The backend a configuration asks for, wrapped by a memory tier where it has a capacity."""
    kind = F.when(F.col("n_endpoints") >= 2, "ha").when(F.col("n_endpoints") == 1, "remote").when(F.col("n_paths") > 1, "sharded").otherwise("local")
    return configs.select("config", kind.alias("kind"), (F.col("memory_bytes") > 0).alias("memory_tier"))


def to_block_meta(blocks: DataFrame) -> DataFrame:
    """An adapter's block metadata as storage metadata: `extra` has no place there."""
    return blocks.select("key", *(F.col(c) for c in BLOCK_FIELDS))


def from_block_meta(meta: DataFrame) -> DataFrame:
    """Storage metadata as an adapter's: absent fields take its defaults, `extra` is empty."""
    filled = [F.coalesce(F.col(c), F.lit(v)).alias(c) if v is not None else F.col(c) for c, v in BLOCK_FIELDS.items()]
    return meta.select("key", *filled, F.create_map().cast("map<string,string>").alias("extra"))


#: Fields of a block's metadata and their defaults.
BLOCK_FIELDS = {"num_tokens": None, "num_layers": 1, "dtype": None, "shape": None, "compressed": False, "compression_level": 0}


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Lines of `KEY=VALUE ...` -> a map for each."""
    return spark.read.text(path).select(F.expr("str_to_map(value, ' ', '=')").alias("fields"))


def write_log(rows: DataFrame, path: str) -> None:
    """Columns as `NAME=value` in order."""
    rows.select(F.concat_ws(" ", *(F.concat(F.lit(c.upper() + "="), F.col(c).cast("string")) for c in rows.columns)).alias("value")).write.text(path)


def nano_text(ns) -> object:
    """Nanoseconds since the epoch as ISO text with nine digits."""
    seconds = F.floor(ns / 1_000_000_000)
    return F.concat(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), F.lpad(F.pmod(ns, F.lit(1_000_000_000)).cast("string"), 9, "0"))
