"""Lookups that keep order and report misses, tier after tier; existence and universal probes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def get(objects: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    return wanted.join(objects, on, "inner")


def batch_get(asked: DataFrame, objects: DataFrame, on: list[str], value: str) -> DataFrame:
    """asked (pos, *on) -> with `value` (null on a miss) and `found`; pos keeps the order."""
    have = objects.select(*on, F.col(value), F.lit(True).alias("_found"))
    return asked.join(have, on, "left").select(*asked.columns, value, F.coalesce("_found", F.lit(False)).alias("found"))


def tiered_get(asked: DataFrame, tiers: list[tuple[str, DataFrame]], on: list[str], value: str) -> DataFrame:
    """The first tier that has a key answers: `value`, `tier` (null on a miss). A key asked twice is
    looked up once."""
    keys = asked.select(*on).distinct()
    found = keys
    for name, tier in tiers:
        found = found.join(tier.select(*on, F.col(value).alias(f"_{name}"), F.lit(name).alias(f"_in_{name}")), on, "left")
    first = F.coalesce(*(F.col(f"_in_{n}") for n, _ in tiers))
    best = F.coalesce(*(F.when(F.col(f"_in_{n}").isNotNull(), F.col(f"_{n}")) for n, _ in tiers))
    found = found.select(*on, best.alias(value), first.alias("tier"))
    return asked.join(found, on, "left").select(*asked.columns, value, "tier")


def exists(keys: DataFrame, objects: DataFrame, on: list[str]) -> DataFrame:
    return keys.join(objects.select(*on).distinct().withColumn("_hit", F.lit(True)), on, "left").select(*keys.columns, F.coalesce("_hit", F.lit(False)).alias("found"))


def routed_get(asked: DataFrame, objects: DataFrame, children: DataFrame, on: list[str], value: str) -> DataFrame:
    """asked has `child`; objects of a child that is down are misses."""
    up = children.where("up").select("child")
    return batch_get(asked, objects.join(up, "child", "left_semi"), on + ["child"], value)


def universal_probe(asked: DataFrame, layers: DataFrame, existing: DataFrame) -> DataFrame:
    """A key is a hit only if each of its layers exists. asked (key), layers (key, layer), existing (key,
    layer) -> key, n_layers, missing (sorted), hit."""
    rows = asked.join(layers, "key", "left").join(existing.select("key", "layer").distinct().withColumn("_hit", F.lit(True)), ["key", "layer"], "left")
    gone = F.when(F.col("_hit").isNull() & F.col("layer").isNotNull(), F.col("layer"))
    return rows.groupBy("key").agg(
        F.count("layer").alias("n_layers"), F.array_sort(F.collect_list(gone)).alias("missing"),
        (F.count(gone) == 0).alias("hit"))


def verified(meta: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """meta (key, path): objects of which every path is a file, and those to repair."""
    state = meta.join(files.select("path").distinct().withColumn("_there", F.lit(True)), "path", "left").groupBy("key").agg(F.bool_and(F.coalesce("_there", F.lit(False))).alias("whole"))
    return state.where("whole").select("key"), state.where("not whole").select("key")


def device_order(asked: DataFrame) -> DataFrame:
    """Reads grouped by device and in order of path within each, as they are best done."""
    return asked.repartition("device").sortWithinPartitions("device", "path")


def longest_root(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """paths (path) and roots (root, ring) -> the ring of the longest root that holds the path, else the
    first. Roots are joined by equality on the path's ancestors, not by comparing all with all."""
    depth = F.size(F.split("path", "/"))
    up = F.transform(F.sequence(F.lit(1), depth), lambda n: F.array_join(F.slice(F.split("path", "/"), 1, n), "/"))
    rows = paths.select("path").distinct().select("path", F.explode(up).alias("root")).join(roots, "root")
    best = rows.groupBy("path").agg(F.max_by(F.struct("root", "ring"), F.length("root")).alias("_b"))
    first = roots.agg(F.min("ring").alias("_first"))  # a single row
    return paths.join(best, "path", "left").join(F.broadcast(first)).select(*paths.columns, F.col("_b.root").alias("root"), F.coalesce("_b.ring", "_first").alias("ring"))


def load_specs(requests: DataFrame, blocks: DataFrame, block: int) -> DataFrame:
    """Blocks to load: what matches, as far as blocks are allocated."""
    n = F.least(F.floor(F.col("matched") / block), F.size("block_ids")).cast("int")
    return requests.join(blocks, "request").withColumn("n_blocks", n).where("n_blocks > 0").select("request", "n_blocks", F.slice("block_ids", 1, F.col("n_blocks")).alias("block_ids"))


def store_specs(requests: DataFrame, blocks: DataFrame, block: int) -> DataFrame:
    """Requests whose cacheable part isn't indexed yet: stored if all blocks are allocated, else deferred."""
    need = F.floor(F.col("n_tokens") / block).cast("int")
    rows = requests.join(blocks, "request").withColumn("need", need).where((F.col("need") > 0) & (F.col("matched") < F.col("need") * block))
    return rows.select("request", "need", (F.size("block_ids") < F.col("need")).alias("deferred"))


def identity_class(a: Column, b: Column) -> Column:
    """`same`, `layout_only` (content alike, layout changed) or `changed`, of two descriptor structs."""
    five = ["object_handle", "object_generation", "content_etag", "layout_version", "size"]
    three = ["object_generation", "content_etag", "size"]
    same = lambda names: F.struct(*(a[n] for n in names)).eqNullSafe(F.struct(*(b[n] for n in names)))
    return F.when(same(five), "same").when(same(three), "layout_only").otherwise("changed")


def placement_state(asked: Column, current: Column) -> Column:
    """Of an asked placement: missing key is an invalid argument; another key, epoch, policy or hash is stale."""
    other = F.lit(False)
    for n in ("placement_epoch", "placement_policy_id", "layout_hash"):
        other = other | ~asked[n].eqNullSafe(current[n])
    return F.when(asked.isNull(), "ok").when(asked["key"].isNull(), "invalid_argument").when((asked["key"] != current["key"]) | other, "stale").otherwise("ok")


def cached_read(cached: Column, lookup: Column, identity: Column, read: Column, strict: bool = True) -> Column:
    """What a read by a cached descriptor does. lookup: ok, missing or error; read: ok, none, stale (failed
    precondition or not found) or error; identity: identity_class of what was read and what is current."""
    failed = F.when(F.lit(strict), "raise_lookup").when(read == "ok", "return_read").otherwise("miss_evict")
    return (F.when(~cached, "lookup_then_read").when(lookup == "error", failed).when(lookup == "missing", "miss_evict")
            .when(read == "stale", "reread").when(read == "error", "raise_read").when(read == "none", "reread")
            .when(identity == "same", "return_read").when(identity == "layout_only", "return_read_refresh").otherwise("reread"))


def server_batch_get(asked: DataFrame, memory: DataFrame, storage: DataFrame, failing: Column, on: list[str], value: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A server's batch: (slots, counters, fills). slots: asked with `value`, `found`, `tier` and `error`, where
    storage fails for the asked row; an error fills its own slot alone. counters (batch): memory hits and
    misses, errors. fills: the keys and values that memory gains, once each."""
    slots = tiered_get(asked.withColumn("_fails", failing), [("memory", memory), ("storage", storage)], on, value)
    bad = F.col("_fails") & (F.coalesce("tier", F.lit("")) != "memory")
    slots = slots.select(
        *asked.columns, F.when(~bad, F.col(value)).alias(value), (F.col("tier").isNotNull() & ~bad).alias("found"),
        F.when(~bad, F.col("tier")).alias("tier"), F.when(bad, F.lit("storage")).alias("error"))
    hit = F.coalesce(F.col("tier") == "memory", F.lit(False))
    counters = slots.groupBy("batch").agg(F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses"), F.count("error").alias("errors"))
    return slots, counters, slots.where("tier = 'storage'").select(*on, value).dropDuplicates(on)
