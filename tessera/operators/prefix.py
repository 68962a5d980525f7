"""The prefix index: hash-chained block keys make a trie a flat table.

Index tables: keys (model, block_key) of registered blocks, counts (model, block_key, prefix_count)
of prefixes that end at or run through a block. A block matches while either knows it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import keys


def blocks(requests: DataFrame, block: int = keys.BLOCK, upto: Column | None = None) -> DataFrame:
    """requests (request, model, tokens) -> request, model, n_blocks, block_idx, block_key; only the
    blocks within `upto` tokens if given."""
    n = keys.block_count(F.col("tokens"), block)
    if upto is not None:
        n = F.least(n, F.floor(upto / block).cast("int"))
    rows = requests.withColumn("n_blocks", n).where("n_blocks > 0")
    rows = rows.select("request", "model", "tokens", "n_blocks", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("block_idx"))
    return rows.select("request", "model", "n_blocks", "block_idx", keys.block_key(F.col("tokens"), F.col("block_idx"), F.col("model"), block).alias("block_key"))


def register_blocks(index: DataFrame | None, requests: DataFrame, block: int = keys.BLOCK, upto: Column | None = None) -> DataFrame:
    """The keys with those of requests added."""
    new = blocks(requests, block, upto).select("model", "block_key")
    return (new if index is None else index.select("model", "block_key").unionByName(new)).dropDuplicates(["model", "block_key"])


def register_prefixes(requests: DataFrame, block: int = keys.BLOCK) -> DataFrame:
    """(model, block_key, prefix_count): how many registered prefixes run through each block."""
    return blocks(requests, block).groupBy("model", "block_key").agg(F.count(F.lit(1)).alias("prefix_count"))


def remove_blocks(index: DataFrame, removed: DataFrame) -> DataFrame:
    return index.join(removed.select("model", "block_key"), ["model", "block_key"], "left_anti")


def matchable(index: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Keys that match: registered ones, and those with a prefix count, which removal leaves."""
    own = index.select("model", "block_key")
    return own.distinct() if counts is None else own.unionByName(counts.where("prefix_count > 0").select("model", "block_key")).distinct()


def longest_prefix(requests: DataFrame, known: DataFrame, block: int = keys.BLOCK) -> DataFrame:
    """request, model, matched: tokens of the leading blocks that are all known. One exchange by key, one
    by request; the first gap is a minimum, so no sort is needed."""
    b = blocks(requests, block)
    hit = known.select("model", "block_key").distinct().withColumn("hit", F.lit(True))
    seen = b.join(hit, ["model", "block_key"], "left")
    gap = F.min(F.when(F.col("hit").isNull(), F.col("block_idx")))
    found = seen.groupBy("request").agg((F.coalesce(gap, F.max("n_blocks")) * block).cast("int").alias("matched"))
    return requests.select("request", "model").join(found, "request", "left").select("request", "model", F.coalesce("matched", F.lit(0)).alias("matched"))


def new_tokens(matched: Column, computed: Column, total: Column) -> Column:
    """What an external cache adds: at least one token is left to compute."""
    return F.greatest(F.lit(0), F.least(matched - computed, total - computed - 1))


def promote(matches: DataFrame, complete: DataFrame) -> DataFrame:
    """matches (request, matched, full) and complete (request, all_found) -> matched raised to the full
    length where every layer is found, and whether the request was promoted."""
    rows = matches.join(complete, "request", "left")
    up = (F.col("matched") < F.col("full")) & F.coalesce(F.col("all_found"), F.lit(False))
    return rows.select("request", F.when(up, F.col("full")).otherwise(F.col("matched")).alias("matched"), up.alias("promoted"))


def accumulate_blocks(events: DataFrame) -> DataFrame:
    """Block ids by request from ordered events (request, seq, kind, block_ids): `new` and `resumed` start
    over, `cached` extends. The last start is a maximum, what follows it is gathered in order."""
    start = events.where(F.col("kind").isin("new", "resumed")).groupBy("request").agg(F.max("seq").alias("start"))
    live = events.join(start, "request", "left").where(F.col("start").isNull() | (F.col("seq") >= F.col("start")))
    parts = F.array_sort(F.collect_list(F.struct("seq", "block_ids")))
    return live.groupBy("request").agg(F.flatten(F.transform(parts, lambda p: p["block_ids"])).alias("block_ids"))
