"""The tables that queries read, as objects, requests and traces; in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.shared import spread

BLOCK = 4
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def requests(spark: SparkSession, d: str) -> DataFrame:
    """A prompt for each turn: a word's token is the first 28 bits of its md5."""
    token = lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 7), 16, 10).cast("long")
    t = spread(table(spark, d, "conversations").select("conv_id", "turn", "text"))
    return t.select(
        F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("request"), F.concat(F.lit("m"), (F.col("conv_id") % 2).cast("string")).alias("model"),
        "conv_id", "turn", F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), 0), token).alias("tokens"))


REQ = f"""req AS (SELECT conv_id || '/' || turn AS request, 'm' || (conv_id % 2) AS model, conv_id, turn,
  list_transform(regexp_extract_all(coalesce(text, ''), '{WORD}'), lambda w: ('0x' || substr(md5(w), 1, 7))::BIGINT) AS tokens FROM conversations)"""
BLK = f"""blk AS (SELECT request, model, conv_id, turn, n_blocks, block_idx, substr(sha256(model || ':' || array_to_string(tokens[1:(block_idx + 1) * {BLOCK}], ',')), 1, 32) AS block_key
  FROM (SELECT *, len(tokens) // {BLOCK} AS n_blocks, unnest(range(len(tokens) // {BLOCK})) AS block_idx FROM req))"""


def objects(spark: SparkSession, d: str) -> DataFrame:
    """Documents as objects: namespace is the language, the key the source with the id."""
    t = table(spark, d, "documents")
    key = F.concat_ws("/", F.coalesce("source", F.lit("")), F.col("doc_id").cast("string"))
    return t.select("doc_id", F.coalesce("lang", F.lit("")).alias("namespace"), key.alias("object_key"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"), (F.lit(1_700_000_000) + F.col("doc_id")).alias("created_at"))


OBJ = "obj AS (SELECT doc_id, coalesce(lang, '') AS namespace, coalesce(source, '') || '/' || doc_id AS object_key, strlen(coalesce(text, ''))::BIGINT AS size, 1700000000 + doc_id AS created_at FROM documents)"


def calls(spark: SparkSession, d: str) -> DataFrame:
    """Events as calls: an error is a failure, the user's number modulo 8 the child."""
    t = table(spark, d, "events")
    return t.select(
        (F.col("user_id") % 8).cast("long").alias("child"), F.col("event_id").alias("seq"), (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("ts"), (F.col("event_type") != "error").alias("ok"),
        F.col("event_type").alias("op"), "user_id", "value")


def accesses(spark: SparkSession, d: str) -> DataFrame:
    """Events as accesses to eight caches: purchases put, sign-ups delete, all else gets."""
    t = table(spark, d, "events")
    op = F.when(F.col("event_type") == "purchase", "put").when(F.col("event_type") == "signup", "delete").otherwise("get")
    return t.select(F.concat(F.lit("c"), (F.col("user_id") % 8).cast("string")).alias("cache"), F.col("event_id").alias("seq"), op.alias("op"), F.concat(F.lit("k"), (F.col("event_id") * 7919 % 37).cast("string")).alias("key"), (F.floor(F.col("value")) + 1).cast("long").alias("size"))
