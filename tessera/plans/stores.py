"""Queries that write objects and read them back: the store, shards, layer files and logs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.operators import striping
from tessera.plans import query
from tessera.plans.routes import md5_mod_sql
from tessera.plans.tables import OBJ, objects, table
from tessera.sources import files, metadata
from tessera.sources.shared import shared_dir
from tessera.sources.store import Store


def _place(spark) -> str:
    return f"{shared_dir(spark)}/tessera/store-{uuid.uuid4().hex}"


def _layer(rows, layer: str, data):
    return rows.select(F.col("c_custkey").cast("string").alias("key"), F.lit(layer).alias("layer"), data.alias("data"))


def _filled(spark, d, policy: str = "block") -> Store:
    """All customers are put; every third is put again, longer and with a second layer; every fifth is deleted,
    along with keys that aren't there; every tenth is put once more."""
    c = table(spark, d, "customer")
    store = Store(spark, _place(spark), shards=4, policy=policy, capacity=1 << 20)
    store.put(_layer(c, "l0", F.col("c_name")))
    third = c.where("c_custkey % 3 = 0")
    store.put(_layer(third, "l0", F.concat("c_name", "c_mktsegment")).unionByName(_layer(third, "l1", F.col("c_mktsegment"))))
    fifth = c.where("c_custkey % 5 = 0").select("c_custkey")
    store.delete(fifth.select(F.col("c_custkey").alias("key")).unionByName(fifth.select((F.col("c_custkey") + 100_000_000).alias("key"))))
    store.put(_layer(c.where("c_custkey % 10 = 0"), "l0", F.lit("again")))
    return store


STATE = """st AS (SELECT c_custkey::VARCHAR AS key, 'l0' AS layer, CASE WHEN c_custkey % 10 = 0 THEN 'again' WHEN c_custkey % 3 = 0 THEN c_name || c_mktsegment ELSE c_name END AS data FROM customer WHERE c_custkey % 5 > 0 OR c_custkey % 10 = 0
UNION ALL SELECT c_custkey::VARCHAR, 'l1', c_mktsegment FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 5 > 0)"""


@query("SRC-01 SRC-06 SRC-08 MUT-10 IOX-03", f"WITH {STATE} SELECT key, layer, data, octet_length(encode(data))::BIGINT AS size, {md5_mod_sql('key', 4)} AS shard FROM st")
def stored_objects(spark, d):
    return _filled(spark, d).objects().select("key", "layer", F.col("data").cast("string").alias("data"), "size", "shard")


@query("SRC-04 MUT-10", f"WITH {STATE} SELECT key, layer, {md5_mod_sql('layer', 4)} AS shard FROM st")
def stored_by_layer(spark, d):
    return _filled(spark, d, "layer").objects().select("key", "layer", "shard")


@query("SRC-01 SRC-03 AGG-01", f"WITH {STATE} SELECT sum(octet_length(encode(data)))::BIGINT AS used, 1048576::BIGINT AS capacity FROM st")
def stored_usage(spark, d):
    return _filled(spark, d).usage()


@query("SRC-01 SRC-06 AGG-03", f"WITH {STATE}, k AS (SELECT DISTINCT key FROM st), a AS (SELECT c_custkey::VARCHAR AS key FROM customer UNION ALL SELECT (c_custkey + 100000000)::VARCHAR FROM customer) SELECT a.key, k.key IS NOT NULL AS found FROM a LEFT JOIN k ON a.key = k.key")
def stored_exists(spark, d):
    k = table(spark, d, "customer").select(F.col("c_custkey").alias("key"))
    asked = k.unionByName(k.select((F.col("key") + 100_000_000).alias("key"))).select(F.col("key").cast("string").alias("key"))
    return _filled(spark, d).exists(asked)


@query("SRC-06 SRC-08 PYC-04", f"WITH {STATE}, a AS (SELECT c_custkey AS pos, c_custkey::VARCHAR AS key, CASE WHEN c_custkey % 2 = 0 THEN 'l0' ELSE 'l1' END AS layer FROM customer) SELECT pos, a.key, a.layer, st.data, st.key IS NOT NULL AS found FROM a LEFT JOIN st ON a.key = st.key AND a.layer = st.layer")
def stored_batch(spark, d):
    k = F.col("c_custkey")
    asked = table(spark, d, "customer").select(k.alias("pos"), k.cast("string").alias("key"), F.when(k % 2 == 0, "l0").otherwise("l1").alias("layer"))
    return _filled(spark, d).get_batch(asked).withColumn("data", F.col("data").cast("string"))


@query("SRC-10 MUT-06", """WITH v AS (SELECT n_nationkey::VARCHAR AS key, n_name AS old, n_name || '!' AS new FROM nation)
SELECT 'staged' AS reader, key, old AS data FROM v UNION ALL SELECT 'published', key, new FROM v""")
def atomic_commits(spark, d):
    """Readers before and after a second write gets its name; a third is staged and given up."""
    n = table(spark, d, "nation")
    store = Store(spark, _place(spark), shards=2)
    rows = n.select(F.col("n_nationkey").cast("string").alias("key"), F.lit("l").alias("layer"), F.col("n_name").cast("binary").alias("data"))
    store.put(rows)
    ready = rows.select("key", "layer", F.concat(F.col("data").cast("string"), F.lit("!")).cast("binary").alias("data"))
    hidden = store.stage(ready)
    before = store.objects().select(F.lit("staged").alias("reader"), "key", F.col("data").cast("string").alias("data"))
    before = spark.createDataFrame(before.collect(), before.schema)  # one row for each nation: what a reader saw then
    store.publish(hidden)
    store.stage(rows)
    return before.unionByName(store.objects().select(F.lit("published").alias("reader"), "key", F.col("data").cast("string").alias("data")))


@query("SRC-02 SRC-10 IOX-01", """WITH f AS (SELECT s_suppkey::VARCHAR AS key, 'l' || (s_suppkey % 2) AS layer, s_name AS data, s_suppkey::INT AS num_tokens FROM supplier WHERE s_suppkey % 4 > 0)
SELECT key, layer, data, octet_length(encode(data))::BIGINT AS size, num_tokens, 'float16' AS dtype FROM f""")
def layer_files(spark, d):
    """A file for each supplier's layer with metadata beside it, written twice, then a fourth deleted with keys that never were."""
    k = F.col("s_suppkey")
    s = table(spark, d, "supplier")
    rows = s.select(k.alias("key"), F.concat(F.lit("l"), (k % 2).cast("string")).alias("layer"), F.col("s_name").alias("data"), k.cast("int").alias("num_tokens"), F.lit("float16").alias("dtype"))
    root = _place(spark)
    for data in (F.lit("old"), F.col("data")):
        files.write_layers(rows.withColumn("data", data), root).agg(F.sum("size")).collect()
    gone = s.where("s_suppkey % 4 = 0").select(k.alias("key"))
    files.delete_layers(gone.unionByName(gone.select((F.col("key") + 100_000_000).alias("key"))), root).agg(F.count_if("existed")).collect()
    meta = files.read_meta(spark, root).select("key", "num_tokens", "dtype")
    return files.read_layers(spark, root).join(meta, "key").select("key", "layer", F.col("data").cast("string").alias("data"), "size", "num_tokens", "dtype")


@query("IOX-04 PLC-08 STG-02", "SELECT conv_id::VARCHAR AS key, sha256(string_agg(coalesce(text, ''), '' ORDER BY turn)) AS digest, sum(strlen(coalesce(text, '')))::BIGINT AS size FROM conversations GROUP BY conv_id")
def vectored_writes(spark, d):
    """The turns of a conversation as the segments of one value, joined and put."""
    c = table(spark, d, "conversations")
    segments = c.select(F.col("conv_id").cast("string").alias("key"), F.col("turn").alias("stripe_index"), F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    store = Store(spark, _place(spark), shards=4)
    store.put(striping.reassemble(segments).select("key", F.lit("v").alias("layer"), "data"))
    return store.objects().select("key", F.sha2("data", 256).alias("digest"), "size")


@query("CON-12 SRC-08", f"WITH {OBJ} SELECT object_key AS key, (doc_id % 50)::INT AS num_tokens, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE (doc_id % 3)::INT END AS num_layers, 'float16' AS dtype, '2,16,' || (doc_id % 8) AS shape, false AS compressed, 0 AS compression_level FROM obj")
def block_metadata(spark, d):
    """An adapter's metadata, stored beside the blocks and read back."""
    i = F.col("doc_id")
    o = objects(spark, d)
    meta = o.select(
        F.col("object_key").alias("key"), (i % 50).cast("int").alias("num_tokens"), F.when(i % 3 != 0, i % 3).cast("int").alias("num_layers"), F.lit("float16").alias("dtype"),
        F.array(F.lit(2), F.lit(16), (i % 8).cast("int")).alias("shape"), F.lit(None).cast("boolean").alias("compressed"), F.lit(None).cast("int").alias("compression_level"))
    store = Store(spark, _place(spark), shards=4)
    fields = [c for c in meta.columns if c != "key"]
    store.put(metadata.to_block_meta(meta).select("key", F.lit("b").alias("layer"), F.lit("x").alias("data"), F.struct(*fields).alias("meta")))
    return metadata.from_block_meta(store.meta()).select("key", "num_tokens", "num_layers", "dtype", F.array_join(F.transform("shape", lambda x: x.cast("string")), ",").alias("shape"), "compressed", "compression_level")


@query("SRC-15", "SELECT event_id::VARCHAR AS id, event_type AS op, user_id::VARCHAR AS user FROM events")
def perf_log(spark, d):
    """Lines of `KEY=VALUE` written to files and read back."""
    path = _place(spark)
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("op"), F.col("user_id").alias("user"))
    metadata.write_log(e, path)
    fields = F.col("fields")
    return metadata.read_log(spark, path).select(fields["ID"].alias("id"), fields["OP"].alias("op"), fields["USER"].alias("user"))
