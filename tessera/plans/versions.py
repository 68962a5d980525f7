"""Queries of versioned objects."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import objects as ops
from tessera.plans import query
from tessera.plans.tables import table

PUT = "put AS (SELECT o_custkey AS key, o_orderkey AS seq, o_orderkey % 3 = 0 AS if_absent, o_orderpriority AS value FROM orders)"
DONE = """st AS (SELECT *, NOT if_absent OR row_number() OVER w = 1 AS stored FROM put WINDOW w AS (PARTITION BY key ORDER BY seq)),
done AS (SELECT *, CASE WHEN stored THEN sum(stored::INT) OVER (PARTITION BY key ORDER BY seq ROWS UNBOUNDED PRECEDING)::BIGINT END AS generation FROM st)"""


def _puts(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") % 3 == 0).alias("if_absent"), F.col("o_orderpriority").alias("value"))


def _versions(spark, d):
    return ops.apply_puts(_puts(spark, d)).where("stored").select("key", "generation", "seq", "value")


@query("MUT-01 MUT-02 MUT-03 MUT-12 API-02 PLC-05", f"WITH {PUT}, {DONE} SELECT key, seq, if_absent, value, stored, generation FROM done")
def applied_puts(spark, d):
    return ops.apply_puts(_puts(spark, d))


@query("MUT-01 WIN-03 STG-05 CON-03", f"WITH {PUT}, {DONE} SELECT key, max(generation) AS generation, arg_max(seq, generation) AS seq, arg_max(value, generation) AS value FROM done WHERE stored GROUP BY key")
def current_versions(spark, d):
    return ops.current(_versions(spark, d))


@query("MUT-02 MUT-04", f"""WITH {PUT}, j AS (SELECT put.*, CASE WHEN key % 2 = 0 THEN key % 10 + 1 END AS counter, CASE WHEN key % 4 = 0 THEN key % 7 + 1 END AS live FROM put),
st AS (SELECT *, greatest(coalesce(counter, 0), coalesce(live, 0)) AS base, count(*) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM j),
ok AS (SELECT *, CASE WHEN NOT if_absent THEN true WHEN live IS NOT NULL THEN false ELSE earlier = 0 END AS stored FROM st)
SELECT key, seq, stored, CASE WHEN stored THEN (base + count_if(stored) OVER (PARTITION BY key ORDER BY seq ROWS UNBOUNDED PRECEDING))::BIGINT END AS generation FROM ok""")
def continued_generations(spark, d):
    """Counters of every second key outlive its objects; those of every fourth are there."""
    k = table(spark, d, "orders").select(F.col("o_custkey").alias("key")).distinct()
    counters = k.where("key % 2 = 0").select("key", (F.col("key") % 10 + 1).alias("generation"))
    live = k.where("key % 4 = 0").select("key", (F.col("key") % 7 + 1).alias("generation"))
    return ops.apply_puts(_puts(spark, d), counters, live).select("key", "seq", "stored", "generation")


@query("MUT-02 WIN-04 MUT-14", f"WITH {PUT} SELECT key, min(seq) AS seq, arg_min(value, seq) AS value FROM put GROUP BY key")
def first_writers(spark, d):
    return ops.first_writer(_puts(spark, d).drop("if_absent"))


@query("MUT-14", "SELECT l_suppkey % 8 AS worker, l_orderkey AS prefix_key, min(l_linenumber) AS seq FROM lineitem GROUP BY 1, 2")
def first_stores(spark, d):
    return ops.first_store(table(spark, d, "lineitem").select((F.col("l_suppkey") % 8).alias("worker"), F.col("l_orderkey").alias("prefix_key"), F.col("l_linenumber").alias("seq")))


CUR = "cur AS (SELECT key, max(generation) AS generation FROM done WHERE stored GROUP BY key), want AS (SELECT key, CASE WHEN key % 2 = 0 THEN generation ELSE generation - 1 END AS generation FROM cur WHERE key % 3 <> 0)"


def _wanted(cur):
    return cur.where("key % 3 <> 0").select("key", F.when(F.col("key") % 2 == 0, F.col("generation")).otherwise(F.col("generation") - 1).alias("generation"))


@query("MUT-05 API-03", f"WITH {PUT}, {DONE}, {CUR} SELECT cur.key, cur.generation FROM cur LEFT JOIN want ON cur.key = want.key AND cur.generation = want.generation WHERE want.key IS NULL")
def compare_and_delete(spark, d):
    cur = ops.current(_versions(spark, d)).select("key", "generation")
    return ops.compare_and_delete(cur, _wanted(cur))[0]


@query("MUT-05 RDM-06", f"WITH {PUT}, {DONE}, {CUR} SELECT want.key, want.generation, cur.key IS NOT NULL AS deleted FROM want LEFT JOIN cur ON cur.key = want.key AND cur.generation = want.generation")
def compare_and_delete_outcome(spark, d):
    cur = ops.current(_versions(spark, d)).select("key", "generation")
    return ops.compare_and_delete(cur, _wanted(cur))[1]


@query("MUT-07 API-09 PLC-04", """WITH k AS (SELECT c_custkey AS key FROM customer UNION ALL SELECT c_custkey + 100000000 FROM customer WHERE c_custkey % 7 = 0)
SELECT key, key IN (SELECT o_custkey FROM orders) AS existed FROM k""")
def deleted_objects(spark, d):
    """All customers are deleted, and for each seventh a shifted key that isn't there."""
    keys = table(spark, d, "customer").select(F.col("c_custkey").alias("key"))
    return ops.delete(_puts(spark, d), keys.unionByName(keys.where("key % 7 = 0").select((F.col("key") + 100_000_000).alias("key"))))[1]


@query("MUT-13 API-06", f"WITH {PUT}, {DONE}, pin AS (SELECT key, generation FROM done WHERE stored AND generation = 1) SELECT pin.key, pin.generation, done.seq, done.value FROM pin JOIN done ON done.key = pin.key AND done.generation = pin.generation")
def pinned_versions(spark, d):
    v = _versions(spark, d)
    return ops.at_generation(v, v.where("generation = 1").select("key", "generation"))


@query("MUT-13 STG-08", f"WITH {PUT}, {DONE}, {CUR} SELECT done.key, count(*) AS old FROM done JOIN cur ON done.key = cur.key WHERE stored AND done.generation < cur.generation GROUP BY done.key")
def vacuumable_versions(spark, d):
    return ops.vacuum(_versions(spark, d)).groupBy("key").agg(F.count(F.lit(1)).alias("old"))


@query("MUT-06 MUT-03 RDM-06", f"""WITH c AS (SELECT o_custkey AS key, o_orderkey AS seq, o_orderkey % 3 = 0 AS if_absent, o_orderkey % 5 = 0 AS failed FROM orders),
b AS (SELECT *, coalesce(sum((NOT failed)::INT) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, row_number() OVER (PARTITION BY key ORDER BY seq) AS generation FROM c)
SELECT key, seq, if_absent, failed, CASE WHEN failed THEN 'rolled_back' WHEN if_absent AND before > 0 THEN 'lost_race' ELSE 'committed' END AS status, generation FROM b""")
def commit_outcomes(spark, d):
    return ops.commit_outcome(_puts(spark, d).drop("value").withColumn("failed", F.col("seq") % 5 == 0))


@query("MUT-09", "SELECT user_id AS key, arg_max(CASE WHEN event_type IN ('purchase', 'click') THEN 'chunks' ELSE 'single' END, event_id) AS form FROM events GROUP BY user_id")
def last_representations(spark, d):
    e = table(spark, d, "events")
    form = F.when(F.col("event_type").isin("purchase", "click"), "chunks").otherwise("single")
    return ops.last_representation(e.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), form.alias("form")))
