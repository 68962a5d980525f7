"""Queries of rates, latencies and capacities."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import routing
from tessera.operators import metrics
from tessera.plans import query
from tessera.plans.routes import md5_mod_sql
from tessera.plans.tables import OBJ, objects, table


@query("AGG-01", f"WITH {OBJ} SELECT namespace, sum(size)::BIGINT AS used, 1048576 AS capacity FROM obj GROUP BY namespace")
def capacity_by_namespace(spark, d):
    return objects(spark, d).groupBy("namespace").agg(F.sum("size").alias("used"), F.lit(1_048_576).alias("capacity"))


@query("AGG-02", f"WITH {OBJ} SELECT sum(CASE WHEN doc_id % 4 <> 2 THEN size ELSE 0 END)::BIGINT AS used, count(DISTINCT CASE WHEN doc_id % 4 <> 2 THEN doc_id % 4 END) * 1000 AS capacity FROM obj")
def capacity_of_healthy(spark, d):
    child = F.col("doc_id") % 4
    return objects(spark, d).agg(F.sum(F.when(child != 2, F.col("size")).otherwise(0)).alias("used"), (F.count_distinct(F.when(child != 2, child)) * 1000).alias("capacity"))


@query("AGG-04 AGG-05 AGG-06 CON-11", """SELECT user_id, coalesce(count_if(event_type = 'view')::DOUBLE / nullif(count_if(event_type IN ('view', 'click')), 0), 0) AS hit_rate,
coalesce(sum(CASE WHEN event_type = 'view' THEN event_id % 100 END)::DOUBLE / nullif(sum(CASE WHEN event_type IN ('view', 'click') THEN event_id % 100 END), 0), 0) AS token_hit_rate, coalesce(avg(CASE WHEN event_type = 'purchase' THEN floor(value) END), 0) AS avg_load_ms FROM events GROUP BY user_id""")
def hit_rates(spark, d):
    e = table(spark, d, "events")
    kind, tokens = F.col("event_type"), F.col("event_id") % 100
    served, missed = F.sum(F.when(kind == "view", tokens)), F.sum(F.when(kind == "click", tokens))
    return e.groupBy("user_id").agg(
        metrics.rate(F.count_if(kind == "view"), F.count_if(kind == "click")).alias("hit_rate"),
        metrics.rate(F.coalesce(served, F.lit(0)), F.coalesce(missed, F.lit(0))).alias("token_hit_rate"),
        F.coalesce(F.avg(F.when(kind == "purchase", F.floor("value"))), F.lit(0.0)).alias("avg_load_ms"))


@query("AGG-07", "SELECT event_type, printf('%.2f%%', 100.0 * count_if(event_id % 3 = 0) / count(*)) AS share, printf('%.2f', sum(event_id)::DOUBLE / 1048576) AS mib FROM events GROUP BY event_type")
def summaries(spark, d):
    e = table(spark, d, "events")
    share = F.count_if(F.col("event_id") % 3 == 0) / F.count(F.lit(1))
    return e.groupBy("event_type").agg(metrics.percent(share).alias("share"), F.format_string("%.2f", F.sum("event_id").cast("double") / 1_048_576).alias("mib"))


def _device_files(spark, d):
    """Objects on eight devices: their reads, and their files below the devices' roots."""
    o = objects(spark, d).withColumn("device", routing.md5_mod(F.col("object_key"), 8))
    path = F.concat(F.lit("/dev"), F.col("device").cast("string"), F.lit("/data/"), F.when(F.col("namespace") == "", "_").otherwise(F.col("namespace")), F.lit("/"), F.col("doc_id").cast("string"))
    return o.select("device", "size"), o.select(path.alias("path"), "size")


@query("AGG-08 STG-09 AGG-11 PYC-08", f"""WITH {OBJ}, p AS (SELECT {md5_mod_sql('object_key', 8)} AS device, size FROM obj), r AS (SELECT unnest(range(9))::INT AS device)
SELECT r.device, coalesce(sum(size), 0)::BIGINT AS read_bytes, count(size) AS reads, coalesce(sum(size), 0)::BIGINT AS used_bytes FROM r LEFT JOIN p ON r.device = p.device GROUP BY r.device""")
def device_counters(spark, d):
    """Every object is read once; a ninth device holds nothing."""
    reads, files = _device_files(spark, d)
    roots = spark.range(9).select(F.col("id").cast("int").alias("device"), F.concat(F.lit("/dev"), F.col("id").cast("string")).alias("root"))
    return metrics.device_counters(reads, files, roots)


@query("AGG-08", f"""WITH {OBJ}, p AS (SELECT '/dev' || {md5_mod_sql('object_key', 8)} AS a, CASE WHEN namespace = '' THEN '_' ELSE namespace END AS ns, size FROM obj), u AS (SELECT a AS directory, size FROM p UNION ALL SELECT a || '/data', size FROM p UNION ALL SELECT a || '/data/' || ns, size FROM p)
SELECT directory, sum(size)::BIGINT AS bytes, count(*) AS files FROM u GROUP BY directory""")
def directory_sizes(spark, d):
    return metrics.directory_sizes(_device_files(spark, d)[1])


@query("CON-04", "SELECT l_orderkey AS spec, count_if(l_linestatus = 'F') AS ok, count_if(l_linestatus <> 'F') AS failed FROM lineitem GROUP BY l_orderkey")
def load_results(spark, d):
    return metrics.spec_results(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("spec"), (F.col("l_linestatus") == "F").alias("ok")))


LE = ", ".join(f"({b}, '{metrics._bound(b)}')" for b in metrics.BUCKETS)


@query("AGG-09", f"""WITH b(b, le) AS (VALUES {LE}, (1e300, '+Inf')), e AS (SELECT event_type AS op, value / 50 AS seconds FROM events)
SELECT op, le, count_if(seconds <= b) AS count FROM e, b GROUP BY op, le""")
def latency_histogram(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("op"), (F.col("value") / 50).alias("seconds"))
    return metrics.histogram(e, ["op"])


@query("AGG-10 API-13", """SELECT event_type AS op, CASE WHEN event_type = 'error' THEN 'INTERNAL' WHEN event_id % 5 = 0 THEN 'NOT_FOUND' WHEN event_id % 5 = 1 THEN 'ALREADY_EXISTS' WHEN event_id % 5 = 2 THEN 'INVALID_ARGUMENT' ELSE 'OK' END AS status, count(*) AS requests FROM events GROUP BY ALL""")
def request_counters(spark, d):
    from tessera.operators.placement import status_code

    i = F.col("event_id") % 5
    error = F.when(F.col("event_type") == "error", "disk").when(i == 0, "not_found").when(i == 1, "already_exists").when(i == 2, "invalid_argument")
    return table(spark, d, "events").groupBy(F.col("event_type").alias("op"), status_code(error).alias("status")).agg(F.count(F.lit(1)).alias("requests"))


@query("AGG-12 AGG-13", "SELECT event_type, median(value) AS median, list_sort(list(value))[count(*) // 2 + 1] AS upper_median, min(value) AS low, max(value) AS high FROM events GROUP BY event_type")
def medians(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.median("value").alias("median"), metrics.upper_median("value").alias("upper_median"), F.min("value").alias("low"), F.max("value").alias("high"))


@query("AGG-14 AGG-15", """WITH s AS (SELECT user_id, count(*) AS n, count_if(event_type = 'error') AS failed, sum(floor(value)::BIGINT) AS us FROM events GROUP BY user_id)
SELECT user_id, us::DOUBLE / n AS us_per_op, n - failed AS succeeded, CASE WHEN failed = 0 THEN 'ok' ELSE 'partial_failure' END AS status, us::DOUBLE / n >= 200 AS passed, true AS ungated FROM s""")
def throughput_gates(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("failed"), F.sum(F.floor("value")).alias("us"))
    per = F.col("us") / F.col("n")
    return e.select("user_id", per.alias("us_per_op"), (F.col("n") - F.col("failed")).alias("succeeded"), F.when(F.col("failed") == 0, "ok").otherwise("partial_failure").alias("status"), metrics.gate(per, 200).alias("passed"), metrics.gate(per, 0).alias("ungated"))


@query("SRC-13 XPT-15", """SELECT 'requests_total{op="' || event_type || '",shard="' || (user_id % 2) || '"} ' || count(*) AS value FROM events GROUP BY event_type, user_id % 2""")
def exposition_lines(spark, d):
    e = table(spark, d, "events").groupBy("event_type", (F.col("user_id") % 2).cast("string").alias("shard")).count()
    labels = F.create_map(F.lit("shard"), F.col("shard"), F.lit("op"), F.col("event_type"))
    return metrics.exposition(e.select(F.lit("requests_total").alias("name"), labels.alias("labels"), F.col("count").alias("value")))
