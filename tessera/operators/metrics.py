"""Rates, latencies, histograms and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.placement import status_code

#: Bounds of the latency histogram, in seconds.
BUCKETS = (0.0001, 0.00025, 0.0005, 0.001, 0.0025, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def rate(part: Column, rest: Column) -> Column:
    """part / (part + rest), 0 where there is nothing."""
    return F.coalesce(F.try_divide(part.cast("double"), (part + rest).cast("double")), F.lit(0.0))


def percent(x: Column) -> Column:
    return F.format_string("%.2f%%", F.lit(100) * x)


def histogram(durations: DataFrame, labels: list[str], buckets: tuple[float, ...] = BUCKETS) -> DataFrame:
    """durations (labels, seconds) -> labels, le, count: cumulative, with +Inf. One aggregation counts all
    bounds; the rows are spread out after it."""
    counted = [F.count_if(F.col("seconds") <= b).alias(f"b{i}") for i, b in enumerate(buckets)]
    wide = durations.groupBy(*labels).agg(*counted, F.count("seconds").alias("b_all"))
    rows = [F.struct(F.lit(_bound(b)).alias("le"), F.col(f"b{i}").alias("count")) for i, b in enumerate(buckets)]
    rows.append(F.struct(F.lit("+Inf").alias("le"), F.col("b_all").alias("count")))
    return wide.select(*labels, F.explode(F.array(*rows)).alias("r")).select(*labels, "r.le", "r.count")


def _bound(b: float) -> str:
    return f"{b:f}".rstrip("0").rstrip(".")


def upper_median(x: str) -> Column:
    """The element at half the length of the sorted list: the upper of two middle ones."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {x} DESC)")


def gate(value: Column, threshold: float) -> Column:
    """Whether a threshold is met; 0 turns it off."""
    return F.lit(True) if threshold == 0 else value >= threshold


def directory_sizes(files: DataFrame) -> DataFrame:
    """files (path, size) -> directory, bytes, files: what lies below each directory, however deep. A file
    names its ancestors, so one aggregation does for all levels."""
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    rows = files.select("size", F.explode(F.filter(up, lambda d: d != "")).alias("directory"))
    return rows.groupBy("directory").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("files"))


def device_counters(reads: DataFrame, files: DataFrame, roots: DataFrame) -> DataFrame:
    """reads (device, size), files (path, size), roots (device, root) -> device, read_bytes, reads, used_bytes:
    a row for every device, used_bytes being the recursive size of its root."""
    read = reads.groupBy("device").agg(F.sum("size").alias("read_bytes"), F.count(F.lit(1)).alias("reads"))
    used = directory_sizes(files).withColumnRenamed("directory", "root").select("root", F.col("bytes").alias("used_bytes"))
    zero = F.lit(0).cast("long")
    rows = roots.join(read, "device", "left").join(used, "root", "left")
    return rows.select("device", F.coalesce("read_bytes", zero).alias("read_bytes"), F.coalesce("reads", zero).alias("reads"), F.coalesce("used_bytes", zero).alias("used_bytes"))


def spec_results(loads: DataFrame) -> DataFrame:
    """loads (spec, ok) -> spec, ok, failed: a load that fails is counted, nothing more."""
    return loads.groupBy("spec").agg(F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed"))


def request_outcomes(calls: DataFrame) -> DataFrame:
    """calls (op, found, error) -> op, status, requests: `ok`, `not_found` for a call that found nothing without
    failing, else the code of its error."""
    status = F.when(F.col("error").isNotNull(), status_code(F.col("error"))).when(F.col("found"), "ok").otherwise("not_found")
    return calls.groupBy("op", status.alias("status")).agg(F.count(F.lit(1)).alias("requests"))


def fallbacks(slots: DataFrame) -> DataFrame:
    """slots (tier, error) of a tiered read -> from, to, reason, count: a read that memory couldn't serve falls
    back to storage, and one that storage couldn't serve to nothing."""
    missed = F.col("tier").isNull() | (F.col("tier") != "memory")
    steps = F.array(
        F.when(missed, F.struct(F.lit("memory").alias("from"), F.lit("storage").alias("to"), F.lit("miss").alias("reason"))),
        F.when(missed & (F.col("tier").isNull()), F.struct(F.lit("storage").alias("from"), F.lit("none").alias("to"), F.when(F.col("error").isNull(), "miss").otherwise("error").alias("reason"))))
    return slots.select(F.explode(F.array_compact(steps)).alias("s")).groupBy("s.from", "s.to", "s.reason").agg(F.count(F.lit(1)).alias("count"))


def exposition(rows: DataFrame) -> DataFrame:
    """rows (name, labels map<string,string>, value) -> value lines of the text format, sorted labels."""
    pairs = F.array_sort(F.map_entries("labels"))
    body = F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit('="'), F.regexp_replace(F.regexp_replace(e["value"], r"\\", r"\\\\"), '"', '\\\\"'), F.lit('"'))), ",")
    name = F.when(F.size(pairs) > 0, F.concat(F.col("name"), F.lit("{"), body, F.lit("}"))).otherwise(F.col("name"))
    return rows.select(F.concat(name, F.lit(" "), F.col("value").cast("string")).alias("value"))
