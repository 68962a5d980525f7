"""Versioned objects: writes resolved in order of arrival, one current version, old ones readable."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def apply_puts(attempts: DataFrame, counters: DataFrame | None = None, live: DataFrame | None = None) -> DataFrame:
    """attempts (key, seq, if_absent) -> + stored, generation. A put takes the next generation; a put if
    absent only where no object lives, and a rejected one takes none. live (key, generation): the objects
    that are there. counters (key, generation): where each key's count stands; it outlives the object, and
    the next generation follows the larger of the two."""
    w = Window.partitionBy("key").orderBy("seq")
    rows = attempts
    if counters is not None:
        rows = rows.join(counters.select("key", F.col("generation").alias("_counter")), "key", "left")
    if live is not None:
        rows = rows.join(live.select("key", F.col("generation").alias("_live")), "key", "left")
    known = [F.col(c) for c in rows.columns if c in ("_counter", "_live")]
    base = F.greatest(F.lit(0), F.lit(0), *known)  # skips nulls
    there = F.lit(False) if live is None else F.col("_live").isNotNull()
    # the first attempt on a key without an object is always stored, so one is there from then on
    stored = ~F.col("if_absent") | ((F.row_number().over(w) == 1) & ~there)
    rows = rows.withColumn("stored", stored)
    generation = F.when(F.col("stored"), base + F.sum(F.col("stored").cast("int")).over(w))
    return rows.withColumn("generation", generation.cast("long")).select(*attempts.columns, "stored", "generation")


def current(versions: DataFrame) -> DataFrame:
    """The latest version of each key, by one aggregation; no sort."""
    rest = [c for c in versions.columns if c not in ("key", "generation")]
    best = versions.groupBy("key").agg(F.max(F.struct("generation", *rest)).alias("_v"))
    return best.select("key", "_v.generation", *(F.col(f"_v.{c}").alias(c) for c in rest))


def first_writer(attempts: DataFrame) -> DataFrame:
    rest = [c for c in attempts.columns if c not in ("key", "seq")]
    return attempts.groupBy("key").agg(F.min(F.struct("seq", *rest)).alias("_v")).select("key", "_v.seq", *(F.col(f"_v.{c}").alias(c) for c in rest))


def compare_and_delete(objects: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """wanted (key, generation): objects less those whose generation is the expected one, and for each
    wanted row whether it deleted. Nothing but the generation is compared."""
    done = wanted.join(objects.select("key", "generation").withColumn("_hit", F.lit(True)), ["key", "generation"], "left")
    return objects.join(wanted, ["key", "generation"], "left_anti"), done.select("key", "generation", F.coalesce("_hit", F.lit(False)).alias("deleted"))


def delete(objects: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    there = keys.join(objects.select("key").distinct().withColumn("_hit", F.lit(True)), "key", "left")
    return objects.join(keys, "key", "left_anti"), there.select("key", F.coalesce("_hit", F.lit(False)).alias("existed"))


def at_generation(versions: DataFrame, pins: DataFrame) -> DataFrame:
    """A version that was pinned by its metadata stays readable after overwrites."""
    return pins.join(versions, ["key", "generation"], "left")


def vacuum(versions: DataFrame) -> DataFrame:
    """Versions that are not current: files that nothing but pins reads."""
    return versions.join(current(versions).select("key", "generation"), ["key", "generation"], "left_anti")


def commit_outcome(commits: DataFrame) -> DataFrame:
    """commits (key, seq, if_absent, failed) -> status: committed, lost_race (files rolled back) or
    rolled_back. Each attempt took a generation."""
    w = Window.partitionBy("key").orderBy("seq")
    ok = ~F.col("failed")
    before = F.coalesce(F.sum(ok.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    status = F.when(F.col("failed"), "rolled_back").when(F.col("if_absent") & (before > 0), "lost_race").otherwise("committed")
    return commits.withColumn("status", status).withColumn("generation", F.row_number().over(w).cast("long"))


def last_representation(writes: DataFrame) -> DataFrame:
    """writes (key, seq, form): any write drops the other form's cached entry, so the last one's stays."""
    return writes.groupBy("key").agg(F.max_by("form", "seq").alias("form"))


def first_store(stores: DataFrame) -> DataFrame:
    """One store for each worker and prefix key: the first."""
    return stores.groupBy("worker", "prefix_key").agg(F.min("seq").alias("seq"))
