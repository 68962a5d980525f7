"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Every document gets the key -ln(u) / w with u in (0, 1) from its id and text and w its quality weight.
A source's target is filled first by complete epochs, then by its documents in key order up to the
rest of the budget; the document in which the budget ends is taken in part. The prefix sum needs no sort of a whole source: keys are laid into 1024 bins of
1024 bins, bins are summed before any exchange by source, and only the one fine bin in which the
budget ends is sorted.

Defined results: null text has size 0 and is never taken; a null or non-positive weight counts as
the least weight; the null source is a source of its own, last in order. Keys that tie go by id, size
and digest of the text, and rows equal in all of these are interchangeable: reruns and other orders of
rows give the same rows, null and repeated ids included. A source's taken words are its target's whole
part. An empty table gives no rows; columns other than doc_id, text and source are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, words_of

SHARES = (5, 2, 1)
TOTAL, MOST = 1.5, 2.0
#: Weights by label: low quality, unlabelled, high quality.
WEIGHTS = (0.25, 0.5, 1.0)
LEAST_WEIGHT = 1e-6
BINS = 1024
SEED = "mix"


def uniform(key: Column, digest: Column, seed: str) -> Column:
    """A number in (0, 1) from the first 52 bits of md5."""
    text = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), digest, F.lit(":" + seed))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def text_digest(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def weighted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, source, size, digest, w: w from the labels; of several labels of one document the lowest counts."""
    low, none, high = WEIGHTS
    label = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("_q"))
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words_of(F.col("text")).alias("size"), text_digest(F.col("text")).alias("digest"))
    w = F.when(F.col("_q").isNull(), none).when(F.col("_q") > 0, high).otherwise(low)
    return sized.join(label, "doc_id", "left").select("doc_id", "source", "size", "digest", w.alias("w"))


def _running(rows: DataFrame, order: list[Column], sums: dict[str, Column], name: str) -> DataFrame:
    """rows with the sums over all rows before them in order. Rows are dealt by range; each range is summed by
    itself and gets the sums of the ranges before it, so one task sees a row for each range, never all rows."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = stored(rows.repartitionByRange(parts, *order).withColumn("_p", F.spark_partition_id()), name)
    own = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = placed.select("*", *(F.coalesce(F.sum(c).over(own), F.lit(0)).alias(f"_own_{k}") for k, c in sums.items()))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    ranges = placed.groupBy("_p").agg(*(F.sum(c).alias(k) for k, c in sums.items()))
    ranges = ranges.select("_p", *(F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"_before_{k}") for k in sums))
    # `parts` rows at most
    return inner.join(F.broadcast(ranges), "_p").select(*rows.columns, *((F.col(f"_own_{k}") + F.col(f"_before_{k}")).alias(k) for k in sums))


def targets(sources: DataFrame, shares: tuple[int, ...] = SHARES, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """source, source_size -> + share, target, from one row per source. Raising the common level until no
    share passes its cap has a closed form: sources by cap for each unit of share; the level is set by the
    uncapped rest."""
    by_name = [F.col("source").isNull(), F.col("source")]
    ranked = _running(sources, by_name, {"_n": F.lit(1)}, "mix-ranks")
    share = F.element_at(F.array(*map(F.lit, shares)), (F.col("_n") % len(shares) + 1).cast("int"))
    ranked = ranked.withColumn("share", share).drop("_n").withColumn("_ratio", F.lit(most) * F.col("source_size") / F.col("share"))
    run = stored(_running(ranked, [F.col("_ratio"), *by_name], {"_size": F.col("source_size"), "_share": F.col("share")}, "mix-ratios"), "mix-levels")
    size, parts = run.agg(F.sum("source_size"), F.sum("share")).first()
    level = (F.lit(total) * F.lit(size).cast("long") - F.lit(most) * F.col("_size")) / (F.lit(parts).cast("long") - F.col("_share"))
    free = run.withColumn("_level", level).where("_level <= _ratio").agg(F.min(F.struct("_ratio", F.col("source").isNull(), "source", "_level"))).first()[0]
    at = free["_level"] if free else 0.0
    return run.select("source", "source_size", "share", F.least(F.lit(most) * F.col("source_size"), F.lit(at) * F.col("share")).cast("double").alias("target"))


def _bins(place: Column) -> tuple[Column, Column]:
    coarse = F.least(F.floor(place * BINS), F.lit(BINS - 1))
    fine = F.least(F.floor((place * BINS - coarse) * BINS), F.lit(BINS - 1))
    return coarse, fine


def _edge(sums: DataFrame, bin_: str, plan: DataFrame, before: Column) -> DataFrame:
    """Of each source the bin in which its budget ends, and the words before that bin."""
    w = Window.partitionBy("_s").orderBy(bin_).rowsBetween(Window.unboundedPreceding, 0)
    run = sums.join(plan, "_s").withColumn("_end", before + F.sum("_n").over(w)).withColumn("_from", F.col("_end") - F.col("_n"))
    return run.where("_from <= rest and rest < _end").select("_s", F.col(bin_), F.col("_from"))


def mix(spark: SparkSession, docs: DataFrame, labels: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken, and source and digest, one row per row of docs."""
    base = stored(weighted(docs, labels).withColumn("_s", F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source"))), "mix-base")
    per = base.groupBy("_s", "source").agg(F.sum("size").alias("source_size"), F.avg("w").alias("_mean"))
    goal = targets(per.select("source", "source_size")).withColumn("_s", F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source"))).drop("source", "source_size")
    plan = per.join(goal, "_s").drop("source")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = stored(plan.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "mix-plan")

    w = F.greatest(F.coalesce(F.col("w"), F.lit(0.0)), F.lit(LEAST_WEIGHT))
    keyed = base.join(plan, "_s").withColumn("_key", -F.log(uniform(F.col("doc_id"), F.col("digest"), seed)) / w)
    place = 1 - F.exp(-F.col("_key") * F.col("_mean"))  # rises with the key, near uniform in (0, 1)
    coarse, fine = _bins(place)
    keyed = keyed.withColumn("_b", coarse).withColumn("_c", fine)

    slim = plan.select("_s", "rest")
    edge1 = _edge(keyed.groupBy("_s", "_b").agg(F.sum("size").alias("_n")), "_b", slim, F.lit(0))
    edge1 = stored(edge1.withColumnsRenamed({"_b": "_eb", "_from": "_from1"}), "mix-edge")
    inside = keyed.join(edge1, "_s").where("_b = _eb").groupBy("_s", "_c").agg(F.sum("size").alias("_n"), F.first("_from1").alias("_from1"))
    edge2 = _edge(inside, "_c", slim, F.col("_from1"))
    edges = stored(edge1.join(edge2.withColumnsRenamed({"_c": "_ec", "_from": "_from2"}), "_s", "left"), "mix-edges")

    found = keyed.join(edges, "_s", "left").withColumn("_edge", F.coalesce((F.col("_b") == F.col("_eb")) & (F.col("_c") == F.col("_ec")), F.lit(False)))
    sure = F.coalesce((F.col("_b") < F.col("_eb")) | ((F.col("_b") == F.col("_eb")) & (F.col("_c") < F.col("_ec"))), F.lit(False))
    last = Window.partitionBy("_s").orderBy("_key", "doc_id", "size", "digest").rowsBetween(Window.unboundedPreceding, 0)
    left = F.floor("rest") - (F.col("_from2") + F.sum("size").over(last) - F.col("size"))
    at_edge = found.where("_edge").withColumn("_in", F.least("size", F.greatest(F.lit(0), left)))
    whole = found.where("not _edge").withColumn("_in", F.when(sure, F.col("size")).otherwise(F.lit(0)))
    taken = F.col("epochs") * F.col("size") + F.col("_in")
    return whole.unionByName(at_edge).select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "source", "digest")


def _row_key(doc_id: Column, source: Column, digest: Column) -> Column:
    """A text that tells rows apart by id, source and text, nulls included."""
    part = lambda c: F.when(c.isNull(), "n").otherwise(F.concat(F.lit("s"), F.length(c).cast("string"), F.lit(":"), c))
    return F.concat(part(doc_id.cast("long").cast("string")), part(source.cast("string")), digest)


def mixed_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that the mix takes, each as often as it is taken, with the columns of docs; documents stay
    whole, and one that is taken in part counts if that is half of it or more. Of rows equal in id, source
    and text one stands for all, as often as all of them are taken; rows without words are not taken."""
    times = F.floor(F.col("taken") / F.col("size") + 0.5)
    took = mix(spark, docs, labels).where("size > 0").withColumn("key", _row_key(F.col("doc_id"), F.col("source"), F.col("digest")))
    took = stored(took.groupBy("key").agg(F.sum(times).cast("int").alias("times"), F.count(F.lit(1)).alias("rows")).where("times > 0"), "mix-times")
    names = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*names).alias("row"), _row_key(F.col("doc_id"), F.col("source"), text_digest(F.col("text"))).alias("key"))
    if took.where("rows > 1").take(1):
        rows = rows.groupBy("key").agg(F.first("row").alias("row"))
    return rows.join(took, "key").select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


ORACLE = """
WITH lab AS (SELECT doc_id, min(quality) AS q FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (SELECT documents.doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
             CASE WHEN q IS NULL THEN 0.5 WHEN q > 0 THEN 1.0 ELSE 0.25 END::DOUBLE AS w,
             md5(coalesce(text, '')) AS digest,
             (('0x' || substr(md5(coalesce(documents.doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')) || ':mix'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
      FROM documents LEFT JOIN lab ON documents.doc_id = lab.doc_id),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS share
      FROM d GROUP BY source),
r AS (SELECT *, 2.0::DOUBLE * source_size / share AS ratio FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - 2.0::DOUBLE * coalesce(sum(source_size) OVER b, 0)) / (sum(share) OVER () - coalesce(sum(share) OVER b, 0)) AS level
      FROM r WINDOW b AS (ORDER BY ratio, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, (SELECT level FROM l WHERE level <= ratio ORDER BY ratio, source IS NULL, source LIMIT 1) * share) AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
k AS (SELECT d.doc_id, d.size, p.*, target - epochs * source_size AS rest,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY -ln(u) / w, d.doc_id, d.size, d.digest ROWS UNBOUNDED PRECEDING) AS run
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target::DOUBLE AS target,
       (epochs * size + least(size, greatest(0, floor(rest)::BIGINT - (run - size))))::BIGINT AS taken
FROM k
"""
