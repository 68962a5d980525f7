"""Exact dedup over a persistent digest index.

The index is a catalog table (digest, keep_id, group_size), bucketed and sorted by digest, and beside
it a table of the same form for what later loads add to digests that it has already. A load is first
reduced to one row per digest, which takes the skew out of any group of copies, then sort-merge
anti-joined with the index; what the index lacks is appended to it, the rest to the second table. The
index side of both joins needs no exchange, and nothing that is written is written again. The state of
a digest is the largest keep_id and the sum of the sizes over both tables.

The query loads its documents in LOADS parts into an index of its own and drops that when its
decisions are stored. A named index stays, and later loads go on from it.

Defined results: a null text counts as the empty text, and texts are read whole, however long; repeated
rows count each in group_size and share a decision; where every doc_id of a group is null, keep_id is
null and all its rows are marked kept; an empty table gives no rows. deduplicate() leaves one row of
each text: of rows that share a doc_id and a text, or a text without any doc_id, any one. Columns other
than doc_id and text are carried, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

INDEX_SCHEMA = "digest string, keep_id long, group_size long"
LOADS = 2


def text_digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest) of every row; the texts go no further."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest(F.col("text")).alias("digest"))


class DigestIndex:
    """Two catalog tables of digests: `buckets` buckets sorted by digest, by default as many as shuffles
    have partitions when the index is made."""

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int | None = None):
        self.spark, self.name = spark, name or f"digest_index_{uuid.uuid4().hex}"
        self.more = f"{self.name}_more"
        self.buckets = self._buckets() or buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def exists(self, name: str | None = None) -> bool:
        return self.spark.catalog.tableExists(name or self.name)

    def _described(self, name: str, what: str) -> str | None:
        row = self.spark.sql(f"DESCRIBE FORMATTED {name}").where(F.col("col_name") == what).first()
        return row["data_type"] if row else None

    def _buckets(self) -> int | None:
        return int(self._described(self.name, "Num Buckets")) if self.exists() else None

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def rows(self) -> DataFrame:
        """The state of every digest, from the files read as plain Parquet: a join on it may split a hot digest."""
        paths = [self._described(n, "Location") for n in (self.name, self.more) if self.exists(n)]
        every = self.spark.read.schema(INDEX_SCHEMA).parquet(*paths)
        return every if len(paths) == 1 else every.groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))

    def split(self, digested: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """One row per digest of `digested`: those that the index lacks, and those that it has."""
        new = digested.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        if not self.exists():
            return new, None
        new = stored(new, "load")
        known = self.table().select("digest").hint("merge")
        return new.join(known, "digest", "left_anti"), new.join(known, "digest", "left_semi")

    def unseen(self, digested: DataFrame) -> DataFrame:
        """One row per digest of `digested` that the index lacks."""
        return self.split(digested)[0]

    def append(self, digested: DataFrame) -> None:
        new, known = self.split(digested)
        if known is not None:
            new = stored(new, "unseen")  # else the write would read the table that it appends to
            self._write(stored(known, "seen"), self.more)
        self._write(new, self.name)

    def _write(self, rows: DataFrame, name: str) -> None:
        (rows.select("digest", "keep_id", "group_size").repartition(self.buckets, "digest").write.mode("append").format("parquet")
            .bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(name))

    def drop(self) -> None:
        for name in (self.name, self.more):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def decide(spark: SparkSession, docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per document. With an index, the documents
    are a load for it, and what it holds already takes part."""
    own = stored(digests(docs), "digests")
    passing = index is None
    if passing:
        index = DigestIndex(spark)
        part = F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(LOADS))
        for k in range(LOADS):
            index.append(own.where(part == k))
    else:
        index.append(own)
    joined = own.join(index.rows(), "digest", "left").select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"),
    )
    if passing:
        joined = stored(joined, "decisions")
        index.drop()
    return joined


def deduplicate(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows that stay, with all columns of docs."""
    own = decide(spark, docs)
    names = [F.col(f"`{c}`") for c in docs.columns]
    if own.groupBy("doc_id").count().where("count > 1 or doc_id is null").take(1):
        # a doc_id stands for several rows, or none does: decisions go by doc_id and text
        kept = own.where("kept").select(F.col("doc_id").alias("_i"), F.col("text_sha256").alias("_d")).distinct()
        rows = docs.select(F.struct(*names).alias("row"), F.col("doc_id").cast("long").alias("id"), text_digest(F.col("text")).alias("digest"))
        rows = rows.join(kept, (F.col("digest") == F.col("_d")) & F.col("id").eqNullSafe(F.col("_i")), "left_semi")
        return rows.groupBy("id", "digest").agg(F.first("row").alias("row")).select("row.*")
    gone = own.where("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(names)
