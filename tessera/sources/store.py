"""An object store as a log of commits: put, get, exists, delete, metadata, usage and keys.

Each commit is a folder of Parquet, written under a hidden name and then renamed to its number, so a
reader sees all of a commit or none of it, and a writer that fails or is lost leaves nothing that a
reader looks at. Within a commit objects lie in a folder for each shard, and a lookup by key reads the
folders of one shard. The last commit of an object counts; a delete is a row without a layer.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import routing

from .shared import file_system

META = "num_tokens int, num_layers int, dtype string, shape array<int>, compressed boolean, compression_level int"
META_STRUCT = f"struct<{', '.join(f.replace(' ', ':', 1) for f in META.split(', '))}>"
ROW = f"key string, layer string, data binary, size long, meta {META_STRUCT}"


class Store:
    """policy `block` shards by key, `layer` by layer where there is one. Key-level deletes go to all
    shards; capacity is reported, not enforced."""

    def __init__(self, spark: SparkSession, path: str, shards: int = 8, policy: str = "block", capacity: int = 0):
        self.spark, self.path, self.shards, self.policy, self.capacity = spark, path.rstrip("/"), shards, policy, capacity

    def _numbers(self) -> list[int]:
        target, fs = file_system(self.spark, self.path)
        names = [s.getPath().getName() for s in fs.listStatus(target)] if fs.exists(target) else []
        return sorted(int(n.removeprefix("commit=")) for n in names if n.startswith("commit="))

    def _write(self, rows: DataFrame) -> str:
        hidden = f"{self.path}/_{uuid.uuid4().hex}"
        shard = F.when(F.col("layer").isNull(), F.lit(-1)).otherwise(routing.shard(F.col("key"), F.col("layer"), F.lit(self.policy), self.shards))
        # a shard's rows spread over tasks, as one shard may hold much of a commit
        rows.withColumn("shard", shard).write.partitionBy("shard").parquet(hidden)
        return hidden

    def publish(self, hidden: str) -> int:
        """A rename: the next free number, however many writers there are."""
        source, fs = file_system(self.spark, hidden)
        n = (self._numbers() or [0])[-1] + 1
        while True:
            target, _ = file_system(self.spark, f"{self.path}/commit={n}")
            if not fs.exists(target) and fs.rename(source, target):
                return n
            if not fs.exists(source):
                raise RuntimeError(f"{hidden} is gone")
            n += 1

    def stage(self, objects: DataFrame) -> str:
        """objects (key, layer, data), with or without a `meta` struct, written where no reader looks; one row
        for each key and layer."""
        have = F.col("meta") if "meta" in objects.columns else F.lit(None)
        data = F.col("data").cast("binary")
        return self._write(objects.select(
            F.col("key").cast("string").alias("key"), F.coalesce("layer", F.lit("")).alias("layer"), data.alias("data"), F.octet_length(data).cast("long").alias("size"), have.cast(META_STRUCT).alias("meta")))

    def put(self, objects: DataFrame) -> int:
        return self.publish(self.stage(objects))

    def delete(self, keys: DataFrame) -> int:
        """All layers of the keys; a key that isn't there is no error."""
        none = [F.lit(None).cast(t).alias(n) for n, t in (("layer", "string"), ("data", "binary"), ("size", "long"))]
        return self.publish(self._write(keys.select(F.col("key").cast("string").alias("key")).distinct().select("key", *none, F.lit(None).cast(META_STRUCT).alias("meta"))))

    def log(self) -> DataFrame:
        kind = f"{ROW}, commit int, shard int"
        return self.spark.read.schema(kind).parquet(self.path) if self._numbers() else self.spark.createDataFrame([], kind)

    def _last(self, log: DataFrame) -> DataFrame:
        """key, layer, commit of what is there, found without the data."""
        slim = log.select("key", "layer", "commit")
        gone = slim.where("layer is null").groupBy("key").agg(F.max("commit").alias("gone"))
        last = slim.where("layer is not null").groupBy("key", "layer").agg(F.max("commit").alias("commit"))
        return last.join(gone, "key", "left").where("gone is null or gone < commit").drop("gone")

    def objects(self, where: Column | None = None) -> DataFrame:
        """key, layer, data, size, meta, shard of the current objects."""
        log = self.log() if where is None else self.log().where(where)
        return log.where("layer is not null").join(self._last(log), ["key", "layer", "commit"]).select("key", "layer", "data", "size", "meta", "shard")

    def get(self, key: str, layer: str | None = None) -> DataFrame:
        """One object; its shard's folder and the deletes' are all that is read, where the policy tells it."""
        where = F.col("key") == key
        if self.policy == "block" or layer:
            shard = self.spark.range(1).select(routing.shard(F.lit(key), F.lit(layer or ""), F.lit(self.policy), self.shards)).first()[0]
            where &= F.col("shard").isin(-1, shard)
        found = self.objects(where)
        return found if layer is None else found.where(F.col("layer") == layer)

    def get_batch(self, asked: DataFrame) -> DataFrame:
        """asked (pos, key, layer) -> + data, found, one row for each asked one."""
        have = self.objects().select("key", "layer", "data", F.lit(True).alias("_found"))
        return asked.join(have, ["key", "layer"], "left").select(*asked.columns, "data", F.coalesce("_found", F.lit(False)).alias("found"))

    def exists(self, keys: DataFrame) -> DataFrame:
        """keys (key) -> + found: any layer counts."""
        have = self._last(self.log()).select("key").distinct().withColumn("_found", F.lit(True))
        return keys.join(have, "key", "left").select(*keys.columns, F.coalesce("_found", F.lit(False)).alias("found"))

    def meta(self) -> DataFrame:
        """key and metadata, of the layer that was written last."""
        rows = self.log().where("meta is not null").select("key", "layer", "commit", "meta").join(self._last(self.log()), ["key", "layer", "commit"])
        return rows.groupBy("key").agg(F.max_by("meta", F.struct("commit", "layer")).alias("m")).select("key", "m.*")

    def keys(self) -> DataFrame:
        return self._last(self.log()).select("key").distinct()

    def usage(self) -> DataFrame:
        """used, capacity: the bytes of current objects; what an overwrite or delete has replaced counts no more."""
        slim = self.log().select("key", "layer", "commit", "size")
        return slim.join(self._last(self.log()), ["key", "layer", "commit"]).agg(F.coalesce(F.sum("size"), F.lit(0)).alias("used"), F.lit(self.capacity).cast("long").alias("capacity"))
