"""Object tables as files: one file a layer with JSON metadata, hex-named files, or Parquet shards."""

from __future__ import annotations

import json
import uuid
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import keys, routing

META = "num_tokens int, num_layers int, dtype string, shape array<int>, compressed boolean, compression_level int"


def _opened(root: str):
    """The file system of a folder as executors see it, and the folder there."""
    return pafs.FileSystem.from_uri(root) if urlsplit(root).scheme else (pafs.LocalFileSystem(), root)


def write_layers(objects: DataFrame, root: str) -> DataFrame:
    """objects (key, layer, data, and metadata as in META where there is any) -> key, layer, size of what is
    written as `<root>/<key>/<layer>.bin`, with `meta.json` beside it. A file gets its name when it is whole,
    so a reader sees the old value or the new one, and a task that runs again writes the same."""
    fields = [f.split(" ")[0] for f in META.split(", ")]
    names = [c for c in objects.columns if c in fields]

    def put(fs, path: str, data: bytes) -> None:
        hidden = f"{path}.{uuid.uuid4().hex}.tmp"
        with fs.open_output_stream(hidden) as out:
            out.write(data)
        fs.move(hidden, path)

    def run(batches):
        fs, base = _opened(root)
        for batch in batches:
            sizes = []
            for key, layer, data, *meta in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
                fs.create_dir(f"{base}/{key}", recursive=True)
                put(fs, f"{base}/{key}/{layer}.bin", data or b"")
                put(fs, f"{base}/{key}/meta.json", json.dumps(dict(zip(names, meta, strict=True))).encode())
                sizes.append(len(data or b""))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], ["key", "layer", "size"])

    key = F.col("key").cast("string")
    # layers of one key share a metadata file: one task writes them, in order
    rows = objects.select(key.alias("key"), F.col("layer").cast("string").alias("layer"), F.col("data").cast("binary").alias("data"), *names)
    return rows.repartition("key").sortWithinPartitions("key", "layer").mapInArrow(run, "key string, layer string, size long")


def delete_layers(keys: DataFrame, root: str) -> DataFrame:
    """key, existed: the keys' folders are removed; one that isn't there is no error."""

    def run(batches):
        fs, base = _opened(root)
        for batch in batches:
            existed = []
            for key in batch.column(0).to_pylist():
                there = fs.get_file_info(f"{base}/{key}").type == pafs.FileType.Directory
                if there:
                    fs.delete_dir(f"{base}/{key}")
                existed.append(there)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(existed)], ["key", "existed"])

    return keys.select(F.col("key").cast("string").alias("key")).distinct().mapInArrow(run, "key string, existed boolean")


def read_layers(spark: SparkSession, root: str) -> DataFrame:
    """`<root>/<key>/<layer>.bin` -> key, layer, data, size. Without `data` in the query no file is opened.
    Spark's file sources pass over files without bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.bin").load(root)
    pattern = r"([^/]+)/([^/]+)\.bin$"
    return files.select(F.regexp_extract("path", pattern, 1).alias("key"), F.regexp_extract("path", pattern, 2).alias("layer"), F.col("content").alias("data"), F.col("length").alias("size"))


def read_meta(spark: SparkSession, root: str) -> DataFrame:
    """`<root>/<key>/meta.json` -> key and its metadata; fields that are absent are null."""
    rows = spark.read.schema(META).option("recursiveFileLookup", "true").option("pathGlobFilter", "meta.json").option("multiLine", "true").json(root)
    return rows.select(F.regexp_extract(F.input_file_name(), r"([^/]+)/meta\.json$", 1).alias("key"), "*")


def write_shards(objects: DataFrame, path: str, shards: int, policy: str = "block") -> None:
    """objects (key, layer, data) as Parquet in a folder for each shard; Spark's commit makes it atomic."""
    shard = routing.shard(F.col("key"), F.col("layer"), F.lit(policy), shards)
    objects.withColumn("shard", shard).repartition(shards, "shard").write.mode("overwrite").partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def lookup_shards(spark: SparkSession, path: str, key: str, shards: int, layer: str = "", policy: str = "block") -> DataFrame:
    """One object; the shard's number prunes all other folders. Key-level operations go by key."""
    want = spark.range(1).select(routing.shard(F.lit(key), F.lit(layer), F.lit(policy), shards)).first()[0]
    rows = read_shards(spark, path).where((F.col("shard") == want) & (F.col("key") == key))
    return rows.where(F.col("layer") == layer) if layer else rows


def overlay(values: DataFrame, writes: DataFrame) -> DataFrame:
    """values (key, data), writes (key, seq, at, data): positional writes applied in order; gaps are zero bytes."""
    zero = lambda n: F.unhex(F.repeat(F.lit("00"), n.cast("int")))

    def put(a, w):
        head = F.when(F.octet_length(a) < w["at"], F.concat(a, zero(w["at"] - F.octet_length(a)))).otherwise(F.substring(a, F.lit(1), w["at"].cast("int")))
        return F.concat(head, w["data"], F.substring(a, (w["at"] + F.octet_length(w["data"]) + 1).cast("int"), F.octet_length(a)))

    steps = writes.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("seq", "at", F.col("data").cast("binary").alias("data")))).alias("w"))
    rows = values.join(steps, "key", "full")
    start = F.coalesce(F.col("data").cast("binary"), F.lit("").cast("binary"))
    done = F.aggregate(F.coalesce("w", F.array().cast("array<struct<seq:bigint,at:bigint,data:binary>>")), start, put)
    return rows.select("key", keys.hex_name(F.col("key")).alias("file"), done.alias("data"))


def usage(objects: DataFrame, capacity: int) -> DataFrame:
    """used and capacity over the latest value of each (key, layer); the capacity is reported, not enforced."""
    return objects.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("used"), F.lit(capacity).cast("long").alias("capacity"))
