"""Stripes: cutting, placing, re-bucketing and reassembling bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import routing


def stripes(objects: DataFrame, chunk: int) -> DataFrame:
    """objects (key, size) -> key, stripe_index, offset, length."""
    return objects.select("key", F.explode(routing.stripe_list(F.col("size"), chunk)).alias("s")).select("key", F.col("s.index").alias("stripe_index"), F.col("s.offset").alias("offset"), F.col("s.length").alias("length"))


def placed(cut: DataFrame, devices: int) -> DataFrame:
    """Stripes on devices in turn from the key's home on."""
    return cut.withColumn("device", routing.chunk_device(routing.md5_mod(F.col("key"), devices), F.col("stripe_index"), devices))


def rebucket(segments: DataFrame, chunk: int) -> DataFrame:
    """segments (key, seg, length) in order -> key, stripe_index, seg, seg_offset, stripe_offset, length: the
    pieces that fixed stripes take of variable segments. Offsets come from a running sum by key; each
    segment then names its stripes, so no range join is needed."""
    w = Window.partitionBy("key").orderBy("seg").rowsBetween(Window.unboundedPreceding, 0)
    rows = segments.withColumn("_stop", F.sum("length").over(w)).withColumn("_start", F.col("_stop") - F.col("length")).where("length > 0")
    rows = rows.withColumn("stripe_index", F.explode(F.sequence(F.floor(F.col("_start") / chunk), F.floor((F.col("_stop") - 1) / chunk))))
    begin = F.greatest("_start", F.col("stripe_index") * chunk)
    end = F.least("_stop", (F.col("stripe_index") + 1) * chunk)
    return rows.select("key", "stripe_index", "seg", (begin - F.col("_start")).alias("seg_offset"), (begin - F.col("stripe_index") * chunk).alias("stripe_offset"), (end - begin).alias("length"))


def joined(parts: Column) -> Column:
    """An array of binaries as one, each byte copied a constant number of times: as Latin-1 text, which
    stands for bytes one by one. Nulls are left out."""
    return F.encode(F.array_join(F.transform(parts, lambda p: F.decode(p.cast("binary"), "ISO-8859-1")), ""), "ISO-8859-1")


def reassemble(pieces: DataFrame, order: str = "stripe_index") -> DataFrame:
    """pieces (key, order, data): data joined in order."""
    parts = F.array_sort(F.collect_list(F.struct(order, "data")))
    return pieces.groupBy("key").agg(joined(F.transform(parts, lambda p: p["data"])).alias("data"), F.count(F.lit(1)).alias("pieces"))


def read_striped(expected: DataFrame, pieces: DataFrame) -> DataFrame:
    """expected (key, stripe_index, path), pieces (path, data) -> key, data, missing, status: the joined bytes of
    an object all of whose stripes are there, else not_found with the path of the first that isn't."""
    have = pieces.select("path", "data", F.lit(True).alias("_there"))
    rows = expected.join(have, "path", "left")
    gone = F.min(F.when(F.col("_there").isNull(), F.struct("stripe_index", "path")))
    parts = F.array_sort(F.collect_list(F.struct("stripe_index", F.col("data").cast("binary").alias("data"))))
    out = rows.groupBy("key").agg(gone.alias("gone"), parts.alias("parts"))
    whole = F.col("gone").isNull()
    return out.select("key", F.when(whole, joined(F.transform("parts", lambda p: p["data"]))).alias("data"), F.col("gone.path").alias("missing"), F.when(whole, "ok").otherwise("not_found").alias("status"))


def _layer_list(layers: list[tuple[str, int]]) -> Column:
    """The layers of a model, by name and bytes of a block, with their place and the bytes of a block before them."""
    rows, begin = [], 0
    for pos, (name, nbytes) in enumerate(layers):
        rows.append(F.struct(F.lit(pos).alias("pos"), F.lit(name).alias("layer"), F.lit(nbytes).cast("long").alias("nbytes"), F.lit(begin).cast("long").alias("begin")))
        begin += nbytes
    return F.array(*rows)


def gather_specs(specs: DataFrame, cache: DataFrame, layers: list[tuple[str, int]]) -> DataFrame:
    """specs (request, block_ids), cache (layer, block_id, data) -> request, data: all blocks of the first layer in
    the spec's order, then all of the next. One block id makes the form by blocks."""
    wanted = specs.select("request", F.posexplode("block_ids").alias("b", "block_id")).select("request", "b", "block_id", F.explode(_layer_list(layers)).alias("l"))
    rows = wanted.select("request", "b", "block_id", "l.pos", "l.layer").join(cache, ["layer", "block_id"])
    parts = F.array_sort(F.collect_list(F.struct("pos", "b", F.col("data").cast("binary").alias("data"))))
    return rows.groupBy("request").agg(joined(F.transform(parts, lambda p: p["data"])).alias("data"))


def scatter_specs(specs: DataFrame, gathered: DataFrame, layers: list[tuple[str, int]]) -> DataFrame:
    """The way back -> request, layer, block_id, data. Data of another length than the spec's blocks take gives
    null data."""
    total = sum(n for _, n in layers)
    rows = specs.join(gathered, "request").select("request", "data", F.size("block_ids").alias("n"), F.posexplode("block_ids").alias("b", "block_id"))
    rows = rows.select("*", F.explode(_layer_list(layers)).alias("l"))
    at = F.col("l.begin") * F.col("n") + F.col("b") * F.col("l.nbytes")
    whole = F.octet_length("data") == F.col("n") * total
    return rows.select("request", "l.layer", "block_id", F.when(whole, F.substring("data", (at + 1).cast("int"), F.col("l.nbytes").cast("int"))).alias("data"))


def leading_run(rows: DataFrame, index: str = "chunk") -> DataFrame:
    """rows (key, index, found): those before the key's first miss."""
    gap = rows.groupBy("key").agg(F.min(F.when(~F.col("found"), F.col(index))).alias("_gap"))
    return rows.join(gap, "key").where(F.col("_gap").isNull() | (F.col(index) < F.col("_gap"))).select(rows.columns)


def sub_chunks(segments: DataFrame, piece: int) -> DataFrame:
    """segments (key, seg, length) as a stream: key, seq, offset, length, total_size, is_last."""
    cut = segments.select("key", "seg", "length", F.explode(routing.stripe_list(F.col("length"), piece)).alias("s")).select("key", "seg", F.col("s.offset").alias("o"), F.col("s.length").alias("length"))
    w = Window.partitionBy("key").orderBy("seg", "o")
    every = Window.partitionBy("key")
    rows = cut.withColumn("seq", F.row_number().over(w)).withColumn("offset", F.sum("length").over(w) - F.col("length")).withColumn("total_size", F.sum("length").over(every)).withColumn("n", F.count(F.lit(1)).over(every))
    return rows.select("key", "seq", "offset", "length", "total_size", (F.col("seq") == F.col("n")).alias("is_last"))


def first_only(stream: DataFrame, header: list[str]) -> DataFrame:
    """A stream whose header columns are set on its first row alone."""
    return stream.select(*(F.when(F.col("seq") == 1, F.col(c)).alias(c) if c in header else F.col(c) for c in stream.columns))


def assemble_stream(chunks: DataFrame) -> DataFrame:
    """chunks (stream_id, seq, data, header, is_last) -> the header of the first and the data up to the first
    last chunk; `invalid_argument` for a stream without data rows."""
    end = chunks.where("is_last").groupBy("stream_id").agg(F.min("seq").alias("_end"))
    live = chunks.join(end, "stream_id", "left").where(F.col("_end").isNull() | (F.col("seq") <= F.col("_end")))
    parts = F.array_sort(F.collect_list(F.struct("seq", "data")))
    data = joined(F.transform(parts, lambda p: p["data"]))
    out = live.groupBy("stream_id").agg(F.min_by("header", "seq").alias("header"), data.alias("data"), F.count("data").alias("chunks"))
    return out.withColumn("status", F.when(F.col("chunks") == 0, "invalid_argument").otherwise("ok"))


def lanes(segments: DataFrame, n: int) -> DataFrame:
    """segments (key, seg) in n contiguous lanes; a lane without segments holds a padding row, so that its
    presence can be probed."""
    sizes = segments.groupBy("key").agg(F.count(F.lit(1)).alias("_n"))
    every = sizes.select("key", F.posexplode(routing.partition_counts(F.col("_n"), n)).alias("lane", "lane_size"))
    w = Window.partitionBy("key").orderBy("seg")
    own = segments.withColumn("lane", F.ntile(n).over(w) - 1)
    return every.join(own, ["key", "lane"], "left").select("key", "lane", "seg", F.col("seg").isNull().alias("is_padding"))


def gather_lanes(rows: DataFrame, n: int) -> DataFrame:
    """key, segments in order; a key of which a lane is missing is a miss."""
    out = rows.groupBy("key").agg(F.count_distinct("lane").alias("_l"), F.array_sort(F.collect_list(F.when(~F.col("is_padding"), F.col("seg")))).alias("segs"))
    return out.select("key", (F.col("_l") == n).alias("hit"), F.when(F.col("_l") == n, F.col("segs")).alias("segs"))


def byte_layout(layers: DataFrame) -> DataFrame:
    """layers (key, pos, nbytes) -> + offset, total: exclusive prefix sums."""
    w = Window.partitionBy("key").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return layers.withColumn("offset", F.coalesce(F.sum("nbytes").over(w), F.lit(0))).withColumn("total", F.sum("nbytes").over(Window.partitionBy("key")))


def slots(requests: DataFrame, block: int) -> DataFrame:
    """requests (request, block_ids, n) -> request, pos, slot."""
    rows = requests.select("request", "n", F.posexplode("block_ids").alias("b", "block_id")).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(block - 1))))
    rows = rows.withColumn("pos", F.col("b") * block + F.col("o")).where("pos < n")
    return rows.select("request", "pos", (F.col("block_id") * block + F.col("o")).alias("slot"))
