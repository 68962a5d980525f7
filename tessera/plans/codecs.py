"""Queries of the tensor codec, on the embeddings as one tensor of rows by channels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import numeric
from tessera.operators import codec
from tessera.plans import query
from tessera.plans.tables import table

VAL = "val AS (SELECT vec_id AS \"row\", i AS channel, embedding[i + 1] AS v FROM (SELECT *, unnest(range(len(embedding))) AS i FROM embeddings))"
CHN = "chn AS (SELECT channel, min(v)::FLOAT AS low, greatest(((max(v)::FLOAT - min(v)::FLOAT) / 255.0::DOUBLE)::FLOAT, 1e-8::FLOAT) AS scale FROM val GROUP BY channel)"
ENC = "enc AS (SELECT \"row\", val.channel, low, scale, v, greatest(0, least(255, round_even((((v - low)::FLOAT)::DOUBLE / scale::DOUBLE)::FLOAT, 0)))::INT AS q FROM val JOIN chn ON val.channel = chn.channel)"


def half_sql(x: str) -> str:
    e = f"greatest(floor(log2(abs({x}::DOUBLE))), -14)"
    return f"(CASE WHEN {x} = 0 THEN 0.0::FLOAT ELSE (round_even({x}::DOUBLE / pow(2.0::DOUBLE, {e} - 10), 0) * pow(2.0::DOUBLE, {e} - 10))::FLOAT END)"


def _values(spark, d):
    e = table(spark, d, "embeddings")
    return e.select(F.lit("t").alias("tensor"), F.col("vec_id").alias("row"), F.posexplode("embedding").alias("channel", "v"))


@query("AGG-16 COD-01", f"WITH {VAL}, {CHN} SELECT channel, low, scale FROM chn")
def codec_channels(spark, d):
    return codec.channels(_values(spark, d)).drop("tensor")


@query("COD-01 COD-09", f"WITH {VAL}, {CHN}, {ENC} SELECT \"row\", channel, q FROM enc")
def codec_encode(spark, d):
    return codec.encode(_values(spark, d)).drop("tensor")


@query("COD-03", f"WITH {VAL}, {CHN} SELECT channel, {half_sql('scale')} AS scale16, {half_sql('low')} AS low16 FROM chn")
def codec_half(spark, d):
    c = codec.channels(_values(spark, d))
    return c.select("channel", numeric.half(F.col("scale")).alias("scale16"), numeric.half(F.col("low")).alias("low16"))


DEC = f"dec AS (SELECT \"row\", channel, v, ((q::FLOAT * {half_sql('scale')})::FLOAT + {half_sql('low')})::FLOAT AS x FROM enc)"


@query("COD-02 COD-09", f"WITH {VAL}, {CHN}, {ENC}, {DEC} SELECT \"row\", channel, x AS v FROM dec")
def codec_decode(spark, d):
    v = _values(spark, d)
    return codec.decode(codec.encode(v), codec.channels(v)).drop("tensor")


@query("COD-07", f"WITH {VAL}, {CHN}, {ENC}, {DEC} SELECT count(*) * 4 / (count(*) + 4 * count(DISTINCT channel))::DOUBLE AS ratio, max(abs(x::DOUBLE - v::DOUBLE)) < 0.05 AS within FROM dec")
def codec_error(spark, d):
    v = _values(spark, d)
    back = codec.decode(codec.encode(v), codec.channels(v)).withColumnRenamed("v", "x")
    both = v.join(back, ["tensor", "row", "channel"])
    n = F.count(F.lit(1))
    return both.agg((n * 4 / (n + 4 * F.count_distinct("channel"))).alias("ratio"), (F.max(F.abs(F.col("x").cast("double") - F.col("v").cast("double"))) < 0.05).alias("within"))


def _tensors(spark, d):
    e = table(spark, d, "embeddings")
    dtype = F.element_at(F.array(*map(F.lit, ("float16", "bfloat16", "float32"))), (F.col("vec_id") % 3 + 1).cast("int"))
    return e.select(F.col("vec_id").alias("tensor"), F.col("embedding").alias("values"), F.array(F.lit(4), F.lit(16)).alias("shape"), dtype.alias("dtype"))


def half_hex_sql(x: str) -> str:
    """The bytes of a 16-bit float, low one first, from a number that is one."""
    small = f"abs({x}::DOUBLE)"
    power = f"floor(log2({small}))"
    bits = f"(CASE WHEN {x} = 0 THEN 0 WHEN {small} < pow(2.0::DOUBLE, -14) THEN {small} * pow(2.0::DOUBLE, 24) ELSE ({power} + 15) * 1024 + ({small} / pow(2.0::DOUBLE, {power}) - 1) * 1024 END + CASE WHEN {x} < 0 THEN 32768 ELSE 0 END)::INT"
    return f"printf('%02X%02X', {bits} & 255, {bits} >> 8)"


CONTAINERS = f"""WITH el AS (SELECT vec_id AS tensor, i, i % 16 AS channel, embedding[i + 1]::FLOAT AS v FROM (SELECT *, unnest(range(len(embedding))) AS i FROM embeddings)),
ch AS (SELECT tensor, channel, min(v) AS low, greatest(((max(v) - min(v))::FLOAT / 255.0::DOUBLE)::FLOAT, 1e-8::FLOAT) AS scale FROM el GROUP BY ALL),
hf AS (SELECT tensor, channel, {half_sql('low')} AS low, {half_sql('scale')} AS scale FROM ch),
q AS (SELECT el.tensor, string_agg(printf('%02X', greatest(0, least(255, round_even((((v - low)::FLOAT)::DOUBLE / scale::DOUBLE)::FLOAT, 0)))::INT), '' ORDER BY i) AS hex FROM el JOIN ch ON el.tensor = ch.tensor AND el.channel = ch.channel GROUP BY el.tensor),
z AS (SELECT tensor, string_agg({half_hex_sql('scale')}, '' ORDER BY channel) || string_agg({half_hex_sql('low')}, '' ORDER BY channel) AS hex FROM hf GROUP BY tensor),
b AS (SELECT q.tensor, unhex('000001C5' || printf('%02X', q.tensor % 3) || '02' || '04000000' || '10000000' || '40000000' || '10000000' || q.hex || z.hex) AS data FROM q JOIN z ON q.tensor = z.tensor)
SELECT tensor, octet_length(data) AS nbytes, ['float16', 'bfloat16', 'float32'][tensor % 3 + 1] AS dtype, 64 AS n, sha256(data) AS digest FROM b"""


@query("COD-04 COD-05 CON-08", CONTAINERS)
def codec_containers(spark, d):
    """A container's bytes: magic, dtype, shape, counts, quantized elements, scales and zero points."""
    t = _tensors(spark, d)
    packed = codec.pack_rows(t)
    return packed.join(codec.unpack_rows(packed), "tensor").select("tensor", F.octet_length("data").alias("nbytes"), "dtype", F.size("values").alias("n"), F.sha2("data", 256).alias("digest"))


@query("COD-06", "SELECT vec_id AS tensor, 14 + 64 * (CASE WHEN vec_id % 3 = 2 THEN 4 ELSE 2 END) AS nbytes, CASE vec_id % 3 WHEN 0 THEN 'float16' WHEN 1 THEN 'bfloat16' ELSE 'float32' END AS dtype, 64 AS n, true AS exact FROM embeddings WHERE vec_id % 3 = 2 UNION ALL SELECT vec_id, 142, CASE vec_id % 3 WHEN 0 THEN 'float16' ELSE 'bfloat16' END, 64, true FROM embeddings WHERE vec_id % 3 <> 2")
def codec_plain(spark, d):
    """Packing what was unpacked gives the same bytes."""
    packed = codec.pack_rows(_tensors(spark, d), plain=True)
    back = codec.unpack_rows(packed, plain=True)
    again = codec.pack_rows(back, plain=True).withColumnRenamed("data", "again")
    return packed.join(back, "tensor").join(again, "tensor").select("tensor", F.octet_length("data").alias("nbytes"), "dtype", F.size("values").alias("n"), (F.col("data") == F.col("again")).alias("exact"))


@query("COD-08 COD-11 CON-06", f"""WITH {VAL}, s AS (SELECT vec_id AS slot, vec_id AS pos FROM embeddings WHERE vec_id < (SELECT count(*) FROM embeddings) // 4 * 4) SELECT slot, channel, CASE WHEN (pos // 4) % 3 = 1 THEN 0.0::FLOAT ELSE v END AS v FROM s JOIN val ON val."row" = s.slot""")
def saved_and_loaded_layer(spark, d):
    """Blocks of four slots, of which one in three is missing on load."""
    v = _values(spark, d)
    n = table(spark, d, "embeddings").count() // 4 * 4
    at = v.select(F.col("row").alias("slot")).distinct().where(F.col("slot") < n).withColumn("pos", F.col("slot"))
    saved = codec.save_layer(v.select(F.col("row").alias("slot"), "channel", "v"), at, 4)
    return codec.load_layer(saved.where(F.col("tensor").cast("long") % 3 != 1), at, 4)
