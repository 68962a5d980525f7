"""Per-channel 8-bit quantization of tensors, as rows or as binary containers."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import numeric

#: Container magics and dtype numbers.
MAGIC_CODEC, MAGIC_PLAIN = 0xC5010000, 0xC5000000
DTYPES = {"float16": 0, "bfloat16": 1, "float32": 2, "uint8": 3}


def channels(values: DataFrame) -> DataFrame:
    """values (tensor, row, channel, v) -> tensor, channel, low, scale."""
    stats = values.groupBy("tensor", "channel").agg(F.min("v").cast("float").alias("low"), F.max("v").cast("float").alias("high"))
    return stats.select("tensor", "channel", "low", numeric.channel_scale(F.col("low"), F.col("high")).alias("scale"))


def encode(values: DataFrame) -> DataFrame:
    """tensor, row, channel, q. Channels are few beside values; Spark picks the join."""
    rows = values.join(channels(values), ["tensor", "channel"])
    return rows.select("tensor", "row", "channel", numeric.quantize(F.col("v"), F.col("low"), F.col("scale")).alias("q"))


def decode(encoded: DataFrame, of: DataFrame) -> DataFrame:
    """tensor, row, channel, v from q and the channels' scales and zero points as 16-bit floats."""
    rows = encoded.join(of, ["tensor", "channel"])
    return rows.select("tensor", "row", "channel", numeric.dequantize(F.col("q"), F.col("scale"), F.col("low")).alias("v"))


def _bfloat(x: np.ndarray) -> np.ndarray:
    """The upper halves of 32-bit floats, rounded to even."""
    bits = x.astype(np.float32).view(np.uint32).astype(np.uint64)
    return ((bits + 0x7FFF + ((bits >> 16) & 1)) >> 16).astype(np.uint16)


def _cast(x: np.ndarray, dtype: str) -> np.ndarray:
    """float32 values as the dtype holds them."""
    if dtype == "bfloat16":
        return (_bfloat(x).astype(np.uint32) << 16).view(np.float32)
    return x.astype(np.float16).astype(np.float32) if dtype == "float16" else x.astype(np.float32)


def pack(values: np.ndarray, shape: list[int], dtype: str) -> bytes:
    flat = values.astype(np.float32).reshape(-1, shape[-1])
    low, high = flat.min(axis=0), flat.max(axis=0)
    scale = np.maximum((high - low) / np.float32(255), np.float32(1e-8))
    q = np.clip(np.rint((flat - low) / scale), 0, 255).astype(np.uint8)
    head = struct.pack(f"<IBB{len(shape)}III", MAGIC_CODEC, DTYPES[dtype], len(shape), *shape, q.size, len(scale))
    return head + q.tobytes() + scale.astype("<f2").tobytes() + low.astype("<f2").tobytes()


def _head(data: bytes) -> tuple[str, list[int], int]:
    _, number, ndim = struct.unpack_from("<IBB", data)
    shape = list(struct.unpack_from(f"<{ndim}I", data, 6))
    return {v: k for k, v in DTYPES.items()}.get(number, "float32"), shape, 6 + 4 * ndim


def unpack(data: bytes) -> tuple[np.ndarray, list[int], str]:
    """The magic isn't checked."""
    dtype, shape, at = _head(data)
    n, last = struct.unpack_from("<II", data, at)
    at += 8
    q = np.frombuffer(data, np.uint8, n, at).reshape(-1, last).astype(np.float32)
    scale = np.frombuffer(data, "<f2", last, at + n).astype(np.float32)
    low = np.frombuffer(data, "<f2", last, at + n + 2 * last).astype(np.float32)
    return _cast(q * scale + low, dtype).reshape(shape), shape, dtype


def pack_plain(values: np.ndarray, shape: list[int], dtype: str) -> bytes:
    """Without quantization: a header and the raw elements."""
    head = struct.pack(f"<IBB{len(shape)}I", MAGIC_PLAIN, DTYPES[dtype], len(shape), *shape)
    raw = _bfloat(values).astype("<u2") if dtype == "bfloat16" else values.astype({"float16": "<f2", "float32": "<f4", "uint8": "u1"}[dtype])
    return head + raw.tobytes()


def unpack_plain(data: bytes) -> tuple[np.ndarray, list[int], str]:
    dtype, shape, at = _head(data)
    n = int(np.prod(shape))
    if dtype == "bfloat16":
        return (np.frombuffer(data, "<u2", n, at).astype(np.uint32) << 16).view(np.float32).reshape(shape), shape, dtype
    return np.frombuffer(data, {"float16": "<f2", "float32": "<f4", "uint8": "u1"}[dtype], n, at).astype(np.float32).reshape(shape), shape, dtype


def pack_rows(tensors: DataFrame, plain: bool = False) -> DataFrame:
    """tensors (tensor, values array<float>, shape array<int>, dtype) -> tensor, data."""

    @F.pandas_udf("binary")
    def packed(values: pd.Series, shapes: pd.Series, dtypes: pd.Series) -> pd.Series:
        f = pack_plain if plain else pack
        return pd.Series([f(np.asarray(v, np.float32), [int(x) for x in s], d) for v, s, d in zip(values, shapes, dtypes, strict=True)])

    return tensors.select("tensor", packed("values", "shape", "dtype").alias("data"))


def unpack_rows(packed: DataFrame, plain: bool = False) -> DataFrame:
    """tensor, data -> tensor, values, shape, dtype."""
    kind = "values array<float>, shape array<int>, dtype string"

    @F.pandas_udf(kind)
    def values(data: pd.Series) -> pd.DataFrame:
        f = unpack_plain if plain else unpack
        got = [f(bytes(d)) for d in data]
        return pd.DataFrame({"values": [v.ravel() for v, _, _ in got], "shape": [s for _, s, _ in got], "dtype": [t for _, _, t in got]})

    return packed.select("tensor", values("data").alias("u")).select("tensor", "u.*")


def save_layer(values: DataFrame, slots: DataFrame, block: int) -> DataFrame:
    """values (slot, channel, v), slots (key_index, pos, slot) in order of pos: the rows of each block of
    `block` positions, encoded with the block as the tensor."""
    rows = slots.withColumn("tensor", F.floor(F.col("pos") / block).cast("string")).join(values, "slot")
    return rows.select("tensor", (F.col("pos") % block).alias("row"), "channel", "v")


def load_layer(decoded: DataFrame, slots: DataFrame, block: int) -> DataFrame:
    """Back to slots; slots of blocks that are missing get zero."""
    at = slots.withColumn("tensor", F.floor(F.col("pos") / block).cast("string")).withColumn("row", F.col("pos") % block)
    width = decoded.select("channel").distinct()
    have = at.join(decoded, ["tensor", "row"], "left")
    return have.where("channel is not null").select("slot", "channel", "v").unionByName(
        have.where("channel is null").select("slot").join(width.agg(F.array_sort(F.collect_set("channel")).alias("c"))).select("slot", F.explode("c").alias("channel"), F.lit(0.0).cast("float").alias("v")))
