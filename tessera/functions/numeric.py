"""Numbers as the tensors have them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_float(c: Column) -> Column:
    return c.cast("float")


def half(c: Column) -> Column:
    """The nearest 16-bit float, ties to even, subnormals kept; beyond 65504 not handled."""
    x = c.cast("double")
    exponent = F.greatest(F.floor(F.log2(F.abs(x))), F.lit(-14))
    unit = F.pow(F.lit(2.0), exponent - 10)
    return F.when(x == 0, F.lit(0.0)).otherwise(F.rint(x / unit) * unit).cast("float")


def channel_scale(low: Column, high: Column) -> Column:
    return F.greatest(as_float((high - low).cast("float") / F.lit(255.0)), as_float(F.lit(1e-8)))


def quantize(value: Column, low: Column, scale: Column) -> Column:
    step = as_float(as_float(as_float(value) - as_float(low)) / scale)
    return F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.rint(step))).cast("int")


def dequantize(q: Column, scale: Column, low: Column) -> Column:
    """With scale and zero point as 16-bit floats, in 32-bit arithmetic."""
    return as_float(as_float(as_float(q) * half(scale)) + half(low))


def align_up(n: Column, unit: int) -> Column:
    return F.floor((n + unit - 1) / unit) * unit
