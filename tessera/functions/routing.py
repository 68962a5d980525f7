"""Where keys, stripes and lists go."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def md5_mod(key: Column, n: Column | int) -> Column:
    """The 128-bit number of md5(key) modulo n, folded from four 32-bit words; for n below 2 ** 31."""
    n = F.lit(n).cast("long") if isinstance(n, int) else n.cast("long")
    d = F.md5(key.cast("binary"))
    words = F.transform(F.sequence(F.lit(1), F.lit(25), F.lit(8)), lambda i: F.conv(F.substring(d, i, F.lit(8)), 16, 10).cast("long"))
    return F.aggregate(words, F.lit(0).cast("long"), lambda a, w: (a * F.lit(4294967296) % n + w) % n).cast("int")


def shard(key: Column, layer: Column, policy: Column, n: int) -> Column:
    """By layer under the policy `layer` where there is one, else by key."""
    return F.when((policy == "layer") & (F.coalesce(layer, F.lit("")) != ""), md5_mod(layer, n)).otherwise(md5_mod(key, n))


def chunk_device(home: Column, index: Column, devices: Column | int) -> Column:
    devices = F.lit(devices) if isinstance(devices, int) else devices
    return F.pmod(home + index, devices).cast("int")


def stored_or_routed(stored: Column, routed: Column) -> Column:
    """A path that metadata holds stays, whatever the number of devices has become."""
    return F.coalesce(F.nullif(stored, F.lit("")), routed)


def valid_device(device: Column, routed: Column, devices: int) -> Column:
    """Metadata's device where there is such a one, else the routed one."""
    return F.when((device >= 0) & (device < devices), device).otherwise(routed)


def should_stripe(size: Column, threshold: int, devices: int) -> Column:
    return F.lit(threshold > 0 and devices > 1) & (size > threshold)


def stripe_count(size: Column, chunk: int) -> Column:
    return F.ceil(size / chunk).cast("int")


def stripe_list(size: Column, chunk: int) -> Column:
    """(index, offset, length) of each stripe."""
    n = stripe_count(size, chunk)
    one = lambda i: F.struct(i.alias("index"), (i * F.lit(chunk).cast("long")).alias("offset"), F.least(F.lit(chunk).cast("long"), size - i * F.lit(chunk).cast("long")).alias("length"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), one))


def byte_chunks(data: Column, chunk: int) -> Column:
    """data in pieces of `chunk` bytes; empty data is one empty piece."""
    raw = data.cast("binary")
    n = F.greatest(F.lit(1), F.ceil(F.octet_length(raw) / chunk).cast("int"))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(raw, i * chunk + 1, F.lit(chunk)))


def partition_counts(total: Column, n: int) -> Column:
    """n contiguous counts that differ by one at most, larger ones first."""
    base, extra = F.floor(total / n), total % n
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (base + F.when(i < extra, 1).otherwise(0)).cast("int"))


def csv_items(csv: Column) -> Column:
    return F.filter(F.transform(F.split(csv, ","), lambda x: F.trim(x)), lambda x: x != "")


def slice_csv(csv: Column, n: Column, index: Column) -> Column:
    """Item `index` of a list of n; a list of one is shared, any other is taken in turn; empty stays."""
    items = csv_items(csv)
    size = F.size(items)
    return F.when(size == 0, csv).when(size == n, F.get(items, index)).when(size == 1, F.get(items, F.lit(0))).otherwise(F.get(items, (index % size).cast("int")))
