"""What is checked before bytes move: sizes, transfers, handles and targets, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The largest value of a put, and the status numbers of object clients.
MOST_PUT = 4 << 30
BAD_OFFSET, NOT_FOUND, BAD_LENGTH = -2, -4, -6


def put_size(size: Column) -> Column:
    """Whether a put of this size is let in: neither empty nor above MOST_PUT."""
    return F.coalesce((size > 0) & (size <= MOST_PUT), F.lit(False))


def transfer(operation: Column, local: Column, remote: Column, n_local: Column, n_remote: Column) -> Column:
    """Reads and writes go between memory here and objects there, with as many descriptors on either side.
    Another agent's name is no error."""
    known = operation.isin("read", "write") & (local == "dram") & (remote == "object")
    return F.when(~F.coalesce(known, F.lit(False)), "invalid_param").when(n_local != n_remote, "mismatch").otherwise("ok")


def chunk_handle(handle: Column, managed: Column, device: Column, devices: int, expected: Column) -> Column:
    """A chunk's handle must lie under a root, its device must be there, and it must be the path that the
    descriptor gives."""
    return (F.when(~managed, "unmanaged_path").when((device < 0) | (device >= devices), "device_out_of_range")
            .when(handle != expected, "handle_mismatch").otherwise("ok"))


def object_put(offset: Column, stored: Column) -> Column:
    """An object client's put: no offsets; what the server rejects is a failure."""
    return F.when(offset != 0, BAD_OFFSET).when(stored, 0).otherwise(NOT_FOUND)


def object_get(offset: Column, asked: Column, size: Column) -> Column:
    """An object client's get: no offsets, and the value must have the asked length; a null size is a miss."""
    return F.when(offset != 0, BAD_OFFSET).when(size.isNull(), NOT_FOUND).when(asked != size, BAD_LENGTH).otherwise(0)


def object_exists(transport: Column, found: Column) -> Column:
    """(size, found) as such a client reports them: the size is unknown, and one transport can't tell at all."""
    return F.struct(F.lit(0).cast("long").alias("size"), ((transport == "grpc") & found).alias("found"))


def read_into(target: Column, size: Column) -> Column:
    """What a read into a buffer does: bytes read, null for a miss, and an error for a buffer that is too small."""
    return F.struct(F.when(target >= size, size).alias("read"), F.when(size.isNotNull() & (target < size), "target_too_small").alias("error"))
