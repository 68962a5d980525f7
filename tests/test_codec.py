import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import numeric
from tessera.operators import codec


@pytest.mark.parametrize(("shape", "dtype", "bound"), [([2, 32, 128], "float16", 0.1), ([2, 8, 128], "float32", 0.05), ([2, 4, 64], "bfloat16", 0.1), ([32, 64], "float16", 0.1), ([4, 8, 16, 32], "float16", 0.1), ([128], "float32", 0.01)])
def test_container(shape, dtype, bound):
    x = np.random.default_rng(1).standard_normal(shape).astype(np.float32)
    data = codec.pack(x, shape, dtype)
    y, back, kind = codec.unpack(data)
    assert (back, kind) == (shape, dtype) and np.abs(x - y).max() < bound
    assert data[:6] == struct.pack("<IBB", codec.MAGIC_CODEC, codec.DTYPES[dtype], len(shape))
    assert len(data) == 6 + 4 * len(shape) + 8 + x.size + 4 * shape[-1]


@pytest.mark.parametrize("dtype", ["float16", "bfloat16", "float32"])
def test_plain_container_is_exact(dtype):
    x = codec._cast(np.random.default_rng(2).standard_normal((2, 8, 64)), dtype)
    y, shape, kind = codec.unpack_plain(codec.pack_plain(x, [2, 8, 64], dtype))
    assert (x == y).all() and shape == [2, 8, 64] and kind == dtype


def test_half_equals_numpy(spark):
    x = np.concatenate([np.random.default_rng(3).standard_normal(2000) * 10.0 ** np.arange(-8, 2).repeat(200), [0.0, 1.0, 65504.0, -2.5]]).astype(np.float32)
    got = spark.createDataFrame([(float(v),) for v in x], "v float").select("v", numeric.half(F.col("v")).alias("h")).collect()
    assert all(r["h"] == np.float32(np.float16(np.float32(r["v"]))) for r in got)


def test_rows_equal_containers(spark):
    x = np.random.default_rng(4).standard_normal((20, 8)).astype(np.float32)
    x[:, 3] = 1.5  # a constant channel
    v = spark.createDataFrame([("t", i, j, float(x[i, j])) for i in range(20) for j in range(8)], "tensor string, row int, channel int, v float")
    encoded = codec.encode(v)
    back = np.zeros((20, 8), np.float32)
    for r in codec.decode(encoded, codec.channels(v)).collect():
        back[r["row"], r["channel"]] = r["v"]
    assert np.array_equal(back, codec.unpack(codec.pack(x, [20, 8], "float32"))[0])
