"""XXH3-64, which Spark lacks: Arrow batches to the xxhash module. Spark's xxhash64 is another hash."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _each(c: pd.Series, f) -> pd.Series:
    """f over a batch's distinct values; null stays null."""
    at, values = pd.factorize(c)
    out = np.array([*(f(x.encode()) for x in values), None], object)
    return pd.Series(out[at], index=c.index)


@F.pandas_udf(StringType())
def xxh3_hex(c: pd.Series) -> pd.Series:
    return _each(c, xxhash.xxh3_64_hexdigest)


def xxh3_mod(c: Column, n: int) -> Column:
    """The unsigned hash modulo n."""

    @F.pandas_udf("int")
    def mod(values: pd.Series) -> pd.Series:
        return _each(values, lambda x: xxhash.xxh3_64_intdigest(x) % n).astype("Int32")

    return mod(c)


def content_etag(canonical: Column, generation: Column, size: Column, created: Column) -> Column:
    return xxh3_hex(F.concat_ws("|", canonical, F.concat(F.lit("generation="), generation.cast("string")), F.concat(F.lit("size="), size.cast("string")), F.concat(F.lit("created_at="), created.cast("string"))))


def object_handle(canonical: Column, generation: Column, layout: Column, size: Column, created: Column) -> Column:
    g, v = generation.cast("string"), layout.cast("string")
    seed = F.concat_ws("|", canonical, F.concat(F.lit("generation="), g), F.concat(F.lit("layout="), v), F.concat(F.lit("size="), size.cast("string")), F.concat(F.lit("created_at="), created.cast("string")))
    return F.concat(F.lit("ctxobj-v1-"), F.md5(canonical.cast("binary")), F.lit("-g"), g, F.lit("-l"), v, F.lit("-"), xxh3_hex(seed))


def handle_or_fallback(handle: Column, canonical: Column, generation: Column, layout: Column) -> Column:
    return F.when(F.coalesce(handle, F.lit("")) != "", handle).otherwise(F.concat(F.lit("v1:"), canonical, F.lit(":g"), generation.cast("string"), F.lit(":l"), layout.cast("string")))
