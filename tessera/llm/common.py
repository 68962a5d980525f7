"""What the operators of this folder share: readers, shared storage, text helpers."""

from __future__ import annotations

import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.shared import remove, shared_dir, spread

#: A word, wherever a contract speaks of words.
WORD = r"[^\x20\x09-\x0D]+"
WORD_SPLIT = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Drops a query's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_cleaning: dict[str, list] = {}  # per session: how many writes are under way, and the setting before them
_lock = threading.Lock()


@contextmanager
def _cleaned(spark: SparkSession):
    """The setting holds while any write of the session is under way, also from several threads."""
    name = f"{spark.sparkContext.applicationId}-{spark._jsparkSession.hashCode()}"
    with _lock:
        held = _cleaning.setdefault(name, [0, None])
        if not held[0]:
            held[1] = spark.conf.get(CLEANUP, None)
            spark.conf.set(CLEANUP, "true")
        held[0] += 1
    try:
        yield
    finally:
        with _lock:
            held[0] -= 1
            if not held[0]:
                spark.conf.unset(CLEANUP) if held[1] is None else spark.conf.set(CLEANUP, held[1])


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends here and lost executors cost no
    recomputation. The shuffle files of the query that made it go with its end."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    with _cleaned(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing will read again: what was made of them is stored itself."""
    for df in tables:
        remove(df.sparkSession, df._stored_at)


def words_of(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
