"""The folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a temporary one stands in, on a local
    master alone: on a cluster each executor would write to its own disk."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("tessera.shared.dir", None)
    if path is None:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("tessera.shared.dir", path)
        atexit.register(remove, spark, path)
    return path.rstrip("/")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, where it is a scan of fewer partitions: a file of one row group is one partition,
    however many cores wait. A larger input has partitions enough and isn't shuffled; nor is what comes out
    of joins and aggregates."""
    execution = df._jdf.queryExecution()
    cores = df.sparkSession.sparkContext.defaultParallelism
    if execution.executedPlan().nodeName() == "AdaptiveSparkPlan" or execution.toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(3 * cores)


def file_system(spark: SparkSession, path: str):
    """Hadoop's Path of a folder, and its file system, on the driver."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        target, fs = file_system(spark, path)
        fs.delete(target, True)
