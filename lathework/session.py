"""Session helpers: table access, the shared folder for intermediate tables, size arithmetic."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    The cluster names it in ``spark.checkpoint.dir``; only a purely local session (tests), where
    driver and executors are one process, falls back to a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
    named = "file://" + tempfile.mkdtemp(prefix="lathework-")
    spark.conf.set("spark.checkpoint.dir", named)
    return named


_written: list[str] = []


def release() -> None:
    """Remove all intermediate tables: to be called when the results that were made so far are consumed."""
    context = SparkContext._active_spark_context
    while _written:
        path = _written.pop()
        try:
            hadoop_path = context._jvm.org.apache.hadoop.fs.Path(path)
            hadoop_path.getFileSystem(context._jsc.hadoopConfiguration()).delete(hadoop_path, True)
        except Exception:  # noqa: BLE001  the session may already be gone; the cluster cleans its own scratch folder
            pass


atexit.register(release)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    Lineage is cut there: whatever executors are lost later, nothing upstream is computed again.
    The table is removed by release(), or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def spread(df: DataFrame) -> DataFrame:
    """``df`` on all cores, for costly work row by row: a table read in fewer splits than there are cores is dealt out first.

    Such a table is small; one of many splits stays as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
