"""Readers for the parquet tables of a data folder, by any path that Spark can open."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def evenly(df: DataFrame) -> DataFrame:
    """The rows dealt to all cores where a scan has fewer tasks than there are cores (a file of one large row group).

    For what costs much more by row than a shuffle of the row does; scans of many files stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def fixed_splits(spark: SparkSession) -> None:
    """From now on this session cuts files alike in each scan; else Spark counts the cores anew, and executors come and go.

    For what learns about file blocks in one scan and reads them again in another.
    """
    name = "spark.sql.files.minPartitionNum"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(max(1, spark.sparkContext.defaultParallelism)))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; a local folder only where all run on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tidewright-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    path = f"{found.rstrip('/')}/files/{name}-{uuid.uuid4().hex}"
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(own)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written once to the shared folder and read again, for what several branches of a plan use."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
