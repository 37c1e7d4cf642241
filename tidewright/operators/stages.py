"""Stages of a run: which are to run, what they need, and addresses of services."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Flags that switch a stage on.
ON = ("1", "true", "yes", "on")


def materialised(spark: SparkSession, path: str) -> bool:
    """Whether a file or a folder with a file that isn't empty stands at the path, in any store that Spark reads."""
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(system.exists(own) and system.getContentSummary(own).getLength() > 0)


def stage_enabled(spark: SparkSession, flag: str, output: str = "") -> bool:
    """`auto` runs a stage whose output is missing or empty (or isn't named); other flags switch it on or off."""
    own = flag.strip().lower()
    return not output or not materialised(spark, output) if own == "auto" else own in ON


def required(spark: SparkSession, path: str) -> str:
    """The path, if something stands there; else an error."""
    if not materialised(spark, path):
        raise FileNotFoundError(f"missing or empty: {path}")
    return path


def not_empty(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"no rows: {what}")
    return df


def completions_url(base: str) -> str:
    """The address of a service's chat completions."""
    own = base.rstrip("/")
    return own if own.endswith("/chat/completions") else f"{own}/chat/completions"
