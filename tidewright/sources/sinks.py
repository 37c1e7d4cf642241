"""JSON-lines sinks: whole, appended, in input order, split in two, dead letters, reports, plots.

Rows are written by tasks and committed by Spark's writer, so no lock is needed and a lost executor's
files don't count. Nulls are written, as are characters beyond ASCII.
"""

from __future__ import annotations

from functools import reduce
from html import escape

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidewright.operators.core import first_wins
from tidewright.sources.jsonl import manifest_of


def write_jsonl(df: DataFrame, path: str, *, mode: str = "overwrite") -> int:
    """Writes the rows and returns how many, counted on the way."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode(mode).option("ignoreNullFields", False).json(path)
    return seen.get["n"]


def append_jsonl(df: DataFrame, path: str) -> int:
    return write_jsonl(df, path, mode="append")


def write_ordered(rows: DataFrame, order: DataFrame, path: str, *, key: str, position: str) -> int:
    """Rows that stand in `order` (key, position), sorted by position across the written files."""
    own = rows.join(order.select(key, position), key).orderBy(position).drop(position)
    return write_jsonl(own, path)


def write_two_ways(rows: DataFrame, flag: Column, kept_path: str, other_path: str) -> tuple[int, int]:
    """Rows with the flag to the first path, all others (null flags too) to the second.

    The input runs once: flagged rows are written beside the first path and read from there, so a
    row stands in exactly one of the two, even where the flag isn't the same each time.
    """
    spark, whole = rows.sparkSession, f"{kept_path}.all"
    rows.withColumn("_flag", F.coalesce(flag, F.lit(False))).write.mode("overwrite").parquet(whole)
    once = spark.read.parquet(whole)
    counts = write_jsonl(once.filter("_flag").drop("_flag"), kept_path), write_jsonl(once.filter("not _flag").drop("_flag"), other_path)
    _remove(spark, whole)
    return counts


def _remove(spark: SparkSession, path: str) -> None:
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(own, True)


def write_with_failures(rows: DataFrame, path: str, *, error: str = "error") -> tuple[int, int]:
    """Rows without an error to the path, the others to `<path>.failures` with the time of writing; the input runs once."""
    stamped = rows.withColumn("failed_at", F.when(F.col(error).isNotNull(), F.current_timestamp()))
    spark, whole = rows.sparkSession, f"{path}.all"
    stamped.write.mode("overwrite").parquet(whole)
    once = spark.read.parquet(whole)
    counts = write_jsonl(once.filter(F.col(error).isNull()).drop(error, "failed_at"), path), write_jsonl(once.filter(F.col(error).isNotNull()), f"{path}.failures")
    _remove(spark, whole)
    return counts


def missing(order: DataFrame, rows: DataFrame, key: str) -> int:
    """How many rows of the input have no row in what was made of it."""
    return order.join(rows.select(key).distinct(), key, "left_anti").count()


def reconciled(parts: list[DataFrame], expected: int | None = None) -> DataFrame:
    """The rows of all shards; another number of them than expected raises."""
    out = reduce(DataFrame.unionByName, parts)
    if expected is not None and (n := out.count()) != expected:
        raise ValueError(f"{n} rows in the shards, {expected} expected")
    return out


def checkpoint_rows(done: DataFrame, order: DataFrame, *, key: str, index: str, position: str, written: str) -> DataFrame:
    """The first of each (key, index), by input order, then index; keys without a place come last, sorted."""
    own = first_wins(done, [key, index], [written]).join(order.select(key, position), key, "left")
    return own.orderBy(F.asc_nulls_last(position), key, index).drop(position)


def write_manifest(spark: SparkSession, values: dict, path: str) -> None:
    """A run's manifest as one text file."""
    spark.createDataFrame([(manifest_of(values),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_report(report: DataFrame, path: str) -> None:
    """A one-row frame as one JSON object."""
    report.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def source_counts(rows: DataFrame, source: str = "source") -> DataFrame:
    """Audit of where values come from: source, n."""
    return rows.groupBy(source).agg(F.count("*").alias("n"))


def preview(rows: DataFrame, position: str, n: int = 2) -> DataFrame:
    """The first n rows in input order."""
    return rows.orderBy(position).limit(n)


def svg_histogram(bins: list[tuple[float, float, int]], title: str, *, width: int = 640, height: int = 320) -> str:
    """A plot of (low, high, count) bins, a bounded number of rows, as SVG text."""
    most = max((n for *_, n in bins), default=0) or 1
    step = (width - 40) / max(len(bins), 1)
    parts = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}">', f'<text x="20" y="20">{escape(title)}</text>']
    for k, (low, high, n) in enumerate(bins):
        tall = (height - 70) * n / most
        parts.append(f'<rect x="{20 + k * step:.1f}" y="{height - 30 - tall:.1f}" width="{max(step - 1, 1):.1f}" height="{tall:.1f}"><title>{low:.4g} to {high:.4g}: {n}</title></rect>')
    if bins:
        parts.append(f'<text x="20" y="{height - 10}">{bins[0][0]:.4g}</text><text x="{width - 60}" y="{height - 10}">{bins[-1][1]:.4g}</text>')
    return "\n".join([*parts, "</svg>"])
