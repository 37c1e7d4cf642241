"""Small helpers around the session: working tables in the shared folder, and narrow selections."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set and all run on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tidewright-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _hadoop(spark: SparkSession, path: str):
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return own, own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def kept(df: DataFrame, name: str) -> DataFrame:
    """The rows written once to the shared folder and read again: lineage ends here.

    The table goes with `dropped`, or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidewright/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    own, system = _hadoop(spark, path)
    system.deleteOnExit(own)
    found = spark.read.schema(df.schema).parquet(path)
    found._kept_path = path
    return found


def dropped(*frames: DataFrame) -> None:
    """Deletes the tables of frames made by `kept` that nothing reads any more."""
    for df in frames:
        own, system = _hadoop(df.sparkSession, df._kept_path)
        system.delete(own, True)


def quoted(column: str) -> str:
    """A column's name as F.col takes it, whatever signs it has."""
    return "`" + column.replace("`", "``") + "`"


def filtered(docs: DataFrame, run, text_col: str) -> DataFrame:
    """mapInArrow that keeps the schema, whatever the columns are called: all but the text have plain names meanwhile."""
    plain = docs.toDF(*[c if c == text_col else f"_c{k}" for k, c in enumerate(docs.columns)])
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Two columns with fixed names, whatever else the table holds; ids are whole numbers (or their digits), any other text as an id stops the query."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def id_remainder(column: str, n: int) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def smallest_hashes(rows: DataFrame, group: str, key: str, k: int) -> DataFrame:
    """The k rows of each group with the smallest hash of their key (ties by key).

    A histogram of hashes (at most 65,536 bins a group, combined map-side) gives the bin in which the
    k-th row lies; only rows up to that bin are shuffled, so a group of any size costs no task more
    than k rows and one bin's. Groups must be few (one row for each is broadcast).
    """
    h = F.xxhash64(key)
    own = rows.withColumn("_bin", F.shiftright(h, 48))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_bin")) - F.col("_n")
    bins = own.groupBy(group, "_bin").agg(F.count("*").alias("_n")).withColumn("_before", before)
    cut = bins.filter(F.col("_before") < k).groupBy(group).agg(F.max("_bin").alias("_cut"))
    near = own.join(F.broadcast(cut), group).filter("_bin <= _cut")
    place = F.row_number().over(Window.partitionBy(group).orderBy(h, key))
    return near.withColumn("_place", place).filter(F.col("_place") <= k).select(*rows.columns)
