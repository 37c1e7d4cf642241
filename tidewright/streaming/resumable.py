"""A stage over files that come one after another, and that can be stopped and taken up again.

Structured Streaming remembers which files are done; each batch of files is written to a folder of its
own number, so a batch that is run again replaces what it had written, and every row comes once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def run_stage(spark: SparkSession, source: str, schema: str, made: Callable[[DataFrame], DataFrame], out: str, *, kind: str = "json", files: int = 1) -> None:
    """Runs `made` on all files of the source folder that are not done yet, so many at a time, and returns.

    What is done is kept in `<out>/progress`, rows in `<out>/rows/batch=<n>`. A call after a failure or
    with new files does what is left.
    """

    def put(batch: DataFrame, number: int) -> None:
        made(batch).write.mode("overwrite").parquet(f"{out}/rows/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(kind).load(source)
    query = stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{out}/progress").trigger(availableNow=True).start()
    query.awaitTermination()


def stage_rows(spark: SparkSession, out: str) -> DataFrame:
    """The rows of all batches that are done, with the batch's number."""
    return spark.read.parquet(f"{out}/rows")
