"""JSON-lines sources: strict and tolerant scans in file order, splits, categories, lookups.

Every scan can carry the physical line number of each row. It is worked out without a sort or a shuffle
of lines: they are numbered inside their file block (a task's own input), blocks by a sum over blocks.
"""

from __future__ import annotations

import json
import shlex
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.functions.text import blank, compact, first_truthy, strip
from tidewright.operators.core import first_wins, last_wins
from tidewright.operators.order import running
from tidewright.sources.tables import fixed_splits, written

SPLITS = ("train", "valid", "test")
_BAD = "_corrupt_record"


def _schema(schema: T.StructType | str) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def numbered_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """value, file, line_no (from 1 in each file, blank lines counted) and place (from 1 over all files, by name) of every physical line.

    Lines aren't shuffled. Both scans must cut the files alike (`fixed_splits`): a line of a block that
    the first scan didn't see fails the query.

    A first scan counts the lines of each file block and finds where the block begins in its task; the
    second numbers lines where they are read. The table between them has one row a block and is
    written, so Catalyst knows its size and broadcasts it only where it is small.
    """
    fixed_splits(spark)
    raw = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("mid"))
    blocks = raw.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("mid").alias("first"))
    sums = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("first") + 1
    starts = written(blocks.select("file", "block", sums(Window.partitionBy("file").orderBy("block")).alias("base"), sums(Window.orderBy("file", "block")).alias("all")), "blocks")
    from_block = lambda c: (F.coalesce(c, F.raise_error(F.lit("files are cut into other blocks than before")).cast("long")) + F.col("mid"))
    return raw.join(starts, ["file", "block"], "left").select("value", "file", from_block("base").alias("line_no"), from_block("all").alias("place"))


def read_jsonl(spark: SparkSession, paths: str | list[str], schema: T.StructType | str, *, limit: int = 0, position: str | None = None) -> DataFrame:
    """Strict scan: blank lines are skipped, a malformed line fails the query.

    limit counts physical lines of each file, blank ones included; position names a column for the place
    of a line over all files by name (in one file, its line number).
    """
    own = _schema(schema)
    if not limit and position is None:
        rows = spark.read.text(paths)
    else:
        rows = numbered_lines(spark, paths)
        if limit:
            rows = rows.filter(F.col("line_no") <= limit)
    parsed = rows.filter(strip(F.col("value")) != "").withColumn("_row", F.from_json("value", own, {"mode": "FAILFAST"}))
    return parsed.select("_row.*", *([F.col("place").alias(position)] if position else []))


def read_jsonl_tolerant(spark: SparkSession, paths: str | list[str], schema: T.StructType | str, *, required: Iterable[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows, dead letters): malformed lines and rows with a blank required field go to the second.

    Dead letters have file, line_no, value and reason.
    """
    own = _schema(schema)
    with_bad = T.StructType([*own.fields, T.StructField(_BAD, T.StringType())])
    lines = numbered_lines(spark, paths).filter(strip(F.col("value")) != "")
    parsed = lines.withColumn("_row", F.from_json("value", with_bad, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD}))
    reason: Column = F.when(F.col("_row").isNull() | F.col(f"_row.{_BAD}").isNotNull(), F.lit("malformed"))
    for name in required:
        reason = reason.when(strip(F.col(f"_row.{name}").cast("string")) == "", F.lit(f"blank {name}"))
    judged = parsed.withColumn("reason", reason)
    good = judged.filter("reason is null").select(*[F.col(f"_row.{f.name}").alias(f.name) for f in own.fields], "line_no")
    return good, judged.filter("reason is not null").select("file", "line_no", "value", "reason")


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A file that is one JSON value."""
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    return (reader.schema(_schema(schema)) if schema is not None else reader).json(path)


def split_names(wanted: str) -> tuple[str, ...]:
    return SPLITS if wanted == "all" else (wanted,)


def read_splits(spark: SparkSession, folder: str, wanted: str = "all") -> DataFrame:
    """The Parquet relations of the splits, with a column split."""
    parts = [spark.read.parquet(f"{folder}/{s}.parquet").withColumn("split", F.lit(s)) for s in split_names(wanted)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def read_categories(spark: SparkSession, root: str, categories: Iterable[str], wanted: str = "all") -> DataFrame:
    """The splits of several categories, with a column category."""
    out = None
    for c in categories:
        part = read_splits(spark, f"{root}/{c}", wanted).withColumn("category", F.lit(c))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no category is named")
    return out


def item_map(rows: DataFrame, *, key: str = "item_id", position: str = "line_no") -> DataFrame:
    """One row per item, the last one; ids that are no whole number are dropped."""
    own = rows.withColumn(key, F.col(key).try_cast("long")).filter(F.col(key).isNotNull())
    return last_wins(own, [key], position).drop(position)


def summary_map(rows: DataFrame, *, key: str = "item_id", position: str = "line_no") -> DataFrame:
    """key, summary: description_summary, else summary; white space collapsed, blanks dropped, last wins."""
    names = [c for c in ("description_summary", "summary") if c in rows.columns]
    text = compact(first_truthy(*[F.col(c) for c in names])) if names else F.lit("")
    own = rows.select(F.col(key).try_cast("long").alias(key), text.alias("summary"), position)
    return last_wins(own.filter(F.col(key).isNotNull() & (F.col("summary") != "")), [key], position).drop(position)


def item_index(items: DataFrame, *, key: str = "item_id") -> DataFrame:
    """Items with their dense position by ascending id (from 0): places come from ranges of ids, not from one task's sort."""
    return running(items, [F.col(key)]).withColumnRenamed("before", "position")


def example_key(*names: str) -> Column:
    """The first of the columns that is neither null nor empty, as text."""
    return F.coalesce(first_truthy(*[F.col(n).cast("string") for n in names]), F.lit(""))


def reasoning_map(rows: DataFrame, *, key: str = "example_id", text: str = "reasoning", position: str = "line_no") -> DataFrame:
    """key, text of each example's last reasoning; blank keys and texts are skipped."""
    own = rows.filter(~blank(F.col(key).cast("string")) & (strip(F.col(text)) != "")).select(key, text, position)
    return last_wins(own, [key], position).drop(position)


def read_predictions(spark: SparkSession, paths: list[str], schema: T.StructType | str, *, key: str = "example_id") -> DataFrame:
    """Rows of several files in the order given, the first row of each key."""
    out = None
    for k, path in enumerate(paths):
        part = read_jsonl(spark, path, schema, position="_line").withColumn("_file", F.lit(k))
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], _schema(schema))
    return first_wins(out, [key], ["_file", "_line"]).drop("_file", "_line")


def parse_env(text: str, existing: dict[str, str] | None = None) -> dict[str, str]:
    """KEY=VALUE lines; blank lines, comments and lines without a sign of equality are skipped.

    A value is its first word as a shell reads it, and names that exist keep their value.
    """
    out = dict(existing or {})
    for line in text.splitlines():
        name, sign, value = line.strip().partition("=")
        if sign and name.strip() and not name.startswith("#"):
            out.setdefault(name.strip(), _first_word(value))
    return out


def _first_word(value: str) -> str:
    try:
        return next(iter(shlex.split(value)), "")
    except ValueError:  # an open quotation mark
        return value.strip().strip("\"'")


def manifest_of(values: dict) -> str:
    """A manifest's text: keys in the order given."""
    return json.dumps(values, ensure_ascii=False, indent=2)
