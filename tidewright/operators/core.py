"""DataFrame operators: first and last wins, ordered histories, sharding, merging, exclusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def last_wins(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """The row of each key with the largest position, by one aggregation that combines map-side."""
    rest = [c for c in df.columns if c not in keys]
    own = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(position)).alias("_r"))
    return own.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def histories(events: DataFrame, key: str, position: str, values: list[str], last: int) -> DataFrame:
    """Per key: the last row as target_*, the `last` rows before it as arrays history_*, in order.

    Only the last rows of each key are brought together (tasks send at most so many of a key), so a
    long log is no single task's group. position is anything that orders a key's rows, such as a struct.
    """
    rows = F.array_sort(F.collect_list(F.struct(position, *values)))
    grouped = last_rows(events, key, position, last + 1).groupBy(key).agg(rows.alias("_rows"))
    past = F.slice("_rows", 1, F.size("_rows") - 1)

    def field(name: str):
        return lambda r: r[name]

    return grouped.select(key, *[F.col("_rows")[F.size("_rows") - 1][v].alias(f"target_{v}") for v in values], *[F.transform(past, field(v)).alias(f"history_{v}") for v in values])


def last_rows(events: DataFrame, key: str, position: str, last: int) -> DataFrame:
    """The last rows of each key by position; map-side, a key sends at most so many rows from each task."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(position)))
    return events.withColumn("_n", place).filter(F.col("_n") <= last).drop("_n")


def tail(a: Column, n: int) -> Column:
    return F.slice(a, F.greatest(F.size(a) - n, F.lit(0)) + 1, n)


def hash_shard(key: Column, n: int) -> Column:
    """First eight bytes of the key's md5, as a number, modulo n; null for blank keys."""
    whole = F.conv(F.substring(F.md5(key.cast("binary")), 1, 16), 16, 10).cast("decimal(20,0)")
    return F.when(key.isNotNull() & (key != ""), (whole % n).cast("int"))


def position_shard(position: Column, n: int) -> Column:
    """Shard of a row by its place from 1, round and round."""
    return F.pmod(position - 1, F.lit(n)).cast("int")


def in_shard(key: Column, n: int, shard: int) -> Column:
    """Whether a key belongs to a hash shard; with one shard all do, blank keys too."""
    return F.lit(True) if n <= 1 else F.coalesce(hash_shard(key, n) == shard, F.lit(False))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: keys, and rows beyond the first of each."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.count("*").alias("keys"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def merged(candidates: DataFrame, scores: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Candidates with their last score; candidates without one are dropped."""
    return candidates.join(last_wins(scores, keys, position).drop(position), keys)


def without(rows: DataFrame, *excluded: tuple[DataFrame, list[str]]) -> DataFrame:
    """Rows whose keys are in none of the given relations; one equi anti join for each."""
    for other, keys in excluded:
        rows = rows.join(other.select(*keys).distinct(), keys, "left_anti")
    return rows
