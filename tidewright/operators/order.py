"""Places, ranks with ties and exact quantiles without sorting anything in one task.

Rows are dealt by ranges of the whole order (value, then key), so a value that half of the rows share is
spread over many tasks; sums of the ranges, one row each, are carried over to the next ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tidewright.sources.tables import written

#: Bits of a double that one round of histograms settles.
ROUND_BITS = 16


def running(rows: DataFrame, by: list[Column], weight: Column | None = None) -> DataFrame:
    """Adds before: the weights (1 each without) of all earlier rows in the order of `by`, which should tell rows apart.

    The ranges are written once, as a second evaluation could draw other ones.
    """
    own = rows.withColumns({"_by": F.struct(*[c.alias(f"k{i}") for i, c in enumerate(by)]), "_w": weight if weight is not None else F.lit(1).cast("long")})
    ranged = written(own.repartitionByRange("_by").withColumn("_part", F.spark_partition_id()), "ranges")
    inside = F.sum("_w").over(Window.partitionBy("_part").orderBy("_by").rowsBetween(Window.unboundedPreceding, -1))
    sums = ranged.groupBy("_part").agg(F.sum("_w").alias("_n"))
    earlier = sums.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_earlier"))  # one row a range
    out = ranged.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(earlier, "_part")
    return out.withColumn("before", F.col("_earlier") + F.col("_inside")).drop("_by", "_w", "_part", "_inside", "_earlier")


def _inside(group: str) -> callable:
    """Adds _part, the task, and _inside, the place (from 1) of each row among those of its group that the task has; rows come in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            runs = pc.run_end_encode(batch.column(group))
            size = np.diff(np.append(0, runs.run_ends.to_numpy()))
            before = np.zeros(len(size), np.int64)
            before[0] = seen if [runs.values[0].as_py()] == last else 0
            last, seen = [runs.values[-1].as_py()], int(before[-1] + size[-1])
            place = np.arange(batch.num_rows) - np.repeat(np.append(0, np.cumsum(size)[:-1]) - before, size) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(place, pa.int64())], [*batch.schema.names, "_part", "_inside"])

    return run


def places_within(rows: DataFrame, group: str, by: list[Column], name: str, drop: list[str] | None = None) -> DataFrame:
    """Adds name: the place (from 1) of each row among those of its group (null is one) in the order of `by`, which should tell a group's rows apart.

    Rows are dealt once, by ranges, and counted in their range's order as they are written. A large group
    lies in many ranges. Only the first group of a range can have begun before it, so at most one row for
    each range is carried over and broadcast. drop: columns that only the order needs.
    """
    dealt = rows.withColumn("_by", F.struct(F.col(group).alias("g"), *[c.alias(f"k{i}") for i, c in enumerate(by)])).drop(*(drop or []))
    ordered = dealt.repartitionByRange("_by").sortWithinPartitions("_by").drop("_by")
    ranged = written(ordered.mapInArrow(_inside(group), StructType([*ordered.schema.fields, StructField("_part", IntegerType()), StructField("_inside", LongType())])), "ranges")
    counts = ranged.groupBy(F.col(group).alias("_group"), F.col("_part").alias("_at")).agg(F.count("*").alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy("_group").orderBy("_at")) - F.col("_n")
    carried = counts.withColumn("_earlier", earlier).filter("_earlier > 0").drop("_n")
    out = ranged.join(F.broadcast(carried), F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_at")), "left")
    return out.withColumn(name, F.coalesce("_earlier", F.lit(0).cast("long")) + F.col("_inside")).drop("_part", "_group", "_at", "_earlier", "_inside")


def average_ranks(rows: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """group, value and its average rank (from 1, ties share the mean of their ranks) for all distinct values of each group."""
    n = rows.groupBy(group, value).agg(F.count("*").alias("n"))
    sizes = rows.groupBy(group).agg(F.count("*").alias("_size"))
    starts = sizes.select(group, (F.sum("_size").over(Window.orderBy(group)) - F.col("_size")).alias("_start"))  # one row a group
    placed = running(n, [F.col(group), F.col(value)], F.col("n")).join(starts, group)
    return placed.select(group, value, (F.col("before") - F.col("_start") + 1 + (F.col("n") - 1) / 2.0).alias(name))


def parts(rows: DataFrame, value: str, key: str, n: int, name: str) -> DataFrame:
    """Adds name (1 to n): n parts of the rows by value, ties by key, the first ones larger by one where they don't divide."""
    total = rows.agg(F.count("*").alias("_all"))
    placed = running(rows, [F.col(value), F.col(key)]).join(F.broadcast(total))
    small, extra = F.floor(F.col("_all") / n), F.col("_all") % n
    cut = extra * (small + 1)
    part = F.when(F.col("before") < cut, F.floor(F.col("before") / (small + 1))).otherwise(extra + F.floor((F.col("before") - cut) / F.greatest(small, F.lit(1))))
    return placed.withColumn(name, (part + 1).cast("int")).drop("before", "_all")


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Doubles (none undefined) as unsigned numbers of the same order; both zeros are one."""
    bits = (x + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63) == 1, ~bits, bits | np.uint64(1 << 63))


def from_bits(bits: int) -> float:
    own = np.uint64(bits)
    return float((own ^ np.uint64(1 << 63) if bits >> 63 else ~own).view(np.float64))


def _histogram(prefixes: list[int], settled: int) -> callable:
    """Counts of the next bits among the values that begin with one of the prefixes: (prefix, digit, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.array(sorted(prefixes), np.uint64)
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            bits = ordered_bits(batch.column(0).to_numpy())
            head = bits >> np.uint64(64 - settled) if settled else np.zeros(len(bits), np.uint64)
            digit = (bits >> np.uint64(64 - settled - ROUND_BITS)) & np.uint64((1 << ROUND_BITS) - 1)
            for p in known.tolist():
                sums[p] = sums.get(p, 0) + np.bincount(digit[head == np.uint64(p)].astype(np.int64), minlength=1 << ROUND_BITS)
        for p, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), p).astype(np.uint64).view(np.int64)), pa.array(at), pa.array(n[at])], ["prefix", "digit", "n"])

    return run


def at_ranks(values: DataFrame, ranks: list[int]) -> dict[int, float]:
    """The values (one column of doubles, none null or undefined) at places from 0 of the ascending order.

    Four rounds settle 16 bits each of all wanted places at once. A round sends at most 65,536 counts for
    each place, whatever the number of rows.
    """
    todo = {r: (0, r) for r in ranks}  # place: settled bits, and its place among the values that have them
    for settled in range(0, 64, ROUND_BITS):
        counts: dict[int, list[tuple[int, int]]] = {}
        found = values.mapInArrow(_histogram(list({p for p, _ in todo.values()}), settled), "prefix long, digit long, n long")
        for r in found.groupBy("prefix", "digit").agg(F.sum("n").alias("n")).toLocalIterator():
            counts.setdefault(r.prefix & (1 << 64) - 1, []).append((r.digit, r.n))
        for place, (prefix, rest) in todo.items():
            for digit, n in sorted(counts[prefix]):
                if rest < n:
                    todo[place] = (prefix << ROUND_BITS | digit, rest)
                    break
                rest -= n
    return {place: from_bits(bits) for place, (bits, _) in todo.items()}


def quantiles(rows: DataFrame, value: Column, shares: list[float]) -> list[float | None]:
    """Exact quantiles, interpolated between neighbours; None without values. Nulls and undefined numbers are left out."""
    values = written(rows.select(value.cast("double").alias("x")).filter("x is not null and not isnan(x)"), "values")
    n = values.count()
    if not n:
        return [None] * len(shares)
    spots = [(n - 1) * s for s in shares]
    found = at_ranks(values, sorted({int(np.floor(p)) for p in spots} | {int(np.ceil(p)) for p in spots}))
    out = []
    for p in spots:
        lo, hi = int(np.floor(p)), int(np.ceil(p))
        out.append(found[lo] if lo == hi else (hi - p) * found[lo] + (p - lo) * found[hi])
    return out


def upper_median(rows: DataFrame, value: Column) -> float | None:
    """The value at half of the count in ascending order, None without values."""
    values = written(rows.select(value.cast("double").alias("x")).filter("x is not null and not isnan(x)"), "values")
    n = values.count()
    return at_ranks(values, [n // 2])[n // 2] if n else None
