"""Queries against packed shards of items: every query row meets every shard once, pairs are never rows.

A shard is one packed row. Shards are repeated for a few salts and sorted before the queries of the same
(shard, salt), so a task holds one shard at a time and streams the queries that meet it; nothing is
broadcast or fetched by the driver, and a lost task is run again like any other.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Scores worked out at once.
CELLS = 1 << 21


def pack(arrays: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpack(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data), allow_pickle=False) as z:
        return {k: z[k] for k in z.files}


def salts(rows: DataFrame, n: int) -> int:
    """How many salts n shards are repeated for."""
    return max(1, -(-2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // n))


def dealt(rows: DataFrame, shards: DataFrame, n: int, columns: list[str], to: str | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """Query rows (key and other columns) and the n shards (s, shard) side by side, by shard and salt.

    to: an array column of the shards that a row meets; all without. With more (other columns of the
    shards), both sides have their salts in a column, and shards a row for each of them.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = salts(rows, n)
    salt = F.col("salt") if more else F.pmod(F.xxhash64("key"), F.lit(own)).cast("int").alias("salt")
    blank = lambda df, names: [F.lit(None).cast(df.schema[c].dataType).alias(c) for c in names]
    asked = rows.select(F.explode(to or F.sequence(F.lit(0), F.lit(n - 1))).alias("s"), salt, F.lit(1).alias("kind"), *blank(shards, ["shard", *more]), *columns)
    every = salt if more else F.explode(F.sequence(F.lit(0), F.lit(own - 1))).alias("salt")
    repeated = shards.select("s", every, F.lit(0).alias("kind"), "shard", *more, *blank(rows, columns))
    return repeated.unionByName(asked).repartition(max(tasks, min(own * n, 1 << 16)), "s", "salt").sortWithinPartitions("s", "salt", "kind")


def met(batches: Iterator[pa.RecordBatch], load: Callable, entries: Callable, size: Callable | None = None, most: int = 0, more: tuple[str, ...] = ()) -> Iterator[tuple[object, pa.RecordBatch]]:
    """Each shard with the query rows that follow it, in parts of at most CELLS scores.

    load unpacks a shard (and takes its values of the columns `more`), entries counts its items. With size (the sizes of a batch's rows), a part's
    sizes also sum to `most` at most (one row at least).
    """
    shard, at = None, None
    for batch in batches:
        kind, s, salt = (batch.column(c).to_numpy() for c in ("kind", "s", "salt"))
        upto = np.append(0, np.cumsum(size(batch))) if size else None
        cut = np.flatnonzero(np.append(True, (kind[1:] == 0) | (kind[:-1] == 0) | (s[1:] != s[:-1]) | (salt[1:] != salt[:-1])))
        for lo, hi in zip(cut.tolist(), np.append(cut[1:], batch.num_rows).tolist(), strict=True):
            if kind[lo] == 0:
                shard, at = load(batch.column("shard")[lo].as_py(), *(batch.column(c)[lo] for c in more)), (s[lo], salt[lo])
            elif at == (s[lo], salt[lo]):
                step = max(1, CELLS // max(1, entries(shard)))
                while lo < hi:
                    to = min(hi, lo + step)
                    if upto is not None:
                        to = max(lo + 1, min(to, int(np.searchsorted(upto, upto[lo] + most, "right")) - 1))
                    yield shard, batch.slice(lo, to - lo)
                    lo = to
