"""Sharding by histogram sort under the law `bytes`: shard sizes as near equal as whole rows allow.

Rows are ordered by (text_crc32, doc_id), so equal texts stand together and a group of copies too
large for a shard is cut by doc_id. Splitters are found without sorting: each round counts, across
all partitions, the exact bytes and rows below a fixed number of candidate keys, keeps for each
splitter the two probes around its target and puts new probes between them, until every splitter
is exact: the first key at which the bytes below reach the target, so that the error is less than
the bytes of one key. Cells between neighbouring probes that hold more than `cell_rows` rows (or a
sixteenth of a shard's, if that is less) are probed on in the same way, until each holds fewer or is
a single key. Then the rows are exchanged once, by these cells, so a shard needs no single task.
A row's slot is the number of rows in earlier cells of its shard plus its place in its cell.

Only per-partition histograms (a fixed number of probes) are shuffled before the exchange, and rows
are narrow from the first step on; texts never move.

Edge cases: null text has size 8, crc 0; empty shards may arise when there are fewer keys than
shards; rows that repeat both id and text are one key and stay in one cell and shard; a null doc_id sorts
before all others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.spark_io import id_and_text, kept

SHARDS, PROBES, CELL_ROWS = 24, 96, 1 << 20
_HALF = 1 << 63


def sizes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes and 8) and text_crc32 of every row, and ord: doc_id, null first."""
    t = F.coalesce("text", F.lit(""))
    return id_and_text(docs, id_col, text_col).select(
        "doc_id", (F.octet_length(t) + 8).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), F.coalesce("doc_id", F.lit(-_HALF)).alias("ord")
    )


def _below(probes: np.ndarray) -> callable:
    """Rows and bytes of the partition in each gap between probes (keys as two unsigned halves)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, b = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
        for batch in batches:
            at = cells(batch.column("text_crc32"), batch.column("ord"), probes)
            n += np.bincount(at, minlength=len(n))
            b += np.bincount(at, batch.column("size").to_numpy(), minlength=len(b)).astype(np.int64)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at]), pa.array(b[at])], ["cell", "n", "b"])

    return run


def _number(crc: np.ndarray, ids: np.ndarray, probes: np.ndarray) -> np.ndarray:
    """How many probes are at or below each key; probes: rows (crc, shifted id), ascending."""
    high, low = probes[:, 0], probes[:, 1]
    own = ids.view(np.uint64) ^ np.uint64(_HALF)
    lo, hi = np.searchsorted(high, crc, "left"), np.searchsorted(high, crc, "right")
    tied = np.flatnonzero(hi > lo)
    at = lo.copy()
    for c in np.unique(crc[tied]):
        rows = tied[crc[tied] == c]
        a, b = lo[rows[0]], hi[rows[0]]
        at[rows] = a + np.searchsorted(low[a:b], own[rows], "right")
    return at


def cells(crc: pa.Array, ids: pa.Array, probes: np.ndarray) -> np.ndarray:
    return _number(crc.to_numpy(zero_copy_only=False).astype(np.uint64), ids.to_numpy(zero_copy_only=False).astype(np.int64), probes)


def _as_probes(keys: list[int]) -> np.ndarray:
    return np.array([(k >> 64, k & (1 << 64) - 1) for k in keys], np.uint64).reshape(-1, 2)


def _counted(rows: DataFrame, keys: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Exact rows and bytes in each gap between the keys."""
    n, b = np.zeros(len(keys) + 1, np.int64), np.zeros(len(keys) + 1, np.int64)
    for r in rows.mapInArrow(_below(_as_probes(keys)), "cell long, n long, b long").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("b").alias("b")).collect():
        n[r.cell], b[r.cell] = r.n, r.b
    return n, b


def splitters(rows: DataFrame, shards: int, probes: int, cell_rows: int = CELL_ROWS) -> tuple[list[int], list[int], np.ndarray]:
    """Keys (crc << 64 | shifted id) at which shards 1, 2, ... begin, all keys that were probed, and the rows between them.

    Shard s begins at the first key with at least s / shards of all bytes below the next key's start.
    """
    low, high, total = rows.agg(F.min("ord"), F.max("ord"), F.sum("size")).first()
    if total is None:
        return [], [], np.zeros(1, np.int64)
    low, span = low + _HALF, high - low + 1
    # Keys are numbered densely: crc * span + (id - smallest id), so that rounds halve no empty room.
    dense = lambda x: (x // span) << 64 | (low + x % span)
    top = span << 32
    bracket = [(0, top)] * (shards - 1)  # bytes below the first are under the target, below the second not
    tried: set[int] = set()
    while any(b - a > 1 for a, b in bracket):
        new = sorted({a + (b - a) * i // (probes + 1) for a, b in set(bracket) for i in range(1, probes + 1)} | {x for b in bracket for x in b if 0 < x < top})
        new = [x for x in new if 0 < x < top]
        tried |= set(new)
        below = np.cumsum(_counted(rows, [dense(x) for x in new])[1])[:-1]
        for s in range(1, shards):
            a, b = bracket[s - 1]
            i = int(np.searchsorted(below * shards, s * total))
            a = max(a, new[i - 1]) if i else a
            b = min(b, new[i]) if i < len(new) else b
            if i < len(new) and below[i] * shards == s * total:
                a = b - 1
            bracket[s - 1] = (a, b)
    # a is the last key with fewer bytes below it than the target, b the first with as many: take the nearer.
    ends = sorted({x for p in bracket for x in p if 0 < x < top})
    below = dict(zip(ends, np.cumsum(_counted(rows, [dense(x) for x in ends])[1])[:-1].tolist(), strict=True))
    cut = []
    for s, p in enumerate(bracket, 1):
        near = min(p, key=lambda x: abs(below.get(x, 0 if x == 0 else total) * shards - s * total))
        cut.append(max(near, cut[-1] if cut else 0))
    # Cells that are still large: more probes inside, as many as a cell of evenly spread keys needs.
    while True:
        own = sorted(tried | set(cut))
        n, _ = _counted(rows, [dense(x) for x in own])
        edges = [0, *own, top]
        most = max(1, min(cell_rows, int(n.sum()) // (16 * shards)))
        more = {a + (b - a) * i // k for a, b, k in ((edges[j], edges[j + 1], min(probes, 2 + 2 * int(n[j]) // most)) for j in np.flatnonzero(n > most).tolist()) for i in range(1, k) if b - a > 1}
        more -= {0, *own}
        if not more:
            return [dense(x) for x in cut], [dense(x) for x in own], n
        tried |= more


def _assign(probes: np.ndarray) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = cells(batch.column("text_crc32"), batch.column("ord"), probes)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32))], [*batch.schema.names, "cell"])

    return run


def shard(docs: DataFrame, *, shards: int = SHARDS, probes: int = PROBES, cell_rows: int = CELL_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row."""
    spark = docs.sparkSession
    rows = kept(sizes(docs, id_col=id_col, text_col=text_col), "sizes")
    cut, tried, n = splitters(rows, shards, probes, cell_rows)
    owner = np.searchsorted(np.array(cut, object), np.array([0, *tried], object), "right") if cut else np.zeros(1, np.int64)
    first = np.cumsum(n) - n
    begin = {int(s): int(first[np.flatnonzero(owner == s)[0]]) for s in np.unique(owner)}
    known = spark.createDataFrame([(k, int(owner[k]), int(first[k]) - begin[int(owner[k])]) for k in range(len(n)) if n[k]] or [(0, 0, 0)], "cell int, shard int, base long")
    placed = rows.mapInArrow(_assign(_as_probes(tried)), "doc_id long, size long, text_crc32 long, ord long, cell int")
    order = Window.partitionBy("cell").orderBy("text_crc32", "ord", "size")
    return (
        placed.withColumn("place", F.row_number().over(order) - 1)
        .join(F.broadcast(known), "cell")
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("place")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
