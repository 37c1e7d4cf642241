"""Bitmaps of hashed keys: they leave most rows out that can't find a partner in a join that follows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewright.llm.text import mix

#: Bits for each key, and the most bits that a bitmap has (16 MB), so what is broadcast is bounded.
BITS, MOST_BITS = 16, 1 << 27


def places(keys: pa.Array, size: int) -> np.ndarray:
    return (mix(keys.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) % np.uint64(size)).astype(np.int64)


def _marked(size: int) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, bool)
        for batch in batches:
            bits[places(batch.column(0), size)] = True
        packed = np.packbits(bits)
        at = np.flatnonzero(packed)
        yield pa.RecordBatch.from_arrays([pa.array([at.astype(np.int32).tobytes()], pa.binary()), pa.array([packed[at].tobytes()], pa.binary())], ["at", "bits"])

    return run


def bitmap(keys: DataFrame, column: str, n: int) -> bytes:
    """The bitmap of about n whole-number keys, united from those of the partitions one after another."""
    size = min(MOST_BITS, max(1 << 16, 1 << (BITS * n).bit_length()))
    packed = np.zeros(size // 8, np.uint8)
    for r in keys.select(column).coalesce(64).mapInArrow(_marked(size), "at binary, bits binary").toLocalIterator():
        packed[np.frombuffer(r.at, np.int32)] |= np.frombuffer(r.bits, np.uint8)
    return packed.tobytes()


def among(packed: bytes, keys: pa.Array) -> pa.Array:
    """Which keys may be in the bitmap; all that are."""
    bits = np.frombuffer(packed, np.uint8)
    at = places(keys, 8 * len(bits))
    return pa.array((bits[at >> 3] >> (7 - (at & 7)) & 1).astype(bool))


def possible(rows: DataFrame, column: str, keys: DataFrame, n: int) -> DataFrame:
    """The rows whose column may stand in keys: all that do, and few others."""
    shared = rows.sparkSession.sparkContext.broadcast(bitmap(keys, column, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(among(shared.value, batch.column(column)))

    return rows.mapInArrow(run, rows.schema)
