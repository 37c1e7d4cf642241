"""Benchmark decontamination: prefix-filtered set join over word shingles.

Windows of the benchmark items are runs of `window` words (an item with fewer words is one
window). A window is contained in a document only if its rarest shingle is, so:

1. count, over all documents, the shingles that occur in windows (map-side sums, then one small
   shuffle), and order each window's shingles by (count, hash);
2. look up only each window's rarest shingle (its prefix, of length one for full containment) in
   the documents; the shingle's place in the window gives the only start the window can have there,
   and that start must leave the window inside the document (positional and length bounds);
3. compare the 64-bit hashes of all words of the window at that start.

The documents are never shuffled and results are made row by row, so hot passages, copies and
repeated rows need no special case. The benchmark is taken in blocks of at most `block_windows`
windows. Each block's hits are written before the next block is broadcast (the last one's are left
lazy), so one block is held at a time and its size has a bound whatever the table's size. Each block
costs two more passes over the documents. Counts of a block's shingles, which are as bounded as the
block, come to the driver as packed arrays, one row for each partition of sums.

Edge cases: null or empty text has no words, no hits and is not contaminated; items without words
have no window; an item without an id marks words as hit but is neither counted nor listed; an empty
benchmark hits nothing; equal items all count; repeated document rows and those without an id each
get a row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.llm.spark_io import dropped, id_and_text, kept, quoted
from tidewright.llm.text import ALNUM, Words, fold, slices, words

WINDOW, SHINGLE, BLOCK_WINDOWS = 13, 3, 200_000
_HITS = "n_words long, starts array<int>, stops array<int>, items array<long>"


class Block:
    """Distinct windows of some items, the shingles they hold and, once counted, their prefixes."""

    def __init__(self, items: list[tuple[int | None, np.ndarray]], window: int, shingle: int):
        seen: dict[bytes, int] = {}
        rows, owners = [], []
        for item, w in items:
            size = min(window, len(w))
            for i in range(len(w) - size + 1):
                own = w[i : i + size]
                k = seen.setdefault(own.tobytes(), len(rows))
                if k == len(rows):
                    rows.append(own)
                    owners.append(set())
                if item is not None:
                    owners[k].add(item)
        self.rows, self.window = rows, window
        self.owner_ptr = np.cumsum([0, *map(len, owners)])
        self.owners = np.array([x for o in owners for x in sorted(o)], np.int64)  # windows of items without id have none
        self.sizes = np.array([len(r) for r in rows], np.int64)
        self.matrix = np.zeros((len(rows), window), np.uint64)
        for k, r in enumerate(rows):
            self.matrix[k, : len(r)] = r
        self.orders = sorted({min(shingle, n) for n in self.sizes.tolist()})
        self.shingle = shingle
        self.grams = {}
        for s in self.orders:
            own = [self._of(k, s) for k in range(len(rows)) if min(shingle, len(rows[k])) == s]
            self.grams[s] = np.unique(np.concatenate(own))

    def _of(self, k: int, s: int) -> np.ndarray:
        r = self.rows[k]
        return fold([r[i : len(r) - s + 1 + i] for i in range(s)])

    def set_prefixes(self, counts: dict[int, np.ndarray]) -> None:
        """counts: by order, the number of occurrences of each of grams[order]."""
        found: dict[int, list] = {s: [] for s in self.orders}
        for k in range(len(self.rows)):
            s = min(self.shingle, len(self.rows[k]))
            g = self._of(k, s)
            at = np.lexsort((g, counts[s][np.searchsorted(self.grams[s], g)]))[0]
            found[s].append((int(g[at]), k, int(at)))
        self.prefix = {}
        for s, own in found.items():
            own.sort()
            g = np.array([x[0] for x in own], np.uint64)
            u, first = np.unique(g, return_index=True)
            self.prefix[s] = (u, np.append(first, len(g)), np.array([x[1] for x in own], np.int64), np.array([x[2] for x in own], np.int64))
        del self.rows, self.grams


def _among(h: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of h are in the sorted array known, and where there; a bitmap sorts out most."""
    bits = np.zeros(1 << 20, bool)
    bits[(known & np.uint64(0xFFFFF)).astype(np.int64)] = True
    maybe = np.flatnonzero(bits[(h & np.uint64(0xFFFFF)).astype(np.int64)])
    at = np.minimum(np.searchsorted(known, h[maybe]), len(known) - 1)
    good = known[at] == h[maybe]
    return maybe[good], at[good]


def _count(block) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = block.value
        sums = {s: np.zeros(len(b.grams[s]), np.int64) for s in b.orders}
        for batch in batches:
            for part in slices(batch, "text"):
                w = words(part.column("text"), ALNUM)
                for s in b.orders:
                    _, at = _among(w.grams(s)[1], b.grams[s])
                    sums[s] += np.bincount(at, minlength=len(sums[s]))
        for s in b.orders:
            at = np.flatnonzero(sums[s])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), s, np.int32)), pa.array(at), pa.array(sums[s][at])], ["size", "at", "n"])

    return run


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of a batch as one, with packed columns."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([batch.column(c).to_numpy().astype(np.int64).tobytes()], pa.binary()) for c in ("size", "at", "n")], ["size", "at", "n"])


def _verified(w: Words, b: Block) -> tuple[np.ndarray, np.ndarray]:
    """Start (a place among all words) and window of every occurrence."""
    rows = np.repeat(np.arange(len(w.ptr) - 1), np.diff(w.ptr))
    starts, found = [], []
    for s in b.orders:
        place, h = w.grams(s)
        known, ptr, window, offset = b.prefix[s]
        hit, at = _among(h, known)
        reps = ptr[at + 1] - ptr[at]
        each = np.repeat(ptr[at], reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        spot = np.repeat(place[hit], reps)
        k = window[each]
        start = spot - offset[each]
        row = rows[spot]
        fits = (start >= w.ptr[row]) & (start + b.sizes[k] <= w.ptr[row + 1])
        start, k = start[fits], k[fits]
        if len(start):
            span = np.arange(b.window)
            own = w.hash[np.minimum(start[:, None] + span, len(w.hash) - 1)]
            same = ((own == b.matrix[k]) | (span >= b.sizes[k][:, None])).all(1)
            starts.append(start[same])
            found.append(k[same])
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(starts), np.concatenate(found)


def _merge(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans united where they touch or overlap."""
    if not len(starts):
        return starts, stops
    order = np.argsort(starts, kind="stable")
    starts, stops = starts[order], np.maximum.accumulate(stops[order])
    new = np.append(True, starts[1:] > stops[:-1])
    return starts[new], stops[np.append(np.flatnonzero(new)[1:] - 1, len(stops) - 1)]


def _find(block) -> callable:
    """Adds one block's spans and items to what the blocks before it have found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = block.value
        for batch in batches:
            for part in slices(batch, "text"):
                w = words(part.column("text"), ALNUM)
                start, k = _verified(w, b)
                row = np.searchsorted(w.ptr, start, "right") - 1
                order = np.argsort(row, kind="stable")
                start, k, row = start[order] - w.ptr[row[order]], k[order], row[order]
                bounds = np.searchsorted(row, np.arange(part.num_rows + 1))
                before = [part.column(c).to_pylist() for c in ("starts", "stops", "items")] if "starts" in part.schema.names else None
                out = [[], [], []]
                for r in range(part.num_rows):
                    lo, hi = bounds[r], bounds[r + 1]
                    old = [before[i][r] or [] for i in range(3)] if before else [[], [], []]
                    if lo == hi:
                        new = old
                    else:
                        u = np.unique(k[lo:hi])
                        own = np.concatenate([b.owners[b.owner_ptr[x] : b.owner_ptr[x + 1]] for x in u])
                        s, e = _merge(np.append(np.array(old[0], np.int64), start[lo:hi]), np.append(np.array(old[1], np.int64), start[lo:hi] + b.sizes[k[lo:hi]]))
                        new = [s.tolist(), e.tolist(), np.union1d(np.array(old[2], np.int64), own).tolist()]
                    for o, x in zip(out, new, strict=True):
                        o.append(x)
                kept = [c for c in part.schema.names if c not in ("n_words", "starts", "stops", "items")]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in kept), pa.array(np.diff(w.ptr)), pa.array(out[0], pa.list_(pa.int32())), pa.array(out[1], pa.list_(pa.int32())), pa.array(out[2], pa.list_(pa.int64()))],
                    [*kept, "n_words", "starts", "stops", "items"],
                )

    return run


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            w = words(part.column("text"), ALNUM)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([w.row(r).view(np.int64) for r in range(part.num_rows)], pa.list_(pa.int64()))], ["item_id", "words"])


def _blocks(items: DataFrame, window: int, block_windows: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    """The items in blocks of bounded size, fetched one after another."""
    now, n = [], 0
    for row in items.toLocalIterator():
        w = np.array(row.words, np.int64).view(np.uint64)
        if not len(w):
            continue
        for at in range(0, max(1, len(w) - window + 1), block_windows):  # a long item may fill many blocks
            own = w[at : at + block_windows + window - 1]
            grown = max(1, len(own) - window + 1)
            if now and n + grown > block_windows:
                yield now
                now, n = [], 0
            now.append((row.item_id, own))
            n += grown
    if now:
        yield now


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, shingle: int = SHINGLE, block_windows: int = BLOCK_WINDOWS, keep_row: bool = False) -> DataFrame:
    """One row per document row: doc_id, n_words, starts and stops of merged hit spans (in words), items.

    Spans that touch are merged. With keep_row each row also has its text and, as a struct named
    row, its other columns.
    """
    spark = docs.sparkSession
    source = id_and_text(docs, id_col, text_col)
    if keep_row:
        source = docs.select(F.struct(*[F.col(quoted(c)).alias(c) for c in docs.columns if c != text_col]).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    hits = T.StructType(source.schema.fields + T.StructType.fromDDL(_HITS).fields)
    items = kept(id_and_text(benchmark, item_col, item_text_col).mapInArrow(_items, "item_id long, words array<long>"), "items")
    found, shared, before = source, None, None
    for own in _blocks(items, window, block_windows):
        if shared is not None:  # the block before this one is done with
            now = kept(found, "found")
            shared.destroy()
            if before is not None:
                dropped(before)
            found = before = now
        block = Block(own, window, shingle)
        counted = spark.sparkContext.broadcast(block)
        counts = source.select("doc_id", "text").mapInArrow(_count(counted), "size int, at long, n long").groupBy("size", "at").agg(F.sum("n").alias("n"))
        by = {s: np.zeros(len(block.grams[s]), np.int64) for s in block.orders}
        for r in counts.mapInArrow(_sums, "size binary, at binary, n binary").toLocalIterator():
            size, at, n = (np.frombuffer(r[c], np.int64) for c in ("size", "at", "n"))
            for s in block.orders:
                by[s][at[size == s]] = n[size == s]
        counted.destroy()
        block.set_prefixes(by)
        shared = spark.sparkContext.broadcast(block)
        found = found.mapInArrow(_find(shared), hits)
    if found is source:
        nothing = Block([], window, shingle)
        nothing.prefix = {}
        found = found.mapInArrow(_find(spark.sparkContext.broadcast(nothing)), hits)
    return found if keep_row else found.drop("text")


def digest(found: DataFrame) -> DataFrame:
    """n_hit, n_items, items_sha256 and contaminated from the spans and items."""
    n_hit = F.expr("cast(aggregate(zip_with(stops, starts, (b, a) -> b - a), 0, (x, y) -> x + y) as long)")
    return (
        found.withColumn("n_hit", n_hit)
        .withColumn("n_items", F.size("items").cast("long"))
        .withColumn("items_sha256", F.sha2(F.expr("array_join(array_sort(transform(items, x -> cast(x as string))), ',')"), 256))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    )


def clean(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns, without a shuffle of texts."""
    found = digest(contamination(docs, benchmark, id_col=id_col, text_col=text_col, keep_row=True, **how)).filter("not contaminated")
    return found.select(*[F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
