"""Ranked lexical search: the exact k best documents of each query, by dual-sorted wavelet trees.

Terms are words as in `text.ALNUM`. N documents hold a term at all, L is the number of their terms, n
a document's, tf and df as usual. A term weighs w = floor(1000 * ln((2N + 2) / (2df + 1))), its impact
in a document is (10**9 * tf) div (1000 * tf + 8 * m) with m = 25 + (75 * n * N) div L, and a score
sums w * impact over a query's terms, repeats included.

Documents are never shuffled. A first pass sums N, L and the df of the queries' terms. In the second,
each slice of texts is a shard with an index over the queries' terms: every term's postings in order
of falling impact, one list after another, and a wavelet tree over the documents' places (ascending
doc_id) in that order. A node of the tree is a range of documents; a term's postings inside it are
one run, still by falling impact, so the run's first entry is the largest impact of the term there. The
sum of these over a query's terms that have a run bounds every score below the node. Nodes are taken
best first from a heap; a child's runs come from rank counts; leaves are ranges of at most `LEAF`
documents, which are scored from their runs. A node goes unseen if its bound is below the k-th best
score that its task knows (from earlier shards too), or equal to it with larger ids only.

A task returns k rows a query at most; a window takes the best of them. Queries come in blocks of at
most `block_terms` terms, one held at a time: two passes over the documents for each block. One query
is one row.

Edge cases: null and empty texts hold no terms and are neither counted nor found; queries without terms,
or of unknown terms only, find nothing; documents with a score of 0 aren't returned; each row of the
queries is a query, each row of the documents a document, so repeated rows are found each; equal scores
go by ascending doc_id, null ids last; an empty table finds nothing; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.spark_io import dropped, id_and_text, kept
from tidewright.llm.text import ALNUM, Words, slices, words

K, BLOCK_TERMS, SHARD, LEAF, SALTS = 10, 1 << 18, 8 << 20, 64, 64
_LAST = np.iinfo(np.int64).max


class Queries(NamedTuple):
    """A block: its distinct terms (sorted), and for each query places and repeats of its terms."""

    items: list
    terms: np.ndarray
    ptr: np.ndarray
    at: np.ndarray
    times: np.ndarray


def block_of(rows: list[tuple[int | None, np.ndarray]]) -> Queries:
    found = [np.unique(w, return_counts=True) for _, w in rows]
    terms = np.unique(np.concatenate([u for u, _ in found]))
    ptr = np.append(0, np.cumsum([len(u) for u, _ in found]))
    return Queries([i for i, _ in rows], terms, ptr, np.concatenate([np.searchsorted(terms, u) for u, _ in found]), np.concatenate([n for _, n in found]).astype(np.int64))


def entries(w: Words, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and tf of all known terms of the rows, one entry each."""
    bits = np.zeros(1 << 20, bool)
    bits[(terms & np.uint64(0xFFFFF)).astype(np.int64)] = True
    maybe = np.flatnonzero(bits[(w.hash & np.uint64(0xFFFFF)).astype(np.int64)])
    at = np.minimum(np.searchsorted(terms, w.hash[maybe]), len(terms) - 1)
    good = terms[at] == w.hash[maybe]
    row = np.searchsorted(w.ptr, maybe[good], "right") - 1
    both, tf = np.unique(row * len(terms) + at[good], return_counts=True)
    return both // len(terms), both % len(terms), tf


def _measured(shared) -> callable:
    """Sums of df by term (at), of documents with a term (at -1) and of their terms (at -2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value.terms
        df, docs, size = np.zeros(len(terms), np.int64), 0, 0
        for batch in batches:
            for part in slices(batch, "text"):
                w = words(part.column("text"), ALNUM)
                docs, size = docs + int((np.diff(w.ptr) > 0).sum()), size + len(w.hash)
                df += np.bincount(entries(w, terms)[1], minlength=len(df))
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [-1, -2])), pa.array(np.append(df[at], [docs, size]))], ["at", "n"])

    return run


class Shard:
    """The index of some documents over a block's terms; documents stand in order of their ids."""

    def __init__(self, row: np.ndarray, term: np.ndarray, impact: np.ndarray, docs: int, terms: int, leaf: int):
        order = np.lexsort((row, -impact, term))
        self.begin = np.searchsorted(term[order], np.arange(terms + 1))
        row, impact = row[order], impact[order]
        bits = max(0, int(docs - 1).bit_length())
        self.depth = max(0, bits - int(leaf).bit_length() + 1)
        self.bits = bits
        # Level by level: the postings by node, their impacts, and how many before each go to the right.
        self.ones, self.impact = [], []
        for level in range(self.depth + 1):
            self.impact.append(impact)
            if level == self.depth:
                break
            right = row >> (bits - level - 1) & 1
            self.ones.append(np.append(0, np.cumsum(right)))
            move = np.argsort((row >> (bits - level - 1)).astype(np.uint16), kind="stable")
            row, impact = row[move], impact[move]
        self.row = row

    def children(self, level: int, start: int, end: int, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
        """Side, and range and runs one level down, of a node's two children."""
        ones = self.ones[level]
        base = ones[start]
        a, b = ones[lo] - base, ones[hi] - base
        mid = end - int(ones[end] - base)
        yield 0, start, mid, lo - a, hi - b
        yield 1, mid, end, mid + a, mid + b

    def leaf(self, lo: np.ndarray, hi: np.ndarray, weight: np.ndarray, first: int, size: int) -> np.ndarray:
        """The scores of a leaf's documents."""
        n = hi - lo
        at = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        scores = np.zeros(size, np.int64)
        np.add.at(scores, self.row[at] - first, np.repeat(weight, n) * self.impact[self.depth][at])
        return scores


def _beats(bound: int, first_id: int, top: list[tuple[int, int]], k: int) -> bool:
    """Whether a bound and a smallest id may enter the best so far, a heap of (score, -id)."""
    return bound > 0 and (len(top) < k or (bound, -first_id) > top[0])


def best_first(shard: Shard, ids: np.ndarray, at: np.ndarray, weight: np.ndarray, top: list[tuple[int, int]], k: int) -> int:
    """Enters a shard's documents into a query's best; returns how many nodes were opened."""
    lo, hi = shard.begin[at], shard.begin[at + 1]
    some = hi > lo
    lo, hi, weight = lo[some], hi[some], weight[some]
    if not len(lo):
        return 0
    bound = int((weight * shard.impact[0][lo]).sum())
    heap, opened = [(-bound, 0, 0, 0, int(shard.begin[-1]), lo, hi, weight)], 0
    while heap:
        bound, prefix, level, start, end, lo, hi, weight = heapq.heappop(heap)
        width = shard.bits - level
        if not _beats(-bound, int(ids[prefix << width]), top, k):
            continue
        opened += 1
        if level == shard.depth:
            first = prefix << width
            scores = shard.leaf(lo, hi, weight, first, min(1 << width, len(ids) - first))
            for d in np.flatnonzero(scores):
                found = (int(scores[d]), -int(ids[first + d]))
                if len(top) < k:
                    heapq.heappush(top, found)
                elif found > top[0]:
                    heapq.heapreplace(top, found)
            continue
        for side, s, e, l, h in shard.children(level, start, end, lo, hi):
            some = h > l
            if some.any():
                l, h, w = l[some], h[some], weight[some]
                own, below = int((w * shard.impact[level + 1][l]).sum()), prefix * 2 + side
                if _beats(own, int(ids[below << (width - 1)]), top, k):
                    # Ties can't compare arrays: no two nodes of a level have one prefix.
                    heapq.heappush(heap, (-own, below, level + 1, s, e, l, h, w))
    return opened


def impacts(n: np.ndarray, tf: np.ndarray, docs: int, size: int) -> np.ndarray:
    """Impacts of entries with tf in documents of n terms, with whole numbers of any size."""
    own, at = np.unique(n, return_inverse=True)
    m = np.array([25 + 75 * int(x) * docs // size for x in own], np.int64)[at]
    tf = tf.astype(np.int64)
    return 10**9 * tf // (1000 * tf + 8 * m)


def _found(shared, docs: int, size: int, k: int, shard_bytes: int, leaf: int) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weight = shared.value
        tops: list[list[tuple[int, int]]] = [[] for _ in queries.items]
        for batch in batches:
            for part in slices(batch, "text", shard_bytes):
                ids = part.column("doc_id").fill_null(_LAST).to_numpy()
                part = part.take(pa.array(np.argsort(ids, kind="stable")))
                ids = np.sort(ids)
                w = words(part.column("text"), ALNUM)
                row, term, tf = entries(w, queries.terms)
                if not len(row):
                    continue
                shard = Shard(row, term, impacts(np.diff(w.ptr)[row], tf, docs, size), len(ids), len(queries.terms), leaf)
                del w, part
                for q, top in enumerate(tops):
                    own = slice(queries.ptr[q], queries.ptr[q + 1])
                    best_first(shard, ids, queries.at[own], weight[own], top, k)
        rows = [(q, None if i == -_LAST else -i, s) for q, top in enumerate(tops) for s, i in top]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], ["q", "doc_id", "score"])

    return run


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            w = words(part.column("text"), ALNUM)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([w.row(r).view(np.int64) for r in range(part.num_rows)], pa.list_(pa.int64()))], ["item_id", "words"])


def _blocks(items: DataFrame, block_terms: int) -> Iterator[Queries]:
    """The queries in blocks of bounded size, fetched one after another."""
    now, n = [], 0
    for row in items.toLocalIterator():
        w = np.array(row.words, np.int64).view(np.uint64)
        if not len(w):
            continue
        if now and n + len(w) > block_terms:
            yield block_of(now)
            now, n = [], 0
        now.append((row.item_id, w))
        n += len(w)
    if now:
        yield block_of(now)


def search(docs: DataFrame, queries: DataFrame, k: int = K, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_terms: int = BLOCK_TERMS, shard_bytes: int = SHARD, leaf: int = LEAF) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each query."""
    spark = docs.sparkSession
    source = id_and_text(docs, id_col, text_col)
    items = kept(id_and_text(queries, item_col, item_text_col).mapInArrow(_items, "item_id long, words array<long>"), "items")
    by = [F.desc("score"), F.asc_nulls_last("doc_id")]
    # Tasks send k rows a query each; ranked in parts first, so a query's last ranking doesn't grow with the tasks.
    salted = F.row_number().over(Window.partitionBy("q", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).orderBy(*by))
    place = F.row_number().over(Window.partitionBy("q").orderBy(*by))
    results = []
    for block in _blocks(items, block_terms):
        shared = spark.sparkContext.broadcast(block)
        sums = source.select("text").mapInArrow(_measured(shared), "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
        df, whole = np.zeros(len(block.terms), np.int64), {-1: 0, -2: 0}
        for r in sums.toLocalIterator():  # at most one row a term of the block
            if r.at < 0:
                whole[r.at] = r.n
            else:
                df[r.at] = r.n
        shared.destroy()
        if not whole[-1]:
            break
        w = np.floor(1000 * np.log((2 * whole[-1] + 2) / (2 * df + 1))).astype(np.int64)
        shared = spark.sparkContext.broadcast((block, w[block.at] * block.times))
        best = source.mapInArrow(_found(shared, whole[-1], whole[-2], k, shard_bytes, leaf), "q int, doc_id long, score long")
        best = best.withColumn("rank", salted).filter(F.col("rank") <= k).withColumn("rank", place).filter(F.col("rank") <= k)
        names = spark.createDataFrame([(q, i) for q, i in enumerate(block.items)], "q int, item_id long")
        results.append(kept(best.join(names, "q").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "ranked"))
        shared.destroy()
    dropped(items)
    if not results:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out
