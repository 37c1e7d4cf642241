"""Interpolated modified Kneser-Ney model of words, sharded by middle word, for documents of any number.

A document is its words (ASCII case folded) between edges and an end mark; n-grams have three words.
Trusted texts' triples are counted by piece of text and dealt by the hash of their middle word. All that
the probability of a triple needs has the same middle word: the counts of its first two words, and of its
last two, which are counts of distinct triples. Only single words are counted elsewhere (in the shard
of their own hash) and handed back, one number for each word of a shard. Nothing of the model is
collected or broadcast but its discounts and totals, so it grows with the text.

The log-probability of a word is that of the word alone, from its own shard, and what the two words
before it add to that, from the shard of the middle one. Documents send their places there, packed with
the words and the row of each, and get sums by row back. Models and places are sorted lists of numbers
into a list of words, stored by differences and compressed.

Documents are scored in `parts` passes, each over all texts and the places of one part of the shards, so that
no more than that share of the places is on disk at once. Shuffled files go when a pass is written.

Words are 64-bit hashes, and so are rows: rows equal in id, language and text are one until the end.

The places of one middle word meet in one task, piece by piece: its memory holds that word's triples only.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.spark_io import dropped, kept
from tidewright.llm.text import ALNUM, fold, slices, words

ORDER = 3
#: Text bytes for each shard, about, the least number of bits that name a shard, and passes over the documents.
SHARD, BITS, PARTS = 1 << 24, 6, 6
#: Text bytes below which one pass more isn't made.
PASS = 1 << 24
#: Places of a text that are packed at once: their words have numbers below 2**21.
PLACES, _WIDTH = 1 << 20, 21
#: Text bytes of one slice.
_SLICE = 12 << 20
#: Hashes that stand for an edge and for the end of a text.
EDGE, END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_MODEL, _SINGLE, _WORD, _HEAD, _PLACE, _ALONE, _SUM = range(7)
_MESSAGE = "shard int, kind int, base long, data binary, sums binary, keys array<long>, ids array<long>, langs array<string>, n array<long>"
_SCHEMA = pa.schema(
    [("shard", pa.int32()), ("kind", pa.int32()), ("base", pa.int64()), ("data", pa.binary()), ("sums", pa.binary()), ("keys", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64())), ("langs", pa.list_(pa.string())), ("n", pa.list_(pa.int64()))]
)


def padded(column: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes with order - 1 edges before and an end after each text that has words, the row of each, and words by row."""
    w = words(column, ALNUM)
    n = np.diff(w.ptr)
    some = np.flatnonzero(n)
    size = n[some] + order
    start = np.append(0, np.cumsum(size))
    out = np.full(start[-1], EDGE, np.uint64)
    row = np.repeat(some, size)
    out[np.arange(len(w.hash)) + np.repeat(start[:-1] - w.ptr[some] + order - 1, n[some])] = w.hash
    out[start[1:] - 1] = END
    return out, row, n


def places(row: np.ndarray, order: int, k: int) -> np.ndarray:
    """Places (of the last word) of the k-grams that a text's probability asks for: edges are never predicted."""
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
    inside = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
    return np.flatnonzero(inside >= (order - 1 if k == order else order - 2))


def keys(h: np.ndarray, at: np.ndarray, k: int, last: int = 0) -> np.ndarray:
    """Keys of the k-grams that end `last` places before the given ones."""
    return fold([h[at - last - k + 1 + i] for i in range(k)]) if k else np.zeros(len(at), np.uint64)


def grams(h: np.ndarray, row: np.ndarray, order: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    at = places(row, order, k)
    return at, keys(h, at, k)


def _pieces(at: np.ndarray) -> Iterator[np.ndarray]:
    """Places in parts, so that a long text needs little more memory than its words."""
    for lo in range(0, len(at), PLACES):
        yield at[lo : lo + PLACES]


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers from 0 in as few bytes each as the largest needs, byte by byte of all numbers, compressed."""
    sizes, parts = [], []
    for x in arrays:
        most = int(x.max()) if len(x) else 0
        size = next(s for s in (1, 2, 4, 8) if most < 1 << 8 * s)
        sizes += [len(x), size]
        parts.append(np.ascontiguousarray(x.astype(f"<u{size}").view(np.uint8).reshape(-1, size).T).tobytes())
    whole = np.array([len(arrays), *sizes], np.int64).tobytes() + b"".join(parts)
    return len(whole).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(whole, asbytes=True)


def unpacked(data: bytes) -> list[np.ndarray]:
    whole = pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)
    k = int(np.frombuffer(whole, np.int64, 1)[0])
    at, out = 8 * (1 + 2 * k), []
    for n, size in np.frombuffer(whole, np.int64, 2 * k, 8).reshape(-1, 2).tolist():
        out.append(np.ascontiguousarray(np.frombuffer(whole, np.uint8, n * size, at).reshape(size, n).T).view(f"<u{size}").reshape(-1).astype(np.uint64))
        at += n * size
    return out


def _steps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=np.uint64(0))


class Triples(NamedTuple):
    """Words in order, and triples by their numbers in order of middle, first and last word; more: a number of each triple."""

    words: np.ndarray
    middle: np.ndarray
    first: np.ndarray
    last: np.ndarray
    more: np.ndarray

    def packed(self) -> bytes:
        return packed(_steps(self.words), _steps(self.middle * np.uint64(len(self.words)) + self.first), self.last, self.more)

    @staticmethod
    def unpacked(data: bytes) -> Triples:
        w, q, last, more = unpacked(data)
        w = np.cumsum(w, dtype=np.uint64)
        middle, first = np.divmod(np.cumsum(q, dtype=np.uint64), np.uint64(len(w)))
        return Triples(w, middle, first, last, more)


def shard_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def _by_shard(whole: Triples, bits: int) -> Iterator[tuple[int, Triples]]:
    """The triples of each shard, with its own words only."""
    shard = shard_of(whole.words, bits)[whole.middle]
    number = np.zeros(len(whole.words), np.uint64)
    cut = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else np.zeros(0, np.int64)
    for lo, hi in itertools.pairwise([*cut.tolist(), len(shard)]):
        own = [x[lo:hi] for x in (whole.middle, whole.first, whole.last)]
        some = np.zeros(len(whole.words), bool)
        for x in own:
            some[x] = True
        here = np.flatnonzero(some)
        number[here] = np.arange(len(here), dtype=np.uint64)
        yield int(shard[lo]), Triples(whole.words[here], *(number[x] for x in own), whole.more[lo:hi])


def _triples(h: np.ndarray, at: np.ndarray, rows: np.ndarray | None = None) -> Triples:
    """The triples that end at the given places (at most PLACES) with their rows; without rows the distinct ones and how often each is there."""
    n = len(at)
    w, number = np.unique(np.concatenate([h[at - 1], h[at - 2], h[at]]), return_inverse=True)
    number = number.reshape(-1).astype(np.uint64)
    key = number[:n] << np.uint64(2 * _WIDTH) | number[n : 2 * n] << np.uint64(_WIDTH) | number[2 * n :]
    if rows is None:
        key, more = np.unique(key, return_counts=True)
    else:
        order = np.argsort(key)
        key, more = key[order], rows[order]
    low = np.uint64((1 << _WIDTH) - 1)
    return Triples(w, key >> np.uint64(2 * _WIDTH), key >> np.uint64(_WIDTH) & low, key & low, more.astype(np.uint64))


def _row(shard: int, kind: int, base: int | None = None, data: bytes | None = None, **more) -> dict:
    return dict.fromkeys(("sums", "keys", "ids", "langs", "n")) | {"shard": shard, "kind": kind, "base": base, "data": data} | more


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, _SCHEMA)


def _count(bits: int) -> callable:
    """Each piece's distinct triples and their counts, by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                h, row, _ = padded(part.column("text"), ORDER)
                for at in _pieces(places(row, ORDER, ORDER)):
                    yield _batch([_row(s, _MODEL, data=t.packed()) for s, t in _by_shard(_triples(h, at), bits)])

    return run


def merged(parts: list[Triples]) -> Triples:
    """Triples of several lists, with the sums of their counts."""
    w = np.unique(np.concatenate([t.words for t in parts]))
    numbers = [np.searchsorted(w, t.words).astype(np.uint64) for t in parts]
    middle, first, last = (np.concatenate([n[t[k]] for n, t in zip(numbers, parts, strict=True)]) for k in (1, 2, 3))
    order = np.lexsort((last, first, middle))
    middle, first, last = middle[order], first[order], last[order]
    at = np.flatnonzero(np.append(True, (middle[1:] != middle[:-1]) | (first[1:] != first[:-1]) | (last[1:] != last[:-1])))
    return Triples(w, middle[at], first[at], last[at], np.add.reduceat(np.concatenate([t.more for t in parts])[order], at))


def _groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[int, Iterator[dict]]]:
    """Rows one after another by their column, which they are sorted by."""
    return itertools.groupby((r for batch in batches for r in batch.to_pylist()), lambda r: r[column])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for shard, rows in _groups(batches, "shard"):
        yield _batch([_row(shard, _MODEL, data=merged([Triples.unpacked(r["data"]) for r in rows]).packed())])


def _pairs(t: Triples) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the distinct pairs of middle and last word, that of each triple, and how many triples end in each."""
    key, inverse, n = np.unique(t.middle * np.uint64(len(t.words)) + t.last, return_inverse=True, return_counts=True)
    return key, inverse.reshape(-1), n.astype(np.uint64)


def _few(n: np.ndarray, order: int) -> list:
    return [order, *np.bincount(np.minimum(n, 5).astype(np.int64), minlength=6)[1:5].tolist(), len(n), int(n.sum())]


_FEW = ["k", "n1", "n2", "n3", "n4", "size", "total"]


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many n-grams of each order have counts 1 to 4, how many there are, and the sum of their counts."""
    for batch in batches:
        for r in batch.to_pylist():
            if r["kind"] == _WORD:
                found = [_few(unpacked(r["data"])[1], 1)]
            else:
                t = Triples.unpacked(r["data"])
                found = [_few(t.more, 3), _few(_pairs(t)[2], 2)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], _FEW)


def _ends(bits: int) -> callable:
    """A shard's words to the shards of their own hashes, with the number of pairs that end in each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                t = Triples.unpacked(r["data"])
                n = np.bincount((_pairs(t)[0] % np.uint64(len(t.words))).astype(np.int64), minlength=len(t.words)).astype(np.uint64)
                shard = shard_of(t.words, bits)
                cut = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
                yield _batch([_row(int(shard[lo]), _SINGLE, (lo << 32) + r["shard"], packed(_steps(t.words[lo:hi]), n[lo:hi])) for lo, hi in itertools.pairwise([*cut.tolist(), len(shard)])])

    return run


def _singles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Single words with the number of pairs that end in each, and these numbers back to the shards that sent the words."""
    for shard, rows in _groups(batches, "shard"):
        sent = [(r["base"], *unpacked(r["data"])) for r in rows]
        own = [np.cumsum(w, dtype=np.uint64) for _, w, _ in sent]
        w, at = np.unique(np.concatenate(own), return_inverse=True)
        total = np.zeros(len(w), np.uint64)
        np.add.at(total, at.reshape(-1), np.concatenate([n for _, _, n in sent]))
        some = total > 0
        if some.any():
            yield _batch([_row(shard, _WORD, data=packed(_steps(w[some]), total[some]))])
        for (base, _, _), x in zip(sent, own, strict=True):
            yield _batch([_row(base & 0xFFFFFFFF, _SINGLE, base >> 32, packed(total[np.searchsorted(w, x)]))])


class Model(NamedTuple):
    """Triples and single words by shard, the discounts of each order, the sum and number of single words, and all n-grams."""

    triples: DataFrame | None
    singles: DataFrame | None
    size: int
    cuts: dict[int, list[float]]
    total: int
    unknown: float
    bits: int
    bytes: int


def _discounts(of) -> list[float]:
    y = of.n1 / (of.n1 + 2 * of.n2) if of.n1 + of.n2 else 0.5
    raw = [k - (k + 1) * y * of[f"n{k + 1}"] / of[f"n{k}"] if of[f"n{k}"] else 0.5 * k for k in (1, 2, 3)]
    return [0.0, *(min(max(d, 0.05), float(k)) for k, d in enumerate(raw, 1))]  # above 0: each context leaves some weight


def _written(df: DataFrame, name: str) -> DataFrame:
    """As `kept`, and what was shuffled for it goes at once."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        return kept(df, name)
    finally:
        conf.set(key, before)


def fit(trusted: DataFrame, *, text_col: str = "text", text_bytes: int = 0) -> Model:
    """The model of whole texts; text_bytes: of all texts, which say how many shards there are."""
    bits = max(BITS, int(np.ceil(np.log2(max(text_bytes, 1) / SHARD))))
    text = trusted.select(F.col(text_col).cast("string").alias("text")).filter("text <> ''")
    dealt = lambda df: df.repartition(1 << bits, "shard").sortWithinPartitions("shard")
    triples = _written(dealt(text.mapInArrow(_count(bits), _MESSAGE)).mapInArrow(_merge, _MESSAGE), "triples")
    singles = _written(dealt(triples.mapInArrow(_ends(bits), _MESSAGE)).mapInArrow(_singles, _MESSAGE), "singles")
    every = triples.unionByName(singles.filter(F.col("kind") == _WORD)).mapInArrow(_stats, ", ".join(f"{c} long" for c in _FEW))
    of = {r.k: r for r in every.groupBy("k").agg(*[F.sum(c).alias(c) for c in _FEW[1:]]).collect()}
    if not of:
        dropped(triples, singles)
        return Model(None, None, 0, {}, 0, 0.0, bits, text_bytes)
    cuts, one = {k: _discounts(of[k]) for k in of}, of[1]
    taken = one.n1 * cuts[1][1] + one.n2 * cuts[1][2] + (one.size - one.n1 - one.n2) * cuts[1][3]
    # An unknown word has the left-over weight's share of the context without words.
    return Model(triples, singles, sum(r.size for r in of.values()), cuts, one.total, float(np.log(taken / one.total / (one.size + 1))), bits, text_bytes)


def _find(keys: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the given keys stand among sorted ones, and whether they do."""
    if not len(keys):
        return np.zeros(len(of), np.int64), np.zeros(len(of), bool)
    at = np.minimum(np.searchsorted(keys, of), len(keys) - 1)
    return at, keys[at] == of


class _Shard:
    """What a shard's triples add to the log-probability of a word alone."""

    def __init__(self, t: Triples, single: np.ndarray, cuts: dict[int, np.ndarray], total: int, unknown: float):
        self.words, self.width = t.words, np.uint64(len(t.words))
        cut = lambda k, n: cuts[k][np.minimum(n, 3).astype(np.int64)]
        n1 = single.astype(np.float64)
        alone = (n1 - cut(1, single)) / total + np.exp(unknown)
        begun = t.middle * self.width + t.first
        first = np.flatnonzero(np.append(True, begun[1:] != begun[:-1]))
        context = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(begun))))
        whole, left = np.add.reduceat(t.more, first).astype(np.float64), np.add.reduceat(cut(3, t.more), first)
        self.contexts, self.left = begun[first], np.log(left / whole)
        self.pairs, of, n2 = _pairs(t)
        middle, last = np.divmod(self.pairs, self.width)
        last = last.astype(np.int64)
        first = np.flatnonzero(np.append(True, middle[1:] != middle[:-1]))
        own = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(middle))))
        whole2, left2 = np.add.reduceat(n2, first).astype(np.float64), np.add.reduceat(cut(2, n2), first)
        self.middles, self.left2 = middle[first], np.log(left2 / whole2)
        two = (n2 - cut(2, n2)) / whole2[own] + (left2 / whole2)[own] * alone[last]
        three = (t.more - cut(3, t.more)) / whole[context] + (left / whole)[context] * two[of]
        self.triples = context.astype(np.uint64) * self.width + t.last
        self.two, self.three = np.log(two / alone[last]), np.log(three / alone[last[of]])

    def adds(self, t: Triples) -> np.ndarray:
        at, known = _find(self.words, t.words)
        number = at.astype(np.uint64)
        middle, first, last = number[t.middle], number[t.first], number[t.last]
        ok, end = known[t.middle], known[t.last]
        context, has = _find(self.contexts, middle * self.width + first)
        has &= ok & known[t.first]
        pair, two = _find(self.pairs, middle * self.width + last)
        two &= ok & end
        alone, begins = _find(self.middles, middle)
        begins &= ok
        triple, three = _find(self.triples, context.astype(np.uint64) * self.width + last)
        three &= has & end
        lower = np.where(two, self.two[pair], np.where(begins, self.left2[alone], 0.0))
        return np.where(three, self.three[triple], lower + np.where(has, self.left[context], 0.0))


def _requests(bits: int, part: int, parts: int) -> callable:
    """The places of documents whose middle or last word is of a shard of this part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        for batch in batches:
            for own in slices(batch, "text", _SLICE):
                h, row, n = padded(own.column("text"), ORDER)
                named = {"ids": own.column("doc_id").to_pylist(), "langs": own.column("lang").to_pylist(), "n": n.tolist()} if part == 0 else {}
                yield _batch([_row((base >> 40) % (1 << bits), _HEAD, base, keys=own.column("key").to_pylist(), **named)])
                here = shard_of(h, bits) % parts == part
                at = places(row, ORDER, ORDER)
                for some in _pieces(at[here[at - 1]]):
                    yield _batch([_row(s, _PLACE, base, t.packed()) for s, t in _by_shard(_triples(h, some, row[some]), bits)])
                for some in _pieces(at[here[at]]):
                    order = np.argsort(h[some])
                    last, rows = h[some][order], row[some][order].astype(np.uint64)
                    shard = shard_of(last, bits)
                    cut = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
                    found = []
                    for lo, hi in itertools.pairwise([*cut.tolist(), len(shard)]):
                        first = np.flatnonzero(np.append(True, last[lo + 1 : hi] != last[lo : hi - 1]))
                        found.append(_row(int(shard[lo]), _ALONE, base, packed(_steps(last[lo:hi][first]), np.diff(np.append(first, hi - lo)).astype(np.uint64), rows[lo:hi])))
                    yield _batch(found)
                base += 1

    return run


def _answers(cuts: dict[int, list[float]], total: int, unknown: float) -> callable:
    """Heads as they are, and sums by row of a slice for each message."""
    cuts = {k: np.array(c) for k, c in cuts.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _groups(batches, "shard"):
            model, triples, single, known, gain = None, None, None, np.zeros(0, np.uint64), np.zeros(0)
            for r in rows:
                if r["kind"] == _HEAD:
                    yield _batch([r])
                    continue
                data = r["data"]
                if r["kind"] == _MODEL:
                    triples = Triples.unpacked(data)
                    single = np.zeros(len(triples.words), np.uint64)
                elif r["kind"] == _SINGLE:
                    own = unpacked(data)[0]
                    single[r["base"] : r["base"] + len(own)] = own
                elif r["kind"] == _WORD:
                    known, n = unpacked(data)
                    known = np.cumsum(known, dtype=np.uint64)
                    gain = np.log((n - cuts[1][np.minimum(n, 3).astype(np.int64)]) / total + np.exp(unknown)) - unknown
                else:
                    if r["kind"] == _PLACE:
                        if triples is None:
                            continue
                        model = model or _Shard(triples, single, cuts, total, unknown)
                        t = Triples.unpacked(data)
                        rows_of, adds = t.more, model.adds(t)
                    else:
                        w, many, rows_of = unpacked(data)
                        at, has = _find(known, np.cumsum(w, dtype=np.uint64))
                        if not has.any():
                            continue
                        adds = np.repeat(np.where(has, gain[at], 0.0), many.astype(np.int64))
                    rows_of = rows_of.astype(np.int64)
                    sums, some = np.bincount(rows_of, adds), np.flatnonzero(np.bincount(rows_of))
                    yield _batch([_row(shard, _SUM, r["base"], packed(some.astype(np.uint64)), sums=sums[some].tobytes())])

    return run


def _summed(unknown: float) -> callable:
    """(key, doc_id, lang, n, logp): a row each of a slice, from its head and all sums."""
    names = ["key", "doc_id", "lang", "n", "logp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, "base"):
            head = next(rows)
            m = len(head["keys"])
            logp = np.zeros(m) if head["n"] is None else (np.array(head["n"]) + 1) * unknown
            for r in rows:
                logp[unpacked(r["data"])[0].astype(np.int64)] += np.frombuffer(r["sums"])
            none = [None] * m
            yield pa.RecordBatch.from_arrays(
                [pa.array(head["keys"], pa.int64()), pa.array(head["ids"] or none, pa.int64()), pa.array(head["langs"] or none, pa.string()), pa.array(head["n"] or none, pa.int64()), pa.array(logp)], names
            )

    return run


def score(docs: DataFrame, model: Model, *, parts: int = PARTS) -> DataFrame:
    """One row per row of docs (doc_id, text, lang): doc_id, lang, n_symbols (words), perplexity (null without words)."""
    parts = max(1, min(parts, model.bytes // PASS))
    rows = docs.select(F.xxhash64("doc_id", "lang", "text").alias("key"), "doc_id", "text", "lang")
    found = []
    for part in range(parts):
        own = F.pmod("shard", F.lit(parts)) == part
        asked = rows.mapInArrow(_requests(model.bits, part, parts), _MESSAGE)
        if model.size:
            asked = asked.unionByName(model.triples.filter(own)).unionByName(model.singles.filter(own))
        sums = asked.repartition(1 << model.bits, "shard").sortWithinPartitions("shard", "kind").mapInArrow(_answers(model.cuts, model.total, model.unknown), _MESSAGE)
        sums = sums.repartition("base").sortWithinPartitions("base", "kind").mapInArrow(_summed(model.unknown), "key long, doc_id long, lang string, n long, logp double")
        found.append(_written(sums, f"sums{part}"))
    # Equal rows sent equal sums: how many there are is known from the first part, which names them.
    one = reduce(DataFrame.unionByName, found).groupBy("key").agg(F.max("doc_id").alias("doc_id"), F.max("lang").alias("lang"), F.max("n").alias("n_symbols"), F.count("n").alias("m"), F.sum("logp").alias("logp"))
    each = one.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), "m")))
    return each.select("doc_id", "lang", "n_symbols", F.when(F.col("n_symbols") > 0, F.round(F.exp(-F.col("logp") / F.col("m") / (F.col("n_symbols") + 1)), 9)).alias("perplexity"))
