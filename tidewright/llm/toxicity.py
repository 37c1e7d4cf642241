"""Toxicity by a counterfactual-regularised linear classifier on words and word beginnings.

Features of a document are its distinct words and the beginnings of its words (4, 6 and 8 bytes),
each present in one word or in two or more different ones. Features enter the model when their share
of toxic training documents differs clearly from the overall share (a z-score of exact counts), and
identity terms always do. Training minimises weighted logistic loss, an L2 term and a counterfactual term: in all
documents of the training sample identity terms are swapped for one another (or put in, where there
is none), and the squared change of the score is penalised, so that a neutral mention of a group
moves no score.

Training takes at most `sample` labelled documents of each label (those with the smallest hash of
their id, whole texts), weighted back to the labels' shares: that is the documented bound of the
training sample. Scoring is row by row without a shuffle.

Edge cases: null or empty text has no words and gets the base score; without labelled rows, or with
labels of one kind only, scores are the smoothed share of label 1; labels other than 0 and 1 and null
labels are left out; a score at the threshold is predicted as 1; repeated rows and rows without an id are
each scored; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.spark_io import filtered, id_and_text, smallest_hashes
from tidewright.llm.text import ALNUM, slices, words

SAMPLE, THRESHOLD, Z, PENALTY, RIDGE = 2_500, 0.3, 4.0, 4.0, 1e-3
#: Lengths, in bytes, of the word beginnings that are features.
HEADS = (4, 6, 8)
#: Entries whose features are counted at once, about.
_PART = 1 << 21
_TWICE = np.uint64(0x5851F42D4C957F2D)
#: Identity terms whose swaps leave a text's toxicity as it is.
IDENTITY_TERMS = [
    "women", "men", "woman", "man", "girls", "boys", "muslim", "muslims", "christian", "christians", "jewish", "jews", "hindu", "buddhist", "atheist", "gay", "lesbian", "straight", "transgender", "black", "white", "asian", "latino", "african", "european", "american",
    "mexican", "immigrants", "refugees", "disabled", "blind", "deaf", "old", "young", "frauen", "männer", "juden", "muslime", "christen", "femmes", "hommes", "juifs", "musulmans", "chrétiens", "mujeres", "hombres", "judíos", "musulmanes", "cristianos",
]


def feature_sets(column: pa.Array) -> list[np.ndarray]:
    """Sorted distinct feature hashes of each row."""
    w = words(column, ALNUM, HEADS)
    out = []
    for r in range(len(column)):
        own, first = np.unique(w.row(r), return_index=True)
        heads, n = np.unique(np.concatenate([h[w.ptr[r] : w.ptr[r + 1]][first] for h in w.heads]), return_counts=True)
        n = n[heads != 0]
        heads = heads[heads != 0]
        out.append(np.unique(np.concatenate([own, heads, heads[n > 1] ^ _TWICE])))
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array([s.tobytes() for s in feature_sets(part.column("text"))], pa.binary())], ["toxic", "words"])


class Model:
    """Sorted feature hashes with weights, and a base score (log-odds)."""

    def __init__(self, known: np.ndarray, weight: np.ndarray, base: float):
        self.known, self.weight, self.base = known, weight, base

    def score(self, column: pa.Array) -> np.ndarray:
        """Scores of whole texts."""
        w = words(column, ALNUM, HEADS)
        z = np.full(len(column), self.base)
        if not len(self.known) or not len(w.hash):
            return 1 / (1 + np.exp(-z))
        # A beginning is looked for by its own hash, whether it is known as present once or twice.
        base = np.unique(np.concatenate([self.known, self.known ^ _TWICE]))
        bits = np.zeros(1 << 16, bool)
        bits[(base & np.uint64(0xFFFF)).astype(np.int64)] = True
        for k, hashes in enumerate([w.hash, *w.heads]):
            maybe = np.flatnonzero(bits[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
            at = np.minimum(np.searchsorted(base, hashes[maybe]), len(base) - 1)
            hit = base[at] == hashes[maybe]
            maybe, at = maybe[hit], at[hit]
            row = np.searchsorted(w.ptr, maybe, "right") - 1
            order = np.lexsort((w.hash[maybe], at, row))
            maybe, at, row = maybe[order], at[order], row[order]
            own = np.append(True, (at[1:] != at[:-1]) | (row[1:] != row[:-1])) if len(at) else np.zeros(0, bool)
            other = np.append(True, w.hash[maybe[1:]] != w.hash[maybe[:-1]]) if len(at) else own
            first = np.flatnonzero(own)
            distinct = np.add.reduceat(own | other, first) if len(first) else first
            for found, rows in ((base[at[first]], row[first]), (base[at[first]] ^ _TWICE, np.where(distinct > 1, row[first], -1) if k else np.full(len(first), -1))):
                place = np.minimum(np.searchsorted(self.known, found), len(self.known) - 1)
                good = (self.known[place] == found) & (rows >= 0)
                z += np.bincount(rows[good], self.weight[place[good]], minlength=len(z))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def swap_gram(n: int, terms: int, row: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, int]:
    """Sum of outer products of the counterfactual differences of n documents, and how many there are.

    row, term: which documents hold which terms, by row. In every document a term is swapped for the
    next ones, or put in where there is none, four times.
    """
    gram, ptr = np.zeros((terms, terms)), np.searchsorted(row, np.arange(n + 1))
    for r in range(n):
        present = term[ptr[r] : ptr[r + 1]]
        for k in range(4):
            put = (7 * r + 13 * k) % terms
            out = present[k % len(present)] if len(present) else put
            gram[put, put] += 1
            if len(present):
                gram[out, out] += 1
                gram[put, out] -= 1
                gram[out, put] -= 1
    return gram, 4 * n


def counted(sets: list[np.ndarray], toxic: np.ndarray, part: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Features in order, how many toxic documents and how many documents hold each: exact, by ranges of hashes of about `part` entries."""
    parts = max(1, -(-sum(map(len, sets)) // (part or _PART)))
    edges = np.array([k * (1 << 64) // parts for k in range(1, parts)], np.uint64)
    cuts = [np.concatenate([[0], np.searchsorted(own, edges), [len(own)]]).astype(np.int64) for own in sets]
    for k in range(parts):
        own = [s[c[k] : c[k + 1]] for s, c in zip(sets, cuts, strict=True)]
        values, inverse, df = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
        yield values, np.bincount(inverse, np.repeat(toxic, list(map(len, own))), minlength=len(values)), df


def train(sets: list[np.ndarray], toxic: np.ndarray, weight: np.ndarray | None = None, *, z: float = Z, penalty: float = PENALTY, ridge: float = RIDGE, rounds: int = 400) -> Model:
    """Fits the model to feature sets and 0/1 labels; weight: of each document."""
    n, ones = len(toxic), int(toxic.sum())
    weight = np.ones(n) if weight is None else weight / weight.mean()
    if not 0 < ones < n:
        share = (ones + 0.5) / (n + 1) if n else 0.05
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(share / (1 - share))))
    share = ones / n

    def unlikely(hits: np.ndarray, df: np.ndarray) -> np.ndarray:
        score = np.abs(hits - df * share) / np.sqrt(np.maximum(df * share * (1 - share), 1e-9))
        return (score >= z) & (np.maximum(hits, df - hits) >= 2)

    terms = np.unique(words(pa.array([" ".join(IDENTITY_TERMS)]), ALNUM).hash)
    begun = np.concatenate(words(pa.array([" ".join(IDENTITY_TERMS)]), ALNUM, HEADS).heads)  # their beginnings stay out
    some = np.concatenate([v[unlikely(hits, df)] for v, hits, df in counted(sets, toxic)])
    known = np.union1d(np.setdiff1d(some, np.concatenate([terms, begun, begun ^ _TWICE])), terms)
    is_term = np.isin(known, terms)
    # The matrix of documents and features, sparse: all its entries are one.
    at = [np.flatnonzero(np.isin(known, own, assume_unique=True)) for own in sets]
    row, at = np.repeat(np.arange(n), list(map(len, at))), np.concatenate(at)
    own_terms = np.flatnonzero(is_term)
    gram, n_swaps = swap_gram(n, len(own_terms), row[is_term[at]], np.searchsorted(own_terms, at[is_term[at]]))
    gram *= len(own_terms) / n_swaps  # each term weighs about one
    w, b, y = np.zeros(len(known)), float(np.log((weight * toxic).sum() / (weight * (1 - toxic)).sum())), toxic.astype(np.float64)
    mw, mb = np.zeros(len(known)), 0.0
    step = 4.0 / (0.25 * max(1.0, len(at) / n) + 3 * penalty + ridge)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[at], minlength=n) + b, -30, 30)))
        off = weight * (p - y)
        gw = np.bincount(at, off[row], minlength=len(w)) / n + ridge * w
        gw[own_terms] += penalty * (gram @ w[own_terms])
        gb = float(off.mean())
        mw, mb = 0.9 * mw + gw, 0.9 * mb + gb
        w, b = w - 0.1 * step * mw, b - 0.1 * step * mb
    return Model(known, w, b)


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, **how) -> Model:
    """A model of the documents that labels marks; one label per id (the larger, if they differ)."""
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = smallest_hashes(marks, "toxic", "doc_id", sample)
    # One text of an id that is repeated, so that the sample's bound holds whatever the ids are.
    rows = id_and_text(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("toxic", "text")
    found = sorted((r.words, r.toxic) for r in rows.mapInArrow(_features, "toxic int, words binary").toLocalIterator())
    if not found:
        return train([np.zeros(0, np.uint64)], np.zeros(1, np.int64), **how)
    toxic = np.array([t for _, t in found], np.int64)
    total = {r.toxic: r["count"] for r in marks.groupBy("toxic").count().collect()}
    weight = np.array([total[t] / (toxic == t).sum() for t in toxic.tolist()])
    return train([np.frombuffer(w, np.uint64) for w, _ in found], toxic, weight, **how)


def _score(shared, threshold: float) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                s = shared.value.score(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return run


def classify(docs: DataFrame, model: Model, *, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: doc_id, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return id_and_text(docs, id_col, text_col).mapInArrow(_score(shared, threshold), "doc_id long, score double, predicted int")


def civil(docs: DataFrame, model: Model, *, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of docs scored below the threshold, with all their columns, in one pass without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                yield part.filter(pa.array(shared.value.score(part.column(text_col)) < threshold))

    return filtered(docs, run, text_col)
