"""Language ID: nearest of several clustered centroids per language, by cosine of TF-IDF n-grams.

Features are hashed byte trigrams of the lower-cased text, white space, digits and punctuation
taken as one blank; weights are log(1 + count) times inverse document frequency, normalised to
length one. The centroids of a language are spherical k-means clusters of its training documents.
A document gets the language of the nearest centroid. It is rejected if it has no letter or lies
further from it than `reject` says: its cosine is below that share of a low quantile (1 %) of the
cosines of the language's training documents.

The model is fitted on at most `per_language` documents of each language (those with the smallest
hash of their id, whole texts); `per_language` is the documented bound of the training sample, and
the model's size is fixed by the number of languages. Prediction is row by row without a shuffle.

Edge cases: null, empty or letterless text is `und`, score 0, rejected; without training documents
everything is `und`; ties go to the language first in alphabetical order; repeated rows and rows
without an id are each predicted; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.spark_io import filtered, id_and_text, smallest_hashes
from tidewright.llm.text import raw, slices

BINS, CLUSTERS, PER_LANGUAGE, REJECT = 4096, 4, 400, 0.25
#: Share of training documents below the cosine that `reject` is a share of, and least share of a
#: cluster: junk among them sets no limit and makes no centroid.
LOW = 0.01
#: Trigrams below which the least cosine is lowered.
SHORT = 200
UNKNOWN = "und"
#: Rows whose counts (BINS numbers each) are held at once.
ROWS = 512
_LETTER = regex.compile(r"\p{L}")
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_IS_ASCII_LETTER = np.zeros(256, bool)
_IS_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


def counts(column: pa.Array) -> np.ndarray:
    """Hashed trigram counts of each row's text, [rows, BINS]."""
    data, off = raw(column)
    out = np.zeros((len(off) - 1) * BINS, np.float32)
    if not len(data):
        return out.reshape(-1, BINS)
    low = _FOLD[data]
    upper = np.flatnonzero((low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[:-1] == 0xC3)) + 1  # capitals of Latin-1
    low[upper] += 0x20
    keep = low != 0x20
    keep[1:] |= low[:-1] != 0x20
    # A blank stands before and after each row's text.
    edges = np.unique(off)
    row_of = np.repeat(np.arange(len(off) - 1, dtype=np.int32), np.diff(off))
    keep[edges[:-1]] = low[edges[:-1]] != 0x20
    kept = np.append(0, np.cumsum(keep))
    ends = kept[off]
    low, row = low[keep].astype(np.uint32), row_of[keep]
    low = np.insert(low, np.concatenate([ends[:-1], ends[1:]]), 0x20)
    row = np.insert(row, np.concatenate([ends[:-1], ends[1:]]), np.tile(np.arange(len(off) - 1, dtype=np.int32), 2))
    order = np.argsort(row, kind="stable")
    low, row = low[order], row[order]
    h = low[:-2] * np.uint32(0x9E3779B1) + low[1:-1] * np.uint32(0x85EBCA77) + low[2:] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h = (h * np.uint32(0x2C1B3C6D)) >> np.uint32(20)
    same = row[:-2] == row[2:]
    at = row[:-2][same].astype(np.int64) * BINS + h[same]
    return np.bincount(at, minlength=len(out)).astype(np.float32).reshape(-1, BINS)


def has_letter(column: pa.Array) -> np.ndarray:
    data, off = raw(column)
    seen = np.append(0, np.cumsum(_IS_ASCII_LETTER[data]))
    out = seen[off[1:]] > seen[off[:-1]]
    for r in np.flatnonzero(~out & (np.diff(off) > 0)).tolist():
        out[r] = _LETTER.search(data[off[r] : off[r + 1]].tobytes().decode()) is not None
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


class Model:
    """languages, idf, centroids (one row each), the language of each centroid, and least cosines."""

    def __init__(self, languages: list[str], idf: np.ndarray, centroids: np.ndarray, owner: np.ndarray, least: np.ndarray):
        self.languages, self.idf, self.centroids, self.owner, self.least = languages, idf, centroids, owner, least

    def vectors(self, tf: np.ndarray) -> np.ndarray:
        return _unit(np.log1p(tf) * self.idf)

    def predict(self, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language numbers and cosines of the nearest centroids."""
        cos = self.vectors(tf) @ self.centroids.T
        best = cos.argmax(1)
        return self.owner[best], cos[np.arange(len(cos)), best]


def fit_centroids(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from far-apart starts; clusters that run empty are left out."""
    start = [int((x @ x.mean(0)).argmax())]
    near = x @ x[start[0]]
    for _ in range(min(k, len(x)) - 1):
        start.append(int(near.argmin()))
        near = np.maximum(near, x @ x[start[-1]])
    c = x[start]
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        c = _unit(np.array([x[own == j].mean(0) if (own == j).any() else np.zeros(x.shape[1]) for j in range(len(c))], np.float32))
    return c[np.linalg.norm(c, axis=1) > 0.5]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", 1 << 20, ROWS):
            tf = np.minimum(counts(part.column("text")), 65535).astype(np.uint16)
            yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array([r.tobytes() for r in tf], pa.binary())], ["lang", "tf"])


def fit(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_language: int = PER_LANGUAGE, clusters: int = CLUSTERS, reject: float = REJECT) -> Model:
    """A model of the labelled rows of docs (null languages are left out)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("lang is not null and text is not null")
    chosen = smallest_hashes(rows.select("doc_id", "lang"), "lang", "doc_id", per_language).distinct()
    # One text of an id that is repeated, so that the sample's bound holds whatever the ids are.
    sample = rows.join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi").groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("lang", "text").mapInArrow(_features, "lang string, tf binary")
    by: dict[str, list[np.ndarray]] = {}
    for r in sample.collect():
        by.setdefault(r.lang, []).append(np.frombuffer(r.tf, np.uint16).astype(np.float32))
    languages = sorted(by)
    if not languages:
        return Model([], np.ones(BINS, np.float32), np.zeros((0, BINS), np.float32), np.zeros(0, np.int64), np.zeros(0))
    tf = {x: np.array(sorted(by[x], key=lambda v: v.tobytes())) for x in languages}
    df = sum((t > 0).sum(0) for t in tf.values())
    n = sum(map(len, tf.values()))
    model = Model(languages, np.log((1 + n) / (1 + df)).astype(np.float32) + np.float32(0.05), np.zeros((0, BINS)), np.zeros(0), np.zeros(0))
    centroids, owner, least = [], [], []
    for i, x in enumerate(languages):
        v = model.vectors(tf[x])
        v = v[np.linalg.norm(v, axis=1) > 0.5]
        if len(v):
            c = fit_centroids(v, clusters)
            near = (v @ c.T).argmax(1)
            large = np.bincount(near, minlength=len(c)) >= LOW * len(v)
            c, v = c[large], v[large[near]]  # a few documents unlike all others make no centroid and set no limit
            centroids.append(c)
            owner += [i] * len(c)
            least.append(reject * float(np.quantile((v @ c.T).max(1), LOW, method="higher")))
        else:
            least.append(0.0)
    model.centroids, model.owner, model.least = np.concatenate(centroids).astype(np.float32), np.array(owner), np.array(least)
    return model


def _judged(model: Model, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and whether it is rejected, of each text."""
    known = has_letter(texts)
    if not len(model.centroids):
        return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
    tf = counts(texts)
    best, cos = model.predict(tf)
    lang = [model.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)]
    # Cosines of short texts are low by themselves, about as the root of their length.
    rejected = ~known | (cos < model.least[best] * np.sqrt(np.minimum(tf.sum(1) / SHORT, 1)))
    return lang, np.where(known, np.clip(cos, 0, 1), 0.0).astype(np.float64), rejected


def _predict(shared) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20, ROWS):
                lang, score, rejected = _judged(shared.value, part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], ["doc_id", "lang_pred", "score", "rejected"])

    return run


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: doc_id, lang_pred, score, rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return id_and_text(docs, id_col, text_col).mapInArrow(_predict(shared), "doc_id long, lang_pred string, score double, rejected boolean")


def recognised(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """The rows of docs that are not rejected, with all their columns, in one pass without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col, 1 << 20, ROWS):
                yield part.filter(pa.array(~_judged(shared.value, part.column(text_col))[2]))

    return filtered(docs, run, text_col)
