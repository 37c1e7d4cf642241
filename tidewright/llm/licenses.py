"""License scans by diagonal voting.

All rolling word 2-gram hashes of every document are joined, in Spark, to the places of the same
hashes in a fixed set of templates (a few hundred rows, so the template side is broadcast). A match
votes for the diagonal (document place minus template place); a template standing word for word
puts all its votes on one diagonal, insertions and deletions spread them over neighbouring ones.
Votes are summed by (document, template, diagonal). Exact templates (the base phrases) are verified
by having every place on one diagonal. For the approximate ones, diagonals that lie at most `DRIFT`
apart are merged, whichever they are, so a merged span is at most that much longer than its template.
It is verified by its matches: the places of the template that stand in order in the text, on
those diagonals, must cover a share of the template. (Equality of words rests on 64-bit hashes of
2-grams.)

Only matches are shuffled, never texts. A sentinel hash put before each document's grams matches
one template row, so documents without any match keep their row and the table is read once. A
frequent 2-gram adds map-side work in proportion to its occurrences and no more: votes are combined
before the shuffle. A document's diagonals come sorted and are streamed, so a task holds `DRIFT + 1`
of them, however long the document is.

Edge cases: null or empty text has no words, no labels and score 0; a one-word text has no 2-gram;
repeated rows and rows without an id are kept apart by a row number given at the scan; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.spark_io import id_and_text
from tidewright.llm.text import ALNUM, slices, words

#: Base phrases: exact, one label each.
PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}

#: Approximate templates: label and well-known sentences of the license.
TEMPLATES = {
    "mit": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"],
    "apache-2.0": ["licensed under the apache license version 2 0", "you may not use this file except in compliance with the license"],
    "gpl-3.0": ["gnu general public license version 3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "cc-by": ["licensed under the creative commons attribution license", "this work is licensed under a creative commons attribution 4 0 international license"],
    "cc-by-nc": ["licensed under cc by nc 4 0"],
    "mpl-2.0": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
}

#: Merged diagonals lie at most so far apart; a verified span covers this share of its template's 2-grams.
DRIFT, COVERED = 3, 0.7
_SENTINEL = -1


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            w = words(part.column("text"), ALNUM)
            at, h = w.grams(2)
            n = np.diff(w.ptr)
            gram = h.view(np.int64).copy()
            gram[gram == _SENTINEL] = 0
            ptr = np.append(0, np.cumsum(np.maximum(n - 1, 0)))
            values = np.insert(gram, ptr[:-1], _SENTINEL)
            yield pa.RecordBatch.from_arrays(
                [part.column("uid"), part.column("doc_id"), pa.array(n), pa.ListArray.from_arrays(pa.array((ptr + np.arange(len(ptr))).astype(np.int32)), pa.array(values))],
                ["uid", "doc_id", "n_words", "grams"],
            )


def templates(spark: SparkSession) -> tuple[DataFrame, list[tuple[str, int, bool]]]:
    """Rows (gram, template, place) and, by template number, (label, number of 2-grams, exact)."""
    texts = [(label, t, True) for label, t in PHRASES.items()] + [(label, t, False) for label, own in TEMPLATES.items() for t in own]
    w = words(pa.array([t for _, t, _ in texts]), ALNUM)
    rows, about = [(_SENTINEL, -1, 0)], []
    for k, (label, t, exact) in enumerate(texts):
        n = len(t.split()) - 1
        if not 0 < n < 64:
            raise ValueError(f"a template has 2 to 64 words: {t}")
        about.append((label, n, exact))
    at, h = w.grams(2)
    owner = np.searchsorted(w.ptr, at, "right") - 1
    rows += [(int(g), int(o), int(p - w.ptr[o])) for g, o, p in zip(h.view(np.int64), owner, at, strict=True)]
    return spark.createDataFrame(rows, "gram long, template int, place int"), about


def in_order(run: Sequence[tuple[int, int]]) -> int:
    """The most places of a template that stand in order in the text.

    run: (diagonal, bits of the places matched there) of neighbouring diagonals; a place's spot in
    the text is its diagonal and the place.
    """
    ends: list[int] = []  # of the longest chains by length: the earliest spot that a chain of it ends at
    for place in range(max(bits.bit_length() for _, bits in run)):
        spots = sorted((d + place for d, bits in run if bits >> place & 1), reverse=True)  # a place counts once
        for spot in spots:
            at = bisect_left(ends, spot)
            ends[at : at + 1] = [spot]
    return len(ends)


def _judge(about: list[tuple[str, int, bool]]):
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (uid, doc_id, n_words, template, diagonal, votes, places), sorted; one row for each uid comes out."""
        uid, template, state, rows = None, None, None, []
        near: deque[tuple[int, int]] = deque()

        def row() -> tuple:
            doc_id, n_words, n, first, last, base, others, score = state
            return (doc_id, n_words, n, first, last, ",".join(sorted(base)), ",".join(sorted(base | others)), score)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for own, doc_id, n_words, k, diagonal, votes, places in zip(*(batch.column(c).to_pylist() for c in ("uid", "doc_id", "n_words", "template", "diagonal", "votes", "places")), strict=True):
                if own != uid:
                    if state is not None:
                        rows.append(row())
                    uid, template, state = own, None, [doc_id, n_words, 0, None, None, set(), set(), 0.0]
                if k < 0:
                    continue
                label, grams, exact = about[k]
                if exact:
                    if votes == grams:
                        state[2] += 1
                        state[3], state[4] = diagonal if state[3] is None else min(state[3], diagonal), diagonal if state[4] is None else max(state[4], diagonal)
                        state[5].add(label)
                        state[7] = 1.0
                    continue
                if k != template:
                    template = k
                    near.clear()
                near.append((diagonal, places))
                while diagonal - near[0][0] > DRIFT:
                    near.popleft()
                mask = 0
                for _, bits in near:
                    mask |= bits
                if mask.bit_count() >= COVERED * grams and (share := in_order(near) / grams) >= COVERED:
                    state[6].add(label)
                    state[7] = max(state[7], share)
            if len(rows) > 5000:
                yield out()
                rows = []
        if state is not None:
            rows.append(row())
            yield out()

    return run


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    spark = docs.sparkSession
    known, about = templates(spark)
    source = id_and_text(docs, id_col, text_col).select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text")
    emitted = source.mapInArrow(_emit, "uid long, doc_id long, n_words long, grams array<long>")
    hits = emitted.select("uid", "doc_id", "n_words", F.posexplode("grams").alias("at", "gram")).join(F.broadcast(known), "gram")
    diagonal = (
        hits.select("uid", "doc_id", "n_words", "template", (F.col("at") - 1 - F.col("place")).alias("diagonal"), F.expr("shiftleft(1L, place)").alias("bit"))
        .groupBy("uid", "doc_id", "n_words", "template", "diagonal")
        .agg(F.count("*").cast("int").alias("votes"), F.bit_or("bit").alias("places"))
    )
    by_doc = diagonal.repartition("uid").sortWithinPartitions("uid", "template", "diagonal")
    return by_doc.mapInArrow(_judge(about), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
