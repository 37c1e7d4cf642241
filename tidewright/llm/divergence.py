"""Source divergence audit: how far the word use of each source lies from the others of its language.

Terms are runs of letters (ASCII case folded, all of non-ASCII). A language keeps the terms that at
least `min_docs` of its documents hold. A group (lang, source) gives each kept term the share
p = 1 + floor(SCALE * (count + 1) / (N + V)), also where count is 0; the divergence of a term is
f(p, q) = floor((p - q)**2 / q).

By an inverted index with baseline corrections, so that no group is spread over the whole vocabulary:

1. Terms are counted by slice of text and summed by (lang, source, term) with map-side sums; a window
   over a term's few rows (one a source) keeps the terms that are frequent enough.
2. Every pair (a, b) of a language starts at V * f(a0, b0), p0 being the share of a zero count.
3. Postings emit nonzero corrections only. A posting (a, p) changes every pair of a by
   f(p, b0) - f(a0, b0) and f(b0, p) - f(b0, a0); that depends on p alone, so a's postings of equal p
   are counted first and emit once. Where both sources hold a term, its postings emit the rest,
   f(p, q) - f(p, b0) - f(a0, q) + f(a0, b0), summed in the task by pair of sources.
4. A group's terms are ranked by windows, first in salted parts and then over the parts' best, so a
   group of any size costs no task more than its parts' limits.

What a task holds of a term is one entry a source of one language; results have a row for each pair
of sources, so the number of sources is bounded by what can be returned. Shares are divided in base
1000, exact in 64 bits while N + V is below 9e15.

Edge cases: null text, lang and source are empty strings; empty texts still make their group; a
language without kept terms has pairs of value 0 and no terms; a source without kept terms has zero
counts; one source alone has no pairs; repeated rows all count; ties go by the item's UTF-8 bytes; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.spark_io import dropped, kept
from tidewright.llm.text import _LOWER, Words, _word_table, mix, raw, slices, words

#: `[^\x00-\x40\x5B-\x60\x7B-\x7F]+` after lower-casing A-Z.
LETTERS = _word_table([*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
MIN_DOCS, TOP, SCALE = 3, 200, 10**9
#: Text bytes counted at once, pairs of postings summed at once, and parts in which a group's terms are first ranked.
SLICE, PAIRS, SALTS = 8 << 20, 1 << 20, 64


def spans(column: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The column's bytes, and where each word begins and stops in them, in the order of `words`."""
    data, off = raw(column)
    is_word = table[data]
    begins, stops = is_word.copy(), np.zeros(len(data) + 1, bool)
    begins[1:] &= ~is_word[:-1]
    first = off[:-1][np.diff(off) > 0]
    begins[first] = is_word[first]
    stops[1:] = is_word
    stops[1:-1] &= ~is_word[1:]
    cut = first[first > 0]
    stops[cut] = is_word[cut - 1]
    return data, np.flatnonzero(begins), np.flatnonzero(stops)


def strings(data: np.ndarray, begins: np.ndarray, stops: np.ndarray) -> pa.Array:
    """The words at those places, lower-cased, as an Arrow column."""
    off = np.append(0, np.cumsum(stops - begins))
    at = np.repeat(begins - off[:-1], np.diff(off)) + np.arange(off[-1])
    return pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(off.astype(np.int64)), pa.py_buffer(_LOWER[data[at]])).cast(pa.string())


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, df) of each slice, and a row without a term for each of its groups."""
    for batch in batches:
        for part in slices(batch, "text", SLICE):
            lang, source = (pc.dictionary_encode(part.column(c)) for c in ("lang", "source"))
            codes = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
            group, of_row = np.unique(codes, return_inverse=True)
            w: Words = words(part.column("text"), LETTERS)
            row = np.repeat(np.arange(part.num_rows), np.diff(w.ptr))
            # One entry a document and term, then one a group and term.
            _, at, tf = np.unique(mix(w.hash + np.uint64(0x9E3779B97F4A7C15) * row.astype(np.uint64)), return_index=True, return_counts=True)
            own = of_row[row[at]]
            _, first, entry = np.unique(mix(w.hash[at] + np.uint64(0xD1B54A32D192ED03) * own.astype(np.uint64)), return_index=True, return_inverse=True)
            n = np.zeros(len(first), np.int64)
            np.add.at(n, entry, tf)
            df = np.bincount(entry, minlength=len(first))
            data, begins, stops = spans(part.column("text"), LETTERS)
            spot = at[first]
            term = strings(data, begins[spot], stops[spot])
            for code, terms, sums, docs in ((group[own[first]], term, n, df), (group, pa.nulls(len(group), pa.string()), np.zeros(len(group), np.int64), np.zeros(len(group), np.int64))):
                names = [lang.dictionary.take(pa.array(code // len(source.dictionary))), source.dictionary.take(pa.array(code % len(source.dictionary)))]
                whole = pa.RecordBatch.from_arrays([*names, terms, pa.array(sums), pa.array(docs)], ["lang", "source", "term", "n", "df"])
                for lo in range(0, whole.num_rows, 50_000):
                    yield whole.slice(lo, 50_000)


def share(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (n + v)), divided in base 1000, so that nothing exceeds 64 bits."""
    whole = n + v
    rest, found = count + 1, None
    for _ in range(4):
        digit = F.call_function("div", rest, whole)
        found = digit if found is None else found * 1000 + digit
        rest = (rest % whole) * 1000
    return F.when(whole > 0, found + 1)


def term_divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def corrections(group: np.ndarray, p: np.ndarray, p0: np.ndarray, ptr: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, sum) over pairs of entries of one posting list; list t is ptr[t] to ptr[t + 1]."""
    size = np.repeat(np.diff(ptr), np.diff(ptr))
    begin = np.repeat(ptr[:-1], np.diff(ptr))
    codes, own = np.unique(group, return_inverse=True)
    upto = np.append(0, np.cumsum(size))
    lo = 0
    while lo < len(group):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + PAIRS, "right")) - 1)
        for first in range(0, int(size[lo]) if hi == lo + 1 else 1, PAIRS if hi == lo + 1 else 1):
            many = size[lo:hi] if hi > lo + 1 else np.minimum(size[lo:hi] - first, PAIRS)
            i = np.repeat(np.arange(lo, hi), many)
            j = np.repeat(begin[lo:hi], many) + first + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            x = _f(p[i], p[j]) - _f(p[i], p0[j]) - _f(p0[i], p[j]) + _f(p0[i], p0[j])
            some = np.flatnonzero((x != 0) & (i != j))
            pair, at = np.unique(own[i[some]] * len(codes) + own[j[some]], return_inverse=True)
            total = np.zeros(len(pair), np.int64)
            np.add.at(total, at, x[some])
            yield codes[pair // len(codes)], codes[pair % len(codes)], total
        lo = hi


def _emitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("postings")
        flat = lists.flatten()
        ptr = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy()))
        columns = (flat.field(c).to_numpy() for c in ("gid", "p", "p0"))
        for a, b, total in corrections(*columns, ptr):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(total)], ["a", "b", "value"])


def audit(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part (`pair` or `term`), item, value, rank, as the module's docstring says."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    source = docs.select(text(text_col).alias("text"), text(lang_col).alias("lang"), text(source_col).alias("source"))
    counts = source.mapInArrow(_counted, "lang string, source string, term string, n long, df long")
    counts = kept(counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df")), "counts")
    of_term = Window.partitionBy("lang", "term")
    place = F.row_number().over(of_term.orderBy("source"))
    index = counts.filter("term is not null").withColumns({"docs": F.sum("df").over(of_term), "total": F.sum("n").over(of_term), "first": (place == 1).cast("long")})
    index = kept(index.filter(F.col("docs") >= min_docs).select("lang", "source", "term", "n", "total", "first"), "index")

    langs = index.groupBy("lang").agg(F.sum("first").alias("v"), F.sum("n").alias("lang_n"))
    own = index.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    groups = counts.filter("term is null").select("lang", "source").join(langs, "lang", "left").join(own, ["lang", "source"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    groups = groups.select("lang", "source", F.xxhash64("lang", "source").alias("gid"), *map(zero, ("v", "lang_n", "group_n")))
    groups = kept(groups.withColumn("p0", share(F.lit(0).cast("long"), F.col("group_n"), F.col("v"))), "groups")
    dropped(counts)
    weighted = index.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("group_n"), F.col("v")))

    q = share(F.col("total"), F.col("lang_n"), F.col("v"))
    terms = weighted.withColumn("q", q).filter("p > q").select("lang", "source", F.col("term").alias("item"), term_divergence(F.col("p"), F.col("q")).alias("value"))
    by = [F.desc("value"), F.asc("item")]
    salted = Window.partitionBy("lang", "source", F.pmod(F.xxhash64("item"), F.lit(SALTS))).orderBy(*by)
    best = terms.withColumn("rank", F.row_number().over(salted)).filter(F.col("rank") <= top).drop("rank")
    terms = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*by))).filter(F.col("rank") <= top)

    a, b = groups.select("lang", F.col("gid").alias("a"), F.col("p0").alias("a0"), "v"), groups.select("lang", F.col("gid").alias("b"), F.col("p0").alias("b0"))
    pairs = a.join(b, "lang").filter("a <> b")
    a0, b0, p = F.col("a0"), F.col("b0"), F.col("p")
    start = pairs.select("a", "b", F.when(F.col("v") > 0, F.col("v") * term_divergence(a0, b0)).otherwise(0).alias("value"))
    alike = weighted.groupBy("lang", F.col("gid").alias("a"), F.col("p0").alias("a0"), "p").agg(F.count("*").alias("k"))
    to = alike.join(b, "lang").filter("a <> b")
    outward = F.struct(F.col("a"), F.col("b"), (F.col("k") * (term_divergence(p, b0) - term_divergence(a0, b0))).alias("value"))
    inward = F.struct(F.col("b").alias("a"), F.col("a").alias("b"), (F.col("k") * (term_divergence(b0, p) - term_divergence(b0, a0))).alias("value"))
    single = to.select(F.explode(F.array(outward, inward)).alias("x")).select("x.*").filter("value <> 0")
    lists = weighted.groupBy("lang", "term").agg(F.collect_list(F.struct("gid", "p", "p0")).alias("postings")).filter(F.size("postings") > 1)
    both = lists.select("postings").mapInArrow(_emitted, "a long, b long, value long")
    value = start.unionByName(single).unionByName(both).groupBy("a", "b").agg(F.sum("value").alias("value"))
    named = value.join(groups.select(F.col("gid").alias("a"), "lang", "source"), "a").join(groups.select(F.col("gid").alias("b"), F.col("source").alias("item")), "b")
    pairs = named.select("lang", "source", "item", "value").withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*by)))
    part = lambda df, name: df.select("lang", "source", F.lit(name).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return part(pairs, "pair").unionByName(part(terms, "term"))
