"""Counting better items by packed postings: lexical ranks of whole catalogues without pair rows.

The catalogue is collapsed to distinct texts and the numbers of their ids, and cut by range of text into
shards of about `SHARD` entries. Each shard is one packed row: for every token its postings, in blocks of
`BLOCK` entries, with the largest score that the token can give within the block. Queries are rows that
meet each shard once (see `shards`).

Ids are needed only for ties, and are in no shard: queries are then dealt by ranges of their targets' ids
instead of salts, and what comes beside a shard in such a range is the ids within the range and, for each
entry, how many lie beyond. So an id goes to one task, however often shards are repeated. Masked items
come with their query, as entries.

For a query, the sum of its tokens' largest scores bounds every score of a block. Blocks that can't
reach the target's score are skipped; in the others the exact cosines are worked out and counted. What
leaves a task is one row a query: how many items are better, how many equal ones have larger ids.

Tokens are 64-bit hashes of the lower-cased words. Cosines are dot / sqrt(|q|**2 * |t|**2) of whole
numbers, so equal texts have equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.functions.text import word_list
from tidewright.operators import shards
from tidewright.operators.shards import CELLS
from tidewright.sources.tables import written

#: Entries of a shard and of a block of postings, and ids of a range, about.
SHARD, BLOCK, IDS = 1 << 14, 64, 1 << 16
#: Tokens of queries that are worked on at once (one query at least), and those of rows of two texts.
TOKENS, PART = 1 << 16, 1 << 18
#: Bits of an entry's number within its shard, where both are one number.
_ENTRY = 32
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Bounds are sums of doubles in any order: they count as reached within this share.
SLACK = 1e-9


def token_hashes(text: Column) -> Column:
    """The words of a text, lower-cased, as 64-bit hashes in an array."""
    return F.transform(word_list(F.lower(text)), lambda w: F.xxhash64(w))  # noqa: PLW0108  (a function of one name is asked for)


def _counted(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, token and tf of a column of token lists, sorted by row."""
    size = pc.list_value_length(lists).fill_null(0).to_numpy()
    token, at = np.unique(lists.flatten().to_numpy(), return_inverse=True)
    pair, tf = np.unique(np.repeat(np.arange(len(lists)), size) * max(1, len(token)) + at, return_counts=True)
    return pair // max(1, len(token)), token[pair % max(1, len(token))] if len(token) else token, tf


def _spread(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places lo, lo + 1, ... of all runs, one run after another."""
    return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())


class Shard(NamedTuple):
    """Postings of some entries: runs of a token's postings in one block have one bound."""

    token: np.ndarray  # sorted
    runs: np.ndarray  # runs of token t: runs[t] to runs[t + 1]
    block: np.ndarray  # of a run
    most: np.ndarray  # of a run: the largest tf / |text|
    posts: np.ndarray  # postings of run r: posts[r] to posts[r + 1]
    entry: np.ndarray
    tf: np.ndarray
    square: np.ndarray  # of an entry: |text|**2
    held: np.ndarray  # of an entry: how many ids

    def packed(self) -> bytes:
        return shards.pack(self._asdict())

    @staticmethod
    def unpacked(data: bytes) -> Shard:
        return Shard(**shards.unpack(data))


def shard_of(lists: pa.Array, ids: pa.Array, block: int = BLOCK) -> Shard:
    """A shard of entries given by their token lists and their ids (lists, or only how many)."""
    entry, token, tf = _counted(lists)
    square = np.zeros(len(lists), np.int64)
    np.add.at(square, entry, tf * tf)
    order = np.lexsort((entry, token))
    entry, token, tf = entry[order], token[order], tf[order]
    first = np.flatnonzero(np.append(True, (token[1:] != token[:-1]) | (entry[1:] // block != entry[:-1] // block))) if len(token) else np.zeros(0, np.int64)
    share = tf / np.sqrt(square[entry])
    known, runs = np.unique(token[first], return_index=True)
    held = (pc.list_value_length(ids) if pa.types.is_list(ids.type) else ids).to_numpy().astype(np.int64)
    return Shard(
        known, np.append(runs, len(first)), entry[first] // block, np.maximum.reduceat(share, first) if len(first) else share, np.append(first, len(token)),
        entry.astype(np.int32), tf.astype(np.int32), square, held,
    )


class Range(NamedTuple):
    """Ids of a shard from a range of ids on."""

    ids: np.ndarray  # those within the range, sorted
    ends: np.ndarray  # of entry e: the end of its run in places
    places: np.ndarray  # entry * len(ids) + place of the id in ids, sorted
    beyond: np.ndarray  # of an entry: ids after the range

    @staticmethod
    def of(entry: np.ndarray, ids: np.ndarray, beyond: np.ndarray) -> Range:
        by_id = np.argsort(ids, kind="stable")
        owner = entry[by_id].astype(np.int64)
        return Range(ids[by_id], np.cumsum(np.bincount(owner, minlength=len(beyond))), np.sort(owner * len(ids) + np.arange(len(ids))), beyond)

    def later(self, target: np.ndarray, row: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """How many ids of an entry are larger than the target of a row."""
        return self.beyond[entry] + self.ends[entry] - np.searchsorted(self.places, entry * len(self.ids) + np.searchsorted(self.ids, target, "right")[row])

    def all_later(self, target: np.ndarray) -> np.ndarray:
        return self.beyond.sum() + len(self.ids) - np.searchsorted(self.ids, target, "right")


class Asked(NamedTuple):
    """Queries: their tokens (row, token, tf), |q|**2, targets, the targets' scores and masks (row, and twice the entry, plus one for an id after the target)."""

    row: np.ndarray
    token: np.ndarray
    tf: np.ndarray
    square: np.ndarray
    target: np.ndarray
    sim: np.ndarray
    mask_row: np.ndarray
    mask_id: np.ndarray


def _sums(keys: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    np.add.at(out, keys, values)
    return out


def cosines(shard: Shard, q: Asked, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Query, entry and score of all scores above 0 in blocks that can reach the query's least; and the postings read."""
    entries, blocks = len(shard.square), int(len(shard.square) - 1) // BLOCK + 1
    at = np.minimum(np.searchsorted(shard.token, q.token), max(0, len(shard.token) - 1))
    some = shard.token[at] == q.token if len(shard.token) else np.zeros(len(q.token), bool)
    row, at, tf = q.row[some], at[some], q.tf[some]
    n = shard.runs[at + 1] - shard.runs[at] if len(at) else at
    run, row, tf = _spread(shard.runs[at] if len(at) else at, n), np.repeat(row, n), np.repeat(tf, n)
    cell = row * blocks + shard.block[run]
    bound = np.bincount(cell, tf * shard.most[run], minlength=len(q.square) * blocks)
    open_ = bound * (1 + SLACK) >= np.repeat(least * np.sqrt(q.square), blocks)
    go = open_[cell]
    run, row, tf = run[go], row[go], tf[go]
    n = shard.posts[run + 1] - shard.posts[run]
    dot, upto, lo = np.zeros(len(q.square) * entries), np.cumsum(n), 0
    while lo < len(run):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + CELLS, "right")))
        own = slice(lo, hi)
        post = _spread(shard.posts[run[own]], n[own])
        dot += np.bincount(np.repeat(row[own], n[own]) * entries + shard.entry[post], np.repeat(tf[own], n[own]) * shard.tf[post], minlength=len(dot))
        lo = hi
    pair = np.flatnonzero(dot)
    row, entry = pair // entries, pair % entries
    return row, entry, dot[pair] / np.sqrt((q.square[row] * shard.square[entry]).astype(np.float64)), int(n.sum())


def counted(shard: Shard, q: Asked, ids: Range | None = None) -> tuple[np.ndarray, np.ndarray]:
    """How many of a shard's items are better than each query's target, and (with ids) how many later ids equal it."""
    queries = len(q.square)
    row, entry, score, _ = cosines(shard, q, q.sim)
    up = score > q.sim[row]
    better = _sums(row[up], shard.held[entry[up]], queries)
    tied = np.zeros(queries, np.int64)
    if ids is not None:
        zero = q.sim == 0
        same = (score == q.sim[row]) | zero[row]
        count = _sums(row[same], ids.later(q.target, row[same], entry[same]), queries)
        tied = np.where(zero, ids.all_later(q.target) - count, count)
    if len(q.mask_id):  # masked items that were counted go
        who, own = q.mask_row, q.mask_id >> 1
        pair = np.minimum(np.searchsorted(row * len(shard.held) + entry, who * len(shard.held) + own), max(0, len(row) - 1))
        found = (row[pair] == who) & (entry[pair] == own) if len(row) else np.zeros(len(who), bool)
        s = np.where(found, score[pair], 0.0) if len(row) else np.zeros(len(who))
        better -= _sums(who, (s > q.sim[who]).astype(np.int64), queries)
        if ids is not None:
            tied -= _sums(who, (s == q.sim[who]) & (q.mask_id & 1 == 1), queries)
    return better, tied


def _runs(size: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows whose sizes sum to `most` at most (one row at least)."""
    upto, lo = np.append(0, np.cumsum(size)), 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


def _row_sums(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    row, token, tf = _counted(lists)
    return row, token, tf, _sums(row, tf * tf, len(lists))


def _dots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the column `own` (the target's tokens) by sim."""
    tokens_of = lambda batch: sum(pc.list_value_length(batch.column(c)).fill_null(0).to_numpy() for c in ("tokens", "own"))
    for batch in (whole.slice(lo, hi - lo) for whole in batches for lo, hi in _runs(tokens_of(whole), PART)):
        (ra, ta, na, sa), (rb, tb, nb, sb) = (_row_sums(batch.column(c)) for c in ("tokens", "own"))
        token = np.unique(np.concatenate([ta, tb]))
        key = lambda r, t: r * max(1, len(token)) + np.searchsorted(token, t)
        _, i, j = np.intersect1d(key(ra, ta), key(rb, tb), assume_unique=True, return_indices=True)
        dot = _sums(ra[i], na[i] * nb[j], batch.num_rows)
        size = np.sqrt((sa * sb).astype(np.float64))
        sim = np.divide(dot, size, out=np.zeros(batch.num_rows), where=size > 0)
        names = [c for c in batch.schema.names if c != "own"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sim)], [*names, "sim"])


def row_cosines(rows: DataFrame, left: str, right: str, name: str) -> DataFrame:
    """The rows with the cosine of two of their texts (0 if one has no word) instead of these; nothing is shuffled."""
    rest = [c for c in rows.columns if c not in (left, right)]
    asked = rows.select(*rest, token_hashes(F.coalesce(left, F.lit(""))).alias("tokens"), token_hashes(F.coalesce(right, F.lit(""))).alias("own"))
    schema = T.StructType([*[f for f in asked.schema.fields if f.name not in ("own",)], T.StructField("sim", T.DoubleType())])
    return asked.mapInArrow(_dots, schema).drop("tokens").withColumnRenamed("sim", name)


def _packed(table: pa.Table) -> pa.Table:
    own = table.combine_chunks().sort_by("e")  # about SHARD entries
    tokens, n = (pa.concat_arrays(own.column(c).chunks) for c in ("tokens", "n"))
    return pa.table({"s": own.column("s").slice(0, 1), "shard": pa.array([shard_of(tokens, n).packed()], pa.binary())})


class Catalogue(NamedTuple):
    """The packed shards (s, shard), the number of shards and of items, the items' texts, the entries (text, s, e) and the ids aimed at in a range."""

    shards: DataFrame
    n: int
    items: int
    texts: DataFrame
    entries: DataFrame
    ids: int

    def places(self) -> DataFrame:
        """item_id, s and e of all items that have a text."""
        return self.texts.join(self.entries, "text").select(F.col("item_id").cast("long").alias("item_id"), "s", "e")


def catalogue(items: DataFrame, *, entries: int = SHARD, ids: int = IDS) -> Catalogue:
    """Items (item_id, text) as packed shards, written once and read by every ranking."""
    texts = items.groupBy("text").agg(F.count("*").alias("n"))
    sizes = texts.agg(F.count("*").alias("entries"), F.sum("n").alias("items")).first()
    n = max(1, -(-sizes.entries // entries))
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = texts.filter("text is not null").repartitionByRange(n, "text").sortWithinPartitions("text").select("text", "n", F.spark_partition_id().alias("s"), place.alias("e"))
    named = written(ranged, "entries")
    rows = named.select("s", "e", "n", token_hashes(F.col("text")).alias("tokens")).groupBy("s").applyInArrow(_packed, "s int, shard binary")
    return Catalogue(written(rows, "postings"), n, sizes.items or 0, items, named.select("text", "s", "e"), ids)


def _met(batches: Iterator[pa.RecordBatch], more: tuple[str, ...] = ()) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Shards, each with its columns besides, and the queries that they meet."""
    size = lambda batch: pc.list_value_length(batch.column("tokens")).fill_null(0).to_numpy()
    return shards.met(batches, lambda data, *besides: (Shard.unpacked(data), *besides), lambda x: len(x[0].square), size, TOKENS, more)


_RANGE = ("range_entries", "range_ids", "beyond")


def _ranked(total: bool) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for met, part in _met(batches, _RANGE if total else ()):
            if total and met is not last:
                last, own = met, Range.of(*(x.values.to_numpy() for x in met[1:3]), np.frombuffer(met[3].as_py(), np.int64))
            row, token, tf, square = _row_sums(part.column("tokens"))
            hidden = part.column("hidden")
            mask, code = np.repeat(np.arange(part.num_rows), pc.list_value_length(hidden).fill_null(0).to_numpy()), hidden.flatten().to_numpy()
            here = code >> (_ENTRY + 1) == part.column("s")[0].as_py()
            asked = Asked(row, token, tf, square, part.column("target").to_numpy(), part.column("sim").to_numpy(), mask[here], code[here] & ((1 << (_ENTRY + 1)) - 1))
            better, tied = counted(met[0], asked, own)
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(better), pa.array(tied)], ["key", "better", "tied"])

    return run


def _edges(rows: DataFrame, column: str, n: int) -> list[int]:
    """About n - 1 values that cut a column into ranges of equal counts."""
    return (rows.agg(F.percentile_approx(column, [k / n for k in range(1, n)], 10_000)).first()[0] if n > 1 else None) or []


def _beyond(ranges: int) -> callable:
    """The rows of one shard (s, range, e, n): for each range, how many ids of each entry lie in later ones."""

    def run(table: pa.Table) -> pa.Table:
        at, e, n, entries = (table.column(c).to_numpy() for c in ("range", "e", "n", "entries"))
        counts = np.zeros((ranges + 1, int(entries[0])), np.int64)
        counts[at, e] = n
        left = counts[::-1].cumsum(axis=0)[::-1][1:]
        return pa.table({"s": pa.array(np.full(ranges, table.column("s")[0].as_py(), np.int32)), "salt": pa.array(np.arange(ranges, dtype=np.int32)), "beyond": pa.array([x.tobytes() for x in left], pa.binary())})

    return run


def _by_range(asked: DataFrame, found: Catalogue) -> tuple[DataFrame, DataFrame]:
    """Queries with the range of ids (salt) that they go to, and the shards of each range with their ids.

    Ranges are cut by targets and by ids alike, so neither queries nor ids of one range are many. A target
    that several ranges end at (as many queries have it) is dealt over all of these.
    """
    ranges = max(shards.salts(asked, found.n), -(-found.items // (found.ids * found.n)))
    places = written(found.places(), "places")
    cuts = np.array(sorted(_edges(asked, "target", -(-ranges // 2)) + _edges(places, "item_id", ranges // 2 + 1)), np.int64)
    ranges = len(cuts) + 1

    def of_query(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            target = batch.column("target").to_numpy()
            lo, hi = np.searchsorted(cuts, target, "left"), np.searchsorted(cuts, target, "right")
            yield batch.append_column("salt", pa.array((lo + (batch.column("key").to_numpy().view(np.uint64) * _MIX >> np.uint64(33)).astype(np.int64) % (hi - lo + 1)).astype(np.int32)))

    def of_id(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("range", pa.array(np.searchsorted(cuts, batch.column("item_id").to_numpy(), "left").astype(np.int32)))

    queries = asked.mapInArrow(of_query, T.StructType([*asked.schema.fields, T.StructField("salt", T.IntegerType())]))
    ids = places.mapInArrow(of_id, T.StructType([*places.schema.fields, T.StructField("range", T.IntegerType())]))
    entries = found.entries.groupBy("s").agg(F.count("*").alias("entries"))
    counts = ids.groupBy("s", "range", "e").agg(F.count("*").alias("n")).join(F.broadcast(entries), "s")
    beyond = counts.groupBy("s").applyInArrow(_beyond(ranges), "s int, salt int, beyond binary")
    own = ids.groupBy("s", F.col("range").alias("salt")).agg(F.collect_list(F.struct("e", "item_id")).alias("_own"))
    rows = beyond.join(own, ["s", "salt"], "left").withColumn("_own", F.coalesce("_own", F.array().cast(own.schema["_own"].dataType)))
    return queries, found.shards.join(rows, "s").select("s", "salt", "shard", F.col("_own.e").alias(_RANGE[0]), F.col("_own.item_id").alias(_RANGE[1]), "beyond")


def ranks(queries: DataFrame, found: Catalogue, key: str, target: str, masked: DataFrame | None = None, *, total: bool = False) -> DataFrame:
    """key, target, sim, known and rank_strict (1 and the number of better scores) of each query's target.

    queries: key (unique, a whole number), text, target. A target that the catalogue lacks has similarity
    0 and the rank after all items. masked: key, item_id of items left out for a query (never its target);
    a query's masks are one list, so keep them as short as a history. With total,
    rank_total as well: equal scores of larger ids also come before the target.
    """
    own = found.texts.select(F.col("item_id").alias("target"), F.col("text").alias("_text"))
    rows = queries.select(F.col(key).cast("long").alias("key"), F.col(target).cast("long").alias("target"), F.col("text").alias("_query")).join(own, "target", "left")
    rows = rows.select("key", "target", F.col("_text").isNotNull().alias("known"), token_hashes(F.coalesce("_query", F.lit(""))).alias("tokens"), token_hashes(F.coalesce("_text", F.lit(""))).alias("own"))
    if masked is not None:
        code = F.shiftleft((F.shiftleft(F.col("s").cast("long"), _ENTRY) + F.col("e")), 1)
        pairs = masked.select(F.col(key).cast("long").alias("key"), F.col("item_id").cast("long").alias("item_id")).join(found.places(), "item_id")
        lists = pairs.groupBy("key").agg(F.collect_set(F.struct("item_id", code.alias("code"))).alias("_masked"))
        other = F.filter("_masked", lambda m: m["item_id"] != F.col("target"))
        rows = rows.join(lists, "key", "left").withColumn("hidden", F.transform(other, lambda m: m["code"] + (m["item_id"] > F.col("target")).cast("long"))).drop("_masked")
    else:
        rows = rows.withColumn("hidden", F.lit(None).cast("array<long>"))
    prepared = rows.mapInArrow(_dots, "key long, target long, known boolean, tokens array<long>, hidden array<long>, sim double")
    prepared = written(prepared, "asked")
    asked, columns = prepared.filter("known"), ["key", "target", "tokens", "hidden", "sim"]
    dealt = shards.dealt(*_by_range(asked, found), found.n, columns, more=_RANGE) if total else shards.dealt(asked, found.shards, found.n, columns)
    counts = dealt.mapInArrow(_ranked(total), "key long, better long, tied long")
    sums = counts.groupBy("key").agg(F.sum("better").alias("better"), F.sum("tied").alias("tied"))
    place = lambda c: F.when(F.col("known"), 1 + c).otherwise(found.items + 1)
    better, tied = F.coalesce("better", F.lit(0)), F.coalesce("tied", F.lit(0))
    more = [place(better + tied).alias("rank_total")] if total else []
    out = prepared.select("key", "target", "sim", "known").join(sums, "key", "left")
    return out.select(F.col("key").alias(key), F.col("target").alias(target), "sim", "known", place(better).alias("rank_strict"), *more)


def _bests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (shard,), part in _met(batches):
        row, token, tf, square = _row_sums(part.column("tokens"))
        none = np.zeros(0, np.int64)
        who, entry, score, _ = cosines(shard, Asked(row, token, tf, square, none, none, none, none), np.zeros(part.num_rows))
        best = np.zeros(part.num_rows)
        np.maximum.at(best, who, score)
        n = _sums(who, shard.held[entry], part.num_rows)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(some)), pa.array(best[some]), pa.array(n[some])], ["key", "best", "n"])


def best_scores(queries: DataFrame, found: Catalogue, key: str) -> DataFrame:
    """key, best (the largest cosine) and n (items with a common token) of the queries that have any. queries: key, text."""
    rows = queries.select(F.col(key).cast("long").alias("key"), token_hashes(F.coalesce("text", F.lit(""))).alias("tokens"))
    parts = shards.dealt(rows, found.shards, found.n, ["key", "tokens"]).mapInArrow(_bests, "key long, best double, n long")
    return parts.groupBy(F.col("key").alias(key)).agg(F.max("best").alias("best"), F.sum("n").alias("n"))
