"""Dense search: best items, masked ranks, gains and contrastive losses by products with packed shards of vectors.

Items are dealt by the hash of their id into shards of about `BYTES` of vectors, queries meet them as in
`shards`. A task multiplies a few query rows with one shard and sends what it has counted, so a query
costs one row a shard (k rows for the best items). A query's mask is a list of ids beside its vector;
its places in a shard are found by search in the shard's sorted ids.

Scores are rounded before they are compared, so that the order of sums doesn't decide ties. A target is
never counted among the better items, whatever its mask says.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.rubric import ndcg
from tidewright.operators import shards
from tidewright.sources.tables import written

#: Bytes of vectors in a shard, and parts in which a query's best are ranked first.
BYTES, SALTS = 16 << 20, 32


class Vectors(NamedTuple):
    """Packed shards (s, shard), their number, and the number of items."""

    shards: DataFrame
    n: int
    items: int


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each run of rows of one s."""
    s, held = None, []

    def row() -> pa.RecordBatch:
        ids, labels = (np.concatenate([h[k] for h in held]) for k in (0, 1))
        v = np.concatenate([h[2] for h in held])
        order = np.argsort(ids, kind="stable")
        data = shards.pack({"ids": ids[order], "labels": labels[order], "v": v[order]})
        return pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([data], pa.binary())], ["s", "shard"])

    for batch in batches:
        if not batch.num_rows:
            continue
        own = batch.column("s").to_numpy()
        v = matrix(batch.column("v"), batch.num_rows)
        cut = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        for lo, hi in zip(cut.tolist(), np.append(cut[1:], len(own)).tolist(), strict=True):
            if held and own[lo] != s:
                yield row()
                held = []
            s = int(own[lo])
            held.append((batch.column("item_id").to_numpy()[lo:hi], batch.column("label").to_numpy()[lo:hi], v[lo:hi]))
    if held:
        yield row()


def matrix(column: pa.Array, rows: int) -> np.ndarray:
    """A column of lists of equal length as a matrix."""
    return column.flatten().to_numpy().astype(np.float64).reshape(rows, -1)


def vectors(items: DataFrame, *, label: str | None = None, block: int = 0) -> Vectors:
    """Items (item_id, v, maybe a label) in packed shards, written once; items without a vector are left out.

    block: the most vectors of a shard, about (0: as many as `BYTES` hold).
    """
    own = items.filter("v is not null")
    size = own.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    per = block or max(64, BYTES // (8 * (size.width or 1)))
    n = max(1, -(-size.n // per))
    tasks = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marked = own.select(F.pmod(F.xxhash64("item_id"), F.lit(n)).cast("int").alias("s"), F.col("item_id").cast("long").alias("item_id"), (F.xxhash64(label) if label else F.lit(0).cast("long")).alias("label"), F.col("v").cast("array<double>").alias("v"))
    rows = marked.repartition(max(tasks, min(n, 1 << 16)), "s").sortWithinPartitions("s").mapInArrow(_packed, "s int, shard binary")
    return Vectors(written(rows, "vectors"), n, size.n)


def _scored(batches: Iterator[pa.RecordBatch], places: int) -> Iterator[tuple[dict, pa.RecordBatch, np.ndarray]]:
    for shard, part in shards.met(batches, shards.unpack, lambda x: len(x["ids"])):
        yield shard, part, np.round(matrix(part.column("v"), part.num_rows) @ shard["v"].T, places)


def _at(ids: np.ndarray, wanted: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and places of those wanted ids that stand in a shard's sorted ids."""
    place = np.minimum(np.searchsorted(ids, wanted), len(ids) - 1)
    here = ids[place] == wanted
    return rows[here], place[here]


def best_of(k: int, places: int) -> callable:
    """The k best items of a shard for each query that meets it, but itself: (key, item_id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, part, scores in _scored(batches, places):
            keys, ids = part.column("key").to_numpy(), shard["ids"]
            scores[_at(ids, keys, np.arange(len(keys)))] = -np.inf
            least = np.partition(scores, max(0, len(ids) - k), axis=1)[:, max(0, len(ids) - k)]
            row, at = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
            s = scores[row, at]
            order = np.lexsort((ids[at], -s, row))
            row, at, s = row[order], at[order], s[order]
            keep = np.arange(len(row)) - np.searchsorted(row, row) < k
            yield pa.RecordBatch.from_arrays([pa.array(keys[row[keep]]), pa.array(ids[at[keep]]), pa.array(s[keep])], ["key", "item_id", "score"])

    return run


def top(queries: DataFrame, items: Vectors, key: str, k: int, *, places: int = 6) -> DataFrame:
    """key, item_id, score, rn: the k items of highest score (ties by id) of each query but itself. queries: key, v."""
    rows = queries.select(F.col(key).cast("long").alias("key"), F.col("v").cast("array<double>").alias("v"))
    found = shards.dealt(rows, items.shards, items.n, ["key", "v"]).mapInArrow(best_of(k, places), "key long, item_id long, score double")
    by = [F.desc("score"), F.asc("item_id")]
    part = F.row_number().over(Window.partitionBy("key", F.pmod(F.xxhash64("item_id"), F.lit(SALTS))).orderBy(*by))
    place = F.row_number().over(Window.partitionBy("key").orderBy(*by))
    found = found.withColumn("_rn", part).filter(F.col("_rn") <= k).drop("_rn").withColumn("rn", place.cast("long"))
    return found.filter(F.col("rn") <= k).withColumnRenamed("key", key)


def _above(places: int) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, part, scores in _scored(batches, places):
            hidden = part.column("hidden")
            row = np.repeat(np.arange(part.num_rows), pc.list_value_length(hidden).fill_null(0).to_numpy())
            for who, ids in ((row, hidden.flatten().to_numpy()), (np.arange(part.num_rows), part.column("target").to_numpy())):
                scores[_at(shard["ids"], ids, who)] = -np.inf
            count = (scores > part.column("sim").to_numpy()[:, None]).sum(1)
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("form"), pa.array(count)], ["key", "form", "above"])

    return run


def dot(a: Column, b: Column, places: int) -> Column:
    return F.round(F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x), places)


def masks(masked: DataFrame | None, key: str) -> DataFrame | None:
    """key and hidden, a list of the ids that are left out for it."""
    return None if masked is None else masked.groupBy(F.col(key).cast("long").alias("key")).agg(F.collect_set(F.col("item_id").cast("long")).alias("hidden"))


def _ranked(rows: DataFrame, own: DataFrame, items: Vectors, hidden: DataFrame | None, places: int) -> DataFrame:
    """key, form, target, sim, rank, known of query rows (key, form, target, v); own: item_id, v of the items."""
    aims = rows.join(own.select(F.col("item_id").cast("long").alias("target"), F.col("v").cast("array<double>").alias("_v")), "target", "left")
    aims = aims.select("key", "form", "target", "v", dot(F.col("v"), F.col("_v"), places).alias("sim"), F.col("_v").isNotNull().alias("known"))
    aims = aims.join(hidden, "key", "left") if hidden is not None else aims.withColumn("hidden", F.lit(None).cast("array<long>"))
    aims = written(aims, "aims")
    columns = ["key", "form", "target", "v", "sim", "hidden"]
    counts = shards.dealt(aims.filter("known and v is not null").select(columns), items.shards, items.n, columns).mapInArrow(_above(places), "key long, form int, above long")
    sums = counts.groupBy("key", "form").agg(F.sum("above").alias("above"))
    rank = F.when(F.col("known"), 1 + F.coalesce("above", F.lit(0))).otherwise(F.lit(items.items + 1))
    return aims.join(sums, ["key", "form"], "left").select("key", "form", "target", F.when(F.col("known"), F.col("sim")).otherwise(0.0).alias("sim"), rank.alias("rank"), "known")


def ranks(queries: DataFrame, items: DataFrame, key: str, target: str, masked: DataFrame | None = None, *, packed: Vectors | None = None, places: int = 6, block: int = 0) -> DataFrame:
    """key, target, sim, rank (1 and the number of higher scores), known: of each query's target.

    queries: key (unique, a whole number), target, v; items: item_id, v. masked: key, item_id of items left
    out for a query, never its target. A target that isn't among the items has similarity 0 and the rank
    after all of them.
    """
    rows = queries.select(F.col(key).cast("long").alias("key"), F.lit(0).alias("form"), F.col(target).cast("long").alias("target"), F.col("v").cast("array<double>").alias("v"))
    found = _ranked(rows, items, packed or vectors(items, block=block), masks(masked, key), places)
    return found.select(F.col("key").alias(key), F.col("target").alias(target), "sim", "rank", "known")


def gains(queries: DataFrame, items: DataFrame, key: str, target: str, base: str, reasoned: str, masked: DataFrame | None = None, *, cutoff: int = 100, packed: Vectors | None = None, places: int = 6, block: int = 0) -> DataFrame:
    """Baseline and reasoned vectors of each query against the items in one pass.

    key, target, known, and for either form sim, rank and ndcg (baseline_sim, cot_sim and so on), cot_gain
    (the difference in NDCG) and sim_gain. Unknown targets have rank n + 1 and no gain.
    """
    forms = F.explode(F.array(*[F.struct(F.lit(k).alias("form"), F.col(c).cast("array<double>").alias("v")) for k, c in enumerate((base, reasoned))]))
    rows = queries.select(F.col(key).cast("long").alias("key"), F.col(target).cast("long").alias("target"), forms.alias("_f")).select("key", "_f.form", "target", "_f.v")
    found = _ranked(rows, items, packed or vectors(items, block=block), masks(masked, key), places)
    found = found.withColumn("ndcg", F.when(F.col("known"), ndcg(F.col("rank"), cutoff)).otherwise(0.0))
    of = lambda c, k: F.max(F.when(F.col("form") == k, F.col(c)))
    wide = found.groupBy("key", "target", "known").agg(*[of(c, k).alias(f"{name}_{c}") for k, name in enumerate(("baseline", "cot")) for c in ("sim", "rank", "ndcg")])
    return wide.withColumns({"cot_gain": F.col("cot_ndcg") - F.col("baseline_ndcg"), "sim_gain": F.col("cot_sim") - F.col("baseline_sim")}).withColumnsRenamed({"key": key, "target": target})


def contrastive_loss(queries: DataFrame, items: Vectors, key: str, label: str, temperature: float, *, places: int = 6) -> DataFrame:
    """key and -log of the positive's share: the positive is the best other item of the same label.

    items: packed with their label. A shard gives the best of the query's label and the sum of
    exp(score / temperature) less the largest exponent, so sums don't overflow.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, part, scores in _scored(batches, places):
            keys = part.column("key").to_numpy()
            scores[_at(shard["ids"], keys, np.arange(len(keys)))] = -np.inf
            top_ = scores.max(1)
            shift = np.where(np.isfinite(top_), top_, 0.0)
            best = np.where(part.column("label").to_numpy()[:, None] == shard["labels"][None, :], scores, -np.inf).max(1)
            total = np.exp((scores - shift[:, None]) / temperature).sum(1)
            some = np.isfinite(top_)
            yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (keys, best, top_, total)], ["key", "best", "top", "total"])

    rows = queries.select(F.col(key).cast("long").alias("key"), F.xxhash64(label).alias("label"), F.col("v").cast("array<double>").alias("v"))
    out = shards.dealt(rows, items.shards, items.n, ["key", "label", "v"]).mapInArrow(sums, "key long, best double, top double, total double")
    whole = out.withColumn("_t", F.max("top").over(Window.partitionBy("key"))).groupBy("key", "_t").agg(F.max("best").alias("best"), F.sum(F.col("total") * F.exp((F.col("top") - F.col("_t")) / temperature)).alias("total"))
    return whole.filter(F.col("best") > float("-inf")).select(F.col("key").alias(key), (F.log("total") + (F.col("_t") - F.col("best")) / temperature).alias("loss"))
