"""Ranking of whole catalogues by words and by vectors, and its metrics.

Ranks are counts of better items; no row is made for a query and an item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.rubric import ndcg
from tidewright.operators import dense, order, postings
from tidewright.sources.tables import written


def lexical_ranks(queries: DataFrame, items: DataFrame | postings.Catalogue, key: str, target: str, masked: DataFrame | None = None, *, total: bool = False) -> DataFrame:
    """key, target, sim, known and rank_strict of each query's target, see `postings.ranks`.

    items: item_id and text, or a catalogue that is packed once for several rankings.
    """
    found = items if isinstance(items, postings.Catalogue) else postings.catalogue(items)
    return postings.ranks(queries, found, key, target, masked, total=total)


def total_ranks(strict: DataFrame, queries: DataFrame, items: DataFrame | postings.Catalogue, key: str, target: str) -> DataFrame:
    """Adds rank_total to strict ranks: equal scores of larger ids also come before the target."""
    return strict.join(lexical_ranks(queries, items, key, target, total=True).select(key, "rank_total"), key)


def numbered(rows: DataFrame, key: str, name: str, buckets: int = 4096) -> DataFrame:
    """Adds the place from 0 by ascending key, a whole number, without sorting all in one task.

    Keys are put into ranges of equal counts about (by approximate quantiles), so sparse keys don't make many ranges.
    """
    n = max(1, min(buckets, rows.count() // 1000))
    edges = [x for x in (rows.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 10_000)).first()[0] if n > 1 else []) or []]
    own = rows.withColumn("_bucket", F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < F.col(key))) if edges else F.lit(0))
    sizes = own.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = sizes.select("_bucket", (F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n")).alias("_base"))  # at most one row a bucket
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy(key)) - 1
    return own.withColumn("_place", place).join(F.broadcast(before), "_bucket").withColumn(name, F.col("_base") + F.col("_place")).drop("_bucket", "_base", "_place")


def _metrics(rank: str, cutoffs: tuple[int, ...]) -> list[Column]:
    r = F.col(rank)
    cols = [F.count("*").alias("n")]
    for k in cutoffs:
        cols.append(F.round(F.coalesce(F.avg((r <= k).cast("double")), F.lit(0.0)), 6).alias(f"hr_{k}"))
        cols.append(F.round(F.coalesce(F.avg(ndcg(r, k)), F.lit(0.0)), 6).alias(f"ndcg_{k}"))
    return [*cols, F.round(F.coalesce(F.avg(r), F.lit(0.0)), 6).alias("mean_rank")]


def metrics(ranks: DataFrame, rank: str, cutoffs: tuple[int, ...]) -> DataFrame:
    """n, HR and NDCG at the cutoffs, mean rank and upper median; zeros for an empty input."""
    own = written(ranks.select(rank), "ranks")
    return own.agg(*_metrics(rank, cutoffs), F.lit(order.upper_median(own, F.col(rank))).cast("long").alias("median_rank"))


def metrics_by(ranks: DataFrame, groups: list[str], rank: str, cutoffs: tuple[int, ...]) -> DataFrame:
    """The metrics of each group, without medians."""
    return ranks.groupBy(*groups).agg(*_metrics(rank, cutoffs))


def compared(metrics_of: dict[str, DataFrame]) -> DataFrame:
    """One row of two runs' metrics and their differences: `<name>_<run>` and `delta_<name>` (second less first)."""
    (a, first), (b, second) = metrics_of.items()
    own = first.select(*[F.col(c).alias(f"{c}_{a}") for c in first.columns]).join(F.broadcast(second.select(*[F.col(c).alias(f"{c}_{b}") for c in second.columns])))
    return own.select("*", *[(F.col(f"{c}_{b}") - F.col(f"{c}_{a}")).alias(f"delta_{c}") for c in first.columns])


def pair_cosines(rows: DataFrame, key: str, left: str, right: str, name: str) -> DataFrame:
    """key and the cosine of two texts of the same row (0 if one has no word)."""
    return postings.row_cosines(rows.select(key, left, right), left, right, name)


def dense_top(queries: DataFrame, items: DataFrame, key: str, k: int, *, places: int = 6, block: int = 0) -> DataFrame:
    """key, item_id, score, rn: the k best items of each query but itself, see `dense.top`."""
    return dense.top(queries, dense.vectors(items, block=block), key, k, places=places)


def pool_size(pool: int, negatives: int, items: int) -> int:
    """How many items the search for negatives looks at."""
    return min(max(pool, negatives + 1), items)


def first_allowed(pool: DataFrame, key: str, k: int, *also: str) -> DataFrame:
    """key and the first k items of a pool (with rn) that is left after exclusions, as an array in their order."""
    place = F.row_number().over(Window.partitionBy(key).orderBy("rn"))
    own = pool.withColumn("_k", place).filter(F.col("_k") <= k)
    return own.groupBy(key, *also).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "item_id"))), lambda x: x["item_id"]).alias("negatives"))


def contrastive_loss(queries: DataFrame, items: DataFrame, key: str, label: str, item_label: str, temperature: float, *, places: int = 6, block: int = 0) -> DataFrame:
    """key and the loss of each query against all other items, see `dense.contrastive_loss`."""
    return dense.contrastive_loss(queries, dense.vectors(items, label=item_label, block=block), key, label, temperature, places=places)


def thirds(rows: DataFrame, value: str, key: str) -> DataFrame:
    """Adds cohort (1 to 3): thirds of the rows by value, ties by key, see `order.parts`."""
    return order.parts(rows, value, key, 3, "cohort")


def dense_ranks(queries: DataFrame, items: DataFrame, key: str, target: str, masked: DataFrame | None = None, *, places: int = 6, block: int = 0) -> DataFrame:
    """key, target, sim, rank, known of each query's target, see `dense.ranks`."""
    return dense.ranks(queries, items, key, target, masked, places=places, block=block)
