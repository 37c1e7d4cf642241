"""Selection of scored rows, and statistics of scores."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.operators import order
from tidewright.sources.tables import written


def clean(x: Column) -> Column:
    """A finite number, or null."""
    v = x.cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v)


def selection_score(rubric: Column, gain: Column) -> Column:
    return F.coalesce(clean(rubric), F.lit(0.0)) * F.greatest(F.coalesce(clean(gain), F.lit(0.0)), F.lit(0.0))


def _passes(min_rubric: float, min_gain: float) -> Column:
    """Missing, infinite and undefined values pass no threshold."""
    return F.coalesce((clean(F.col("rubric")) >= min_rubric) & (clean(F.col("gain")) >= min_gain), F.lit(False))


def top_k(rows: DataFrame, group: str, k: int, min_rubric: float, min_gain: float, position: str, fallback: bool) -> DataFrame:
    """Adds selection_score, selection_rank, selected and fallback_selected.

    Ranks cover failing rows; the first k passing rows of a group are kept, or its first row where
    none passes and fallback is on. Values that aren't finite numbers count as missing: they come last.
    """
    order = [F.desc("selection_score"), F.desc(clean(F.col("rubric"))), F.desc(clean(F.col("gain"))), F.asc(position)]
    w = Window.partitionBy(group)
    scored = rows.withColumn("selection_score", selection_score(F.col("rubric"), F.col("gain"))).withColumn("_ok", _passes(min_rubric, min_gain))
    ranked = scored.withColumns({"selection_rank": F.row_number().over(w.orderBy(*order)), "_passed": F.sum(F.col("_ok").cast("int")).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)), "_any": F.max(F.col("_ok").cast("int")).over(w)})
    fall = (F.col("_any") == 0) & (F.col("selection_rank") == 1) & F.lit(fallback and k > 0)
    return ranked.withColumn("fallback_selected", fall).withColumn("selected", fall | (F.col("_ok") & (F.col("_passed") <= k))).drop("_ok", "_passed", "_any")


def top_share(rows: DataFrame, share: float, min_rubric: float, min_gain: float, position: str, last: str | None = None) -> DataFrame:
    """The best ceil(n * share) of the n passing rows, by a distributed sort and limit; last: one more key of the order."""
    ok = rows.withColumn("selection_score", selection_score(F.col("rubric"), F.col("gain"))).filter(_passes(min_rubric, min_gain))
    more = [F.desc(last)] if last else []
    return ok.orderBy(F.desc("selection_score"), F.desc("rubric"), F.desc("gain"), *more, F.asc(position)).limit(ceil(ok.count() * share))


def ranked_share(rows: DataFrame, share: float, min_rubric: float, min_gain: float, position: str, last: str | None = None) -> DataFrame:
    """As top_share, with selection_rank: places in the kept rows' order (their number is a share of all, so ranks come from ranges)."""
    kept = top_share(rows, share, min_rubric, min_gain, position, last)
    place = F.struct((-F.col("selection_score")).alias("a"), (-clean(F.col("rubric"))).alias("b"), (-clean(F.col("gain"))).alias("c"), *([(-F.col(last)).alias("d")] if last else []), F.col(position).alias("e"))
    ranged = kept.withColumn("_p", place).repartitionByRange("_p").withColumn("_part", F.spark_partition_id()).sortWithinPartitions("_p")
    ranged = ranged.withColumn("_at", F.monotonically_increasing_id() - F.shiftleft(F.col("_part").cast("long"), 33))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # one row for each partition
    return ranged.join(F.broadcast(before), "_part").withColumn("selection_rank", (F.col("_before") + F.col("_at") + 1).cast("int")).drop("_p", "_part", "_at", "_before")


def final_gain(rows: DataFrame, gain: str, least: float) -> DataFrame:
    """Rows whose gain is a finite number of at least so much."""
    return rows.filter(clean(F.col(gain)) >= least)


def _told(found: list[float | None], names: list[str], places: int) -> list[Column]:
    return [F.round(F.lit(x).cast("double"), places).alias(n) for x, n in zip(found, names, strict=True)]


def numeric_stats(rows: DataFrame, value: str) -> DataFrame:
    """One row: count, min, max, mean, p50, p90, p95, p99 (interpolated), to two places; nulls but for the count of an empty input."""
    v, own = F.col(value), written(rows.select(value), "values")
    at = _told(order.quantiles(own, v, [0.5, 0.9, 0.95, 0.99]), ["p50", "p90", "p95", "p99"], 2)
    return own.agg(F.count(v).alias("count"), F.min(v).alias("min"), F.max(v).alias("max"), F.round(F.avg(v), 2).alias("mean"), *at)


def rank_stats(rows: DataFrame, rank: str) -> DataFrame:
    """One row: count, mean to two places, min, max and the upper median, of the ranks that aren't null."""
    r, own = F.col(rank), written(rows.select(rank), "ranks")
    return own.agg(F.count(r).alias("count"), F.round(F.avg(r), 2).alias("mean"), F.min(r).alias("min"), F.max(r).alias("max"), F.lit(order.upper_median(own, r)).cast("long").alias("p50"))


def summary(rows: DataFrame, value: str) -> DataFrame:
    own = written(rows.select(clean(F.col(value)).alias("v")), "values")
    v = F.col("v")
    at = _told(order.quantiles(own, v, [0.5, 0.05, 0.25, 0.75, 0.95]), ["median", "p05", "p25", "p75", "p95"], 6)
    return own.agg(F.count("*").alias("n"), F.count(v).alias("n_value"), F.count_if(v < 0).alias("n_negative"), F.round(F.min(v), 6).alias("min"), F.round(F.max(v), 6).alias("max"), F.round(F.avg(v), 6).alias("mean"), *at)


def histogram(rows: DataFrame, value: str, bins: int) -> DataFrame:
    """bin, lo, hi, n for all bins; the last is closed; a constant input is widened."""
    edge = rows.agg(F.min(value).alias("a"), F.max(value).alias("b"))
    pad = F.greatest(F.abs("a") * 0.1, F.lit(1e-6))
    edge = edge.select(F.when(F.col("a") == F.col("b"), F.col("a") - pad).otherwise(F.col("a")).alias("a"), F.when(F.col("a") == F.col("b"), F.col("b") + pad).otherwise(F.col("b")).alias("b"))
    found = rows.filter(F.col(value).isNotNull()).crossJoin(F.broadcast(edge)).select(F.least(F.floor((F.col(value) - F.col("a")) / ((F.col("b") - F.col("a")) / bins)), F.lit(bins - 1)).cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    width = (F.col("b") - F.col("a")) / bins
    return edge.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "a", width.alias("w")).join(found, "bin", "left").select("bin", F.round(F.col("a") + F.col("bin") * F.col("w"), 6).alias("lo"), F.coalesce("n", F.lit(0)).alias("n"))
