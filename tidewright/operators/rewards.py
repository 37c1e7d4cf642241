"""Rewards of completions worked out from texts or vectors: quality, baseline, gain and gate in joins.

A completion's row has its history and target; what isn't given is computed. The baseline belongs to
the history and the target alone, so it is computed once for each distinct pair and joined by their
hash, however many completions share it. Rewards are those of `functions.rewards`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions import rewards as R
from tidewright.functions.rubric import ndcg
from tidewright.functions.text import with_reasoning
from tidewright.operators import dense, postings
from tidewright.sources.tables import written


def _scored(rows: DataFrame, key: str, scorer: str, history: str, completion: str, judged: str | None, fallback: bool) -> DataFrame:
    """Adds quality and source to rows."""
    q = R.quality(scorer, F.col(history), F.col(completion), F.col(judged) if judged else None, fallback)
    return rows.withColumn("_q", q).withColumns({"quality": F.col("_q.score"), "source": F.col("_q.source")}).drop("_q")


def lexical_rewards(rows: DataFrame, *, key: str, history: str, completion: str, target: str, given: str | None = None, judged: str | None = None, scorer: str = "rules", fallback: bool = True, **gate) -> DataFrame:
    """key, quality, source, baseline, similarity (with the reasoning appended) and reward of each row.

    target is the target's text; a baseline that is given counts, a missing one is the cosine of history
    and target. key is unique. Null texts are empty ones; empty targets have the penalty.
    """
    pair = F.xxhash64(F.coalesce(history, F.lit("")), F.coalesce(target, F.lit("")))
    own = rows.withColumn("_pair", pair).withColumn("_given", F.col(given).cast("double") if given else F.lit(None).cast("double"))
    own = _scored(own, key, scorer, history, completion, judged, fallback)
    told = F.coalesce(F.col(target), F.lit(""))
    now = postings.row_cosines(own.select(key, "_pair", "_given", "quality", "source", (told != "").alias("_told"), with_reasoning(F.coalesce(history, F.lit("")), F.coalesce(completion, F.lit(""))).alias("_a"), told.alias("_b")), "_a", "_b", "similarity")
    missing = own.filter("_given is null").groupBy("_pair").agg(F.first(F.coalesce(history, F.lit(""))).alias("_a"), F.first(told).alias("_b"))
    fresh = postings.row_cosines(missing, "_a", "_b", "_fresh")
    both = written(now, "similarities").join(fresh, "_pair", "left")
    reward = R.lexical_reward(F.col("quality"), F.col("_given"), F.col("_fresh"), F.col("similarity"), F.when(F.col("_told"), "told").otherwise(""), **gate)
    return both.select(key, "quality", "source", F.coalesce("_given", "_fresh").alias("baseline"), "similarity", reward.alias("reward"))


def ranked_rewards(rows: DataFrame, found: postings.Catalogue, *, key: str, history: str, completion: str, target_id: str, target: str, hidden: str | None = None, given: str | None = None, judged: str | None = None, scorer: str = "rules", fallback: bool = True, cutoff: int = 100, **gate) -> DataFrame:
    """key, quality, source, baseline_ndcg, cot_rank, cot_ndcg and reward: the gain in NDCG of the target's rank over the catalogue.

    hidden: an array of item ids left out (with the pad item 0, and never the target). The baseline is
    ranked once for each distinct history, target and mask where none is given. key is a unique whole
    number; targets that are unknown gain nothing, rows without a target's id or text have the penalty.
    """
    mask = F.array_sort(F.array_distinct(F.concat(F.coalesce(F.col(hidden).cast("array<long>"), F.array().cast("array<long>")), F.array(F.lit(0).cast("long"))))) if hidden else F.array(F.lit(0).cast("long"))
    text = F.coalesce(history, F.lit(""))
    own = rows.withColumns({"_text": text, "_target": F.col(target_id).cast("long"), "_mask": mask, "_given": F.col(given).cast("double") if given else F.lit(None).cast("double")})
    own = own.withColumn("_pair", F.xxhash64("_text", "_target", "_mask"))
    own = _scored(own, key, scorer, history, completion, judged, fallback)
    own = written(own.select(F.col(key).cast("long").alias("key"), "_pair", "_text", "_target", "_mask", "_given", "quality", "source", F.coalesce(F.col(target), F.lit("")).alias("_told"), F.col(completion).alias("_cot")), "completions")
    missing = own.filter("_given is null").groupBy("_pair").agg(*[F.first(c).alias(c) for c in ("_text", "_target", "_mask")]).withColumnRenamed("_pair", "key")

    def ndcgs(queries: DataFrame, said: Column) -> DataFrame:
        masked = queries.select("key", F.explode("_mask").alias("item_id"))
        ranks = postings.ranks(queries.select("key", said.alias("text"), "_target"), found, "key", "_target", masked)
        return ranks.select("key", F.when(F.col("known"), ndcg(F.col("rank_strict"), cutoff)).otherwise(0.0).alias("ndcg"), F.col("rank_strict").alias("rank"))

    base = ndcgs(missing, F.col("_text")).select(F.col("key").alias("_pair"), F.col("ndcg").alias("_fresh"))
    now = ndcgs(own, with_reasoning(F.col("_text"), F.coalesce("_cot", F.lit("")))).select("key", F.col("ndcg").alias("cot_ndcg"), F.col("rank").alias("cot_rank"))
    both = own.select("key", "_pair", "_target", "_told", "_given", "quality", "source").join(now, "key").join(base, "_pair", "left").withColumn("baseline_ndcg", F.coalesce("_given", "_fresh"))
    reward = R.ndcg_reward(F.col("quality"), F.col("baseline_ndcg"), F.col("cot_ndcg"), F.col("_target"), F.col("_told"), **gate)
    return both.select(F.col("key").alias(key), "quality", "source", "baseline_ndcg", "cot_rank", "cot_ndcg", reward.alias("reward"))


def dense_rewards(rows: DataFrame, *, key: str, base: str, reasoned: str, target: str, told: str, quality: str, given: str, given_by: str, embedder: str, places: int = 6, **gate) -> DataFrame:
    """key, quality, baseline, similarity and reward from vectors of unit length of the history, of it with the reasoning, and of the target.

    A baseline that is missing, or that another embedder gave, is computed anew.
    """
    fresh, now = dense.dot(F.col(base), F.col(target), places), dense.dot(F.col(reasoned), F.col(target), places)
    own = rows.withColumns({"_fresh": fresh, "similarity": now})
    used = F.when(F.col(given).isNull() | ~F.coalesce(F.col(given_by) == embedder, F.lit(False)), F.col("_fresh")).otherwise(F.col(given))
    reward = R.dense_reward(F.col(quality), F.col(given), F.col(given_by), F.col("_fresh"), F.col("similarity"), F.col(told), embedder, **gate)
    return own.select(key, F.col(quality).alias("quality"), used.alias("baseline"), "similarity", reward.alias("reward"))


def advantages(rows: DataFrame, group: str, reward: str = "reward") -> DataFrame:
    """Adds advantage: the reward less its group's mean, by the group's standard deviation; null where all are equal."""
    w = Window.partitionBy(group)
    return rows.withColumn("advantage", (F.col(reward) - F.avg(reward).over(w)) / F.nullif(F.stddev_samp(reward).over(w), F.lit(0.0)))
