"""Rewards of reasoning texts as column expressions: quality by scorer, gated gains, their ablations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewright.functions.convert import above_zero
from tidewright.functions.rubric import rule_score

#: The gate's defaults and the scorers' names.
LEAST, PENALTY = 0.45, -0.05
SCORERS = {"api": ("api", "llm", "judge", "llm_judge"), "rules": ("rules", "rule", "local", "proxy"), "classifier": ("classifier", "clf", "rubric_classifier")}


def quality(scorer: str, history: Column, reasoning: Column, judged: Column | None = None, fallback: bool = True) -> Column:
    """Struct of score and source: the judge's normalised score, else that of the rules.

    judged is the column that a judge has filled (see `providers`). Without a fallback a missing one raises;
    a classifier isn't built.
    """
    kind = next((k for k, names in SCORERS.items() if scorer.strip().lower() in names), None)
    if kind is None:
        raise ValueError(f"unknown scorer: {scorer}")
    if kind == "classifier":
        raise NotImplementedError("a classifier for rubric scores is reserved and not built")
    rules = rule_score(history, reasoning)["score_norm"]
    if kind == "rules":
        return F.struct(rules.alias("score"), F.lit("rules").alias("source"))
    if judged is None:
        raise ValueError("the scorer api needs the judge's column")
    rest = F.struct(rules.alias("score"), F.lit("fallback_rules").alias("source")) if fallback else F.raise_error(F.lit("the judge gave no score")).cast("struct<score:double,source:string>")
    return F.when(judged.isNotNull(), F.struct(judged.cast("double").alias("score"), F.lit("api_success").alias("source"))).otherwise(rest)


def gated(score: Column, gain: Column, known: Column, *, least: float = LEAST, penalty: float = PENALTY) -> Column:
    """score x gain where the score suffices, the target is known and the gain is above 0; else the penalty."""
    return F.when(F.coalesce((score >= least) & known & above_zero(gain), F.lit(False)), score * gain).otherwise(F.lit(penalty))


def ndcg_reward(score: Column, baseline: Column, with_reasoning: Column, target_id: Column, target_text: Column, **how) -> Column:
    """The gain in NDCG; without a target's id or text, the penalty."""
    return gated(score, with_reasoning - baseline, target_id.isNotNull() & (F.coalesce(target_text, F.lit("")) != ""), **how)


def dense_reward(score: Column, given: Column, given_by: Column, computed: Column, with_reasoning: Column, target_text: Column, embedder: str, **how) -> Column:
    """The gain in dense similarity; a baseline that is missing or of another embedder is computed anew."""
    base = F.when(given.isNull() | ~F.coalesce(given_by == embedder, F.lit(False)), computed).otherwise(given)
    return gated(score, with_reasoning - base, F.coalesce(target_text, F.lit("")) != "", **how)


def lexical_reward(score: Column, given: Column, computed: Column, with_reasoning: Column, target_text: Column, **how) -> Column:
    """The gain in lexical similarity; a baseline that is given counts, whatever made it."""
    return gated(score, with_reasoning - F.coalesce(given, computed), F.coalesce(target_text, F.lit("")) != "", **how)


def ablations(score: Column, gain: Column, share: float = 0.5) -> dict[str, Column]:
    """The four settings that are compared: gain alone, rubric alone, their weighted sum, the gate."""
    return {"gain": gain, "rubric": score, "sum": score * share + gain * (1 - share), "gated": gated(score, gain, F.lit(True))}
