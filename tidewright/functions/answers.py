"""What a text maker sends back, made clean: reasoning, answers and summaries, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewright.functions.text import BLOCK, LABEL, answer_of, canonical_tags, compact, first_words, inside_answer, let, runs, strip, without_marks

#: Labels before summaries, and signs of reasoning in them.
FINAL_LABEL = r"(?i)^(?:final answer|answer)\s*[:：]\s*"
SUMMARY_LABEL = r"(?i)^(?:summary|description_summary|answer)\s*[:：]\s*"
FENCES = r"(?is)^```(?:json|text)?\s*|\s*```$"
REASONING_STARTS = ("think ", "<think", "okay ", "we need ", "let's ", "let us ")
REASONING_SIGNS = ("the user wants", "provided fields")


def recommendation_of(x: Column) -> Column:
    """Text after the last reasoning block; without one, in the last answer tag; else all. A label goes in any case."""

    def of(own: Column) -> Column:
        after = F.regexp_replace(own, f"(?is)^.*{BLOCK}", "")
        kept = F.when(own.rlike(f"(?is){BLOCK}"), after).when(own.rlike("(?i)<answer>"), inside_answer(own)).otherwise(own)
        return strip(F.regexp_replace(without_marks(F.regexp_replace(kept, f"(?is){BLOCK}", "")), LABEL, ""))

    return let(canonical_tags(x), of)


def think_of(x: Column) -> Column:
    """The first reasoning block's text."""
    return without_marks(F.regexp_extract(canonical_tags(x), r"(?is)<\s*think\s*>(.*?)<\s*/\s*think\s*>", 1))


def tagged(think: Column, answer: Column) -> Column:
    """A reasoning and an answer block."""
    return F.concat(F.lit("<think>\n"), strip(think), F.lit("\n</think>\n<answer>\n"), strip(answer), F.lit("\n</answer>"))


def generated(raw: Column) -> Column:
    """Struct of think, answer and cot (both tagged, the answer alone tagged, or what is left of the text)."""

    def of(s: Column) -> Column:
        cot = F.when((s["think"] != "") & (s["answer"] != ""), tagged(s["think"], s["answer"])).when(s["answer"] != "", F.concat(F.lit("<answer>\n"), s["answer"], F.lit("\n</answer>"))).otherwise(s["bare"])
        return F.struct(s["think"].alias("think"), F.when(s["answer"] != "", s["answer"]).otherwise(s["bare"]).alias("answer"), cot.alias("cot"))

    return let(F.struct(think_of(raw).alias("think"), answer_of(raw).alias("answer"), without_marks(raw).alias("bare")), of)


def candidate(key: Column, raw: Column, model: str, mode: str, temperature: float) -> Column:
    """A raw output as the first candidate of its example, with the sizes of its parts."""
    return let(
        generated(raw),
        lambda g: F.struct(
            key.alias("example_id"), F.concat(key, F.lit("-0")).alias("candidate_id"), F.lit(0).alias("candidate_index"), F.lit(temperature).alias("temperature"), g["think"].alias("think"), g["answer"].alias("answer"), g["cot"].alias("cot"),
            F.lit(model).alias("generator_model"), F.lit(mode).alias("generation_mode"), F.struct(F.length(F.coalesce(raw, F.lit(""))).alias("raw_output_chars"), F.length(g["answer"]).alias("answer_chars"), F.length(g["think"]).alias("think_chars")).alias("generation_meta"),
        ),
    )


def clean_generation(x: Column) -> Column:
    """Without fences, label and matching outer quotation marks; white space collapsed."""
    own = strip(F.regexp_replace(strip(F.regexp_replace(strip(x), FENCES, "")), SUMMARY_LABEL, ""))
    bare = let(own, lambda t: F.when((F.length(t) >= 2) & (F.left(t, F.lit(1)) == F.right(t, F.lit(1))) & F.left(t, F.lit(1)).isin('"', "'"), F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(t))
    return compact(bare)


def looks_like_reasoning(x: Column) -> Column:
    """Whether a summary is rather a model thinking aloud."""

    def of(low: Column) -> Column:
        found = F.lit(False)
        for sign in REASONING_STARTS:
            found = found | low.startswith(sign)
        for sign in REASONING_SIGNS:
            found = found | F.left(low, F.lit(200)).contains(sign)
        return found

    return let(F.lower(clean_generation(x)), of)


def cut_words(x: Column, n: int) -> Column:
    """White space collapsed; over n words, the first n."""
    return F.when((F.size(runs(x)) <= n) | F.lit(n <= 0), compact(x)).otherwise(first_words(x, n)) if n > 0 else compact(x)


def summary_of(raw: Column, words: int) -> Column:
    """The answer of a raw output as a summary of so many words at most; empty if it is reasoning."""
    own = strip(F.regexp_replace(clean_generation(answer_of(raw)), FINAL_LABEL, ""))
    return let(own, lambda t: F.when(looks_like_reasoning(t), "").otherwise(cut_words(t, words)))


def mock_output(index: Column, title: Column) -> Column:
    """A text maker's stand-in: a fixed text in which the target's title is masked."""
    own = F.concat(F.lit(MOCK_THINK + "\nCandidate "), index.cast("string"), F.lit(MOCK_ANSWER))
    shown = F.coalesce(title, F.lit("the held-out positive item"))
    return F.when(shown == "", own).otherwise(F.replace(own, shown, F.lit("the held-out item")))


#: The stand-in's text around the candidate's number.
MOCK_THINK = """<think>
The user's high-rated history should be separated from low-rated counterexamples. Recurring positive signals indicate stable genre, tone, and era preferences, while lower ratings help avoid mismatched recommendations. These patterns can generalize to unseen items with similar narrative and stylistic cues without naming the target.
</think>
<answer>"""
MOCK_ANSWER = """: recommend items sharing the user's repeated positive cues, and avoid weakly supported styles; evaluation target is hidden during generation.
</answer>"""


def history_of(text: Column) -> Column:
    """The part of a prompt between its interaction tags, or all of it; white space collapsed."""
    own = strip(text)
    inside = r"(?s)<Historical Interactions>\s*(.*?)\s*</Historical Interactions>"
    return let(own, lambda t: compact(F.when(t.rlike(inside), F.regexp_extract(t, inside, 1)).otherwise(t)))


def first_user(messages: Column) -> Column:
    """The content of the first message of a user; empty without one."""
    return F.coalesce(F.try_element_at(F.filter(messages, lambda m: m["role"] == "user"), F.lit(1))["content"], F.lit(""))
