"""Chat messages for text makers, judges and summaries, as arrays of (role, content)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewright.functions.items import category_names, details_text, text_list
from tidewright.functions.text import compact, strip

#: The prompts' texts.
MAKER = "You are a recommendation master capable of deeply analyzing user preferences based on their historical interactions."
TASK = """Please infer the user's explicit and latent preferences internally based on their historical behavior,
and predict the next {} the user is likely to be interested in purchasing.

Use concise internal reasoning that integrates these four aspects: history-grounded evidence, specific taste signals, preference transition, discriminative cues.

For the visible final response, output only the feature description of the next likely interested item.
Do not include any explanation, evidence, or phrases like "Based on the user's history"."""
JUDGE = "You score recommendation reasoning. Do not reason, explain, or comment. Return one compact JSON object only."
JUDGE_RULES = """Rules:
- Score reasoning quality and consistency with user history.
- Held-out target is only for leakage or severe contradiction checks; do not score by target similarity.
- Penalize direct target leakage if the candidate names the held-out title, artist, ASIN, or exact item identity.
- Dimension meanings: preference_grounding=evidence from history; taste_specificity=concrete genres/styles/features; transitional_reasoning=clear shift from history to next interest; discriminative_framing=prefer/avoid boundary; conciseness=compact and information-dense.
- Output JSON only. No prose, markdown, chain-of-thought, explanation, or comment.

Return one JSON object only:
{
  "preference_grounding": 1,
  "taste_specificity": 1,
  "transitional_reasoning": 1,
  "discriminative_framing": 1,
  "conciseness": 1
}
"""
JUDGE_TARGET = "Held-out positive item for evaluation only. Penalize direct leakage if the candidate appears to know it:\n"
SUMMARISER = "You summarize Amazon CDs/Vinyl item descriptions for recommendation prompts. Use only the provided fields. Do not use outside knowledge. Do not invent artist, genre, release year, awards, or style."
SUMMARY_TASK = """Write a factual summary of only the Description field in <= {} words.
Use Title, Store/artist/format, Categories, and Details only to resolve references already present in Description.
If Description is empty, return an empty string.
You may reason internally, but put the final summary inside <answer>...</answer>.
Do not put reasoning, JSON, bullets, quotes, or explanations inside <answer>.

"""


def messages(**texts: Column | str) -> Column:
    """An array of (role, content), in the order given."""
    return F.array(*[F.struct(F.lit(role).alias("role"), (F.lit(text) if isinstance(text, str) else text).alias("content")) for role, text in texts.items()])


def user_prompt(history: Column, category: Column) -> Column:
    before, after = TASK.split("{}")
    names = category_names(category)
    return F.concat(
        F.lit("The following are the items the user has interacted with:\n<Historical Interactions>\n"), strip(history), F.lit("\n</Historical Interactions>\n\nCategory: "), names["plural"], F.lit(f".\n\n{before}"), names["singular"], F.lit(after),
    )


def maker_messages(history: Column, category: Column) -> Column:
    return messages(system=MAKER, user=user_prompt(history, category))


def target_block(title: Column, text: Column, shown: bool = True) -> Column:
    """The held-out item as a judge may see it; empty if it mustn't."""
    return strip(F.concat(F.lit("Target title: "), F.coalesce(title, F.lit("")), F.lit("\nTarget item text: "), F.coalesce(text, F.lit("")))) if shown else F.lit("")


def judge_messages(history: Column, reasoning: Column, target: Column | None = None) -> Column:
    """The target's block stands only where it isn't empty."""
    block = F.lit("") if target is None else F.when(F.coalesce(target, F.lit("")) == "", "").otherwise(F.concat(F.lit(JUDGE_TARGET), target, F.lit("\n\n")))
    return messages(
        system=JUDGE, user=F.concat(F.lit("Score the candidate on five dimensions. Each value must be an integer from 1 to 5.\n\nUser history:\n"), strip(history), F.lit("\n\nCandidate reasoning:\n"), strip(reasoning), F.lit("\n\n"), block, F.lit("\n" + JUDGE_RULES))
    )


def summary_messages(item: Column, words: int) -> Column:
    parts = [
        ("Title: ", compact(item["title"], 300)), ("\nStore/artist/format: ", compact(item["store"], 300)), ("\nCategories: ", F.array_join(text_list(item["categories"], 8), " > ")),
        ("\nDetails: ", details_text(item)), ("\nDescription: ", F.array_join(text_list(item["description"], 8), " ")),
    ]
    return messages(system=SUMMARISER, user=F.concat(F.lit(SUMMARY_TASK.format(words)), *[x for label, text in parts for x in (F.lit(label), text)]))


def instructed(text: Column, instruction: str) -> Column:
    """A query with its instruction for an embedder; without one, the query."""
    return F.concat(F.lit(f"Instruct: {instruction}\nQuery: "), text) if instruction else text
