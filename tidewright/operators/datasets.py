"""Dataset rows: examples with item texts and histories, training pairs, conversations, exclusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.answers import first_user, history_of, tagged
from tidewright.functions.text import blocks, compact, first_truthy, let, strip, tagged_assistant, with_reasoning
from tidewright.operators import order
from tidewright.operators.core import first_wins, tail, without

#: Columns of a candidate that an example doesn't have, of a conversation, and diagnostics that a conversation keeps.
CANDIDATE_COLUMNS = ["candidate_id", "candidate_index", "temperature", "think", "answer", "cot", "source_answer", "rubric", "rubric_total", "rubric_score_norm", "judge_mode", "judge_api_provider", "judge_model", "judge_used_target", "judge_meta", "judge_raw", "generation_timing", "generation_api_meta"]
CONVERSATION_COLUMNS = ["example_id", "user_id", "interaction_id", "candidate_id", "dataset", "category", "target_item_id", "history_item_ids", "rubric_total", "cot_gain", "selection_score"]
DIAGNOSTICS = ["gain_mode", "embedder_mode", "baseline_sim", "cot_sim", "sim_gain", "baseline_rank", "cot_rank", "baseline_ndcg", "cot_ndcg", "ndcg_k", "masked_history_items", "masked_pad_item", "selection_rank", "fallback_selected"]


def beside(rows: DataFrame, key: str, ids: str, items: DataFrame, columns: list[str], item_key: str = "item_id") -> DataFrame:
    """key and, for each of the items' columns, an array of its values in the order of the ids (null for unknown items).

    Items are joined once for each id of a row; what is made of an item (a text) is best made in `items` before.
    They are never broadcast: Spark guesses the size of made texts from the columns that they are made of.
    Rows have unique keys; cut their ids before to what is needed.
    """
    each = rows.select(key, F.posexplode(ids).alias("_pos", item_key)).join(items.select(item_key, *columns).hint("merge"), item_key, "left")
    listed = each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_pos", *columns))).alias("_rows"))

    def field(name: str):
        return lambda r: r[name]

    return listed.select(key, *[F.transform("_rows", field(c)).alias(c) for c in columns])


def eligible(rows: DataFrame, titles: str, ratings: str, rating: str, *, least_history: int, least_rating: float) -> DataFrame:
    """Rows with enough history and a good enough target; lists of different lengths raise.

    The check is part of the filter, so it holds whatever columns are read later.
    """
    enough = (F.size(titles) >= least_history) & (F.coalesce(F.col(rating), F.lit(0.0)) >= least_rating)
    fits = F.when(F.size(titles) == F.size(ratings), True).otherwise(F.raise_error(F.lit("ratings don't fit titles")).cast("boolean"))
    return rows.filter(F.when(enough, fits).otherwise(False))


def composite_key(*parts: Column) -> Column:
    return F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def last_columns(rows: DataFrame, columns: list[str], n: int) -> DataFrame:
    """Each of the array columns cut to its last n (all, for n 0)."""
    return rows.withColumns({c: tail(F.col(c), n) for c in columns}) if n > 0 else rows


def candidate_text(c: Column, mode: str) -> Column:
    """A candidate's reasoning: `answer`, `think`, `tagged` or `full`, each with what stands in for it."""
    think, answer, cot = strip(c["think"]), strip(c["answer"]), strip(c["cot"])
    if mode == "answer":
        return first_truthy(answer, cot, think)
    if mode == "think":
        return first_truthy(think, cot, answer)
    both = F.when((think != "") & (answer != ""), tagged(think, answer)).otherwise(first_truthy(cot, answer, think))
    if mode == "tagged":
        return both
    if mode == "full":
        return first_truthy(cot, both)
    raise ValueError(f"unknown mode: {mode}")


def chosen_candidates(candidates: Column, index: int) -> Column:
    """The candidates of one index; all for a negative one."""
    return F.filter(candidates, lambda c: c["candidate_index"] == index) if index >= 0 else candidates


def embedder_pairs(rows: DataFrame, *, key: str, history: Column, positive: Column, candidates: str, index: int = 0, mode: str = "answer", limit: int = 1200) -> DataFrame:
    """One pair for the history and one for each candidate with a text, with the row's other columns.

    example_id is the key with `:history` or `:cot:<index>`; rows without history or positive text have none.
    """
    own = rows.withColumns({"_history": strip(history), "_positive": strip(positive)}).filter("_history <> '' and _positive <> ''")
    pair = lambda c, text: F.struct(c["candidate_id"].alias("candidate_id"), c["candidate_index"].alias("candidate_index"), text.alias("text"))
    texts = F.transform(chosen_candidates(F.col(candidates), index), lambda c: let(compact(candidate_text(c, mode), limit), lambda t: pair(c, t)))
    first = F.array(F.struct(F.lit(None).cast("string").alias("candidate_id"), F.lit(None).cast("int").alias("candidate_index"), F.lit(None).cast("string").alias("text")))
    each = own.withColumn("_c", F.explode(F.concat(first, F.coalesce(F.filter(texts, lambda c: c["text"] != ""), F.slice(first, 1, 0)))))
    is_history = F.col("_c.text").isNull()
    return each.select(
        *[c for c in rows.columns if c not in (candidates, "query", "positive", "example_id")], F.col(key).alias("source_example_id"),
        F.when(is_history, F.concat(F.col(key).cast("string"), F.lit(":history"))).otherwise(F.concat(F.col(key).cast("string"), F.lit(":cot:"), F.col("_c.candidate_index").cast("string"))).alias("example_id"),
        F.when(is_history, "history").otherwise(f"history_plus_cot_{mode}").alias("query_type"), "_c.candidate_id", "_c.candidate_index",
        F.when(is_history, F.col("_history")).otherwise(with_reasoning(F.col("_history"), F.col("_c.text"))).alias("query"), F.col("_positive").alias("positive"),
    )


def pair_counts(rows: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """One row: source_rows, history_pairs, cot_pairs, skipped (rows without a pair)."""
    made = pairs.agg(F.count_if(F.col("query_type") == "history").alias("history_pairs"), F.count_if(F.col("query_type") != "history").alias("cot_pairs"))
    return rows.agg(F.count("*").alias("source_rows")).join(F.broadcast(made)).withColumn("skipped", F.col("source_rows") - F.col("history_pairs"))


def target_text(own: Column, positive: Column, looked_up: Column) -> Column:
    """The row's own target text, else its positive, else what the catalogue gives."""
    return first_truthy(strip(own), strip(positive), looked_up)


def conversation_rows(rows: DataFrame, reasoning: str, prompt: Column, maker: str) -> DataFrame:
    """Rows of fixed columns with messages: system, user, and assistant with one reasoning and one answer block.

    A text without both blocks is the reasoning, and its answer is the text's answer or else the row's
    source_answer. Columns that the rows lack are null; diagnostics are there where the rows have them.
    """
    have = set(rows.columns)
    of = lambda c: F.col(c) if c in have else F.lit(None).cast("string").alias(c)
    ids = [F.col(c).cast("array<long>") for c in ("history_item_ids", "history_item_id") if c in have]
    answer = first_truthy(blocks(F.col(reasoning))["answer"], *([F.col("source_answer")] if "source_answer" in have else [F.lit("")]))
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return rows.select(
        *[F.coalesce(*ids, F.array().cast("array<long>")).alias(c) if c == "history_item_ids" else of(c) for c in CONVERSATION_COLUMNS], *[c for c in DIAGNOSTICS if c in have],
        F.array(message("system", F.lit(maker)), message("user", prompt), message("assistant", tagged_assistant(F.col(reasoning), answer))).alias("messages"),
    )


def first_pairs(rows: DataFrame, query: Column, positive: Column, *, category: Column, split: str, position: str, last: int) -> DataFrame:
    """Pairs of the first phase, without reasoning: query, positive and what tells the interaction apart.

    rows: user_id, item_id, item_title, rating and history_item_id. Their interaction_id counts, or else
    the row's place in its category by `position`.
    """
    own = rows.withColumns({"category": category, "query": query, "positive": positive})
    if "interaction_id" not in rows.columns:
        start = own.groupBy("category").agg(F.count("*").alias("_n"))
        start = start.select("category", (F.sum("_n").over(Window.orderBy("category")) - F.col("_n")).alias("_start"))  # one row a category
        own = order.running(own, [F.col("category"), F.col(position)]).join(start, "category").withColumn("interaction_id", F.col("before") - F.col("_start"))
    ids = last_columns(own, ["history_item_id"], last)
    return ids.select(
        "query", "positive", "category", F.lit(split).alias("split"), F.col("user_id").cast("string").alias("user_id"), F.col("interaction_id").cast("long").alias("interaction_id"), F.col("item_id").alias("target_item_id"),
        F.coalesce("item_title", F.lit("")).alias("target_item_title"), F.coalesce(F.col("rating").cast("double"), F.lit(0.0)).alias("target_rating"), F.col("history_item_id").alias("history_item_ids"), F.size("history_item_id").alias("history_item_count"),
    )


def pair_examples(pairs: DataFrame, *, dataset: str, position: str) -> DataFrame:
    """Pairs of the first phase as examples: a key of category, split, interaction and user, the texts as they are.

    Missing categories and splits have the defaults, a missing interaction_id is the row's place by `position`.
    """
    have = set(pairs.columns)
    of = lambda c, other: F.coalesce(F.col(c), other) if c in have else other
    own = order.running(pairs, [F.col(position)]).withColumns({
        "category": of("category", F.lit("CDs_and_Vinyl")), "split": of("split", F.lit("train")), "interaction_id": of("interaction_id", F.col("before")), "user_id": of("user_id", F.lit("").cast(pairs.schema["user_id"].dataType) if "user_id" in have else F.lit("")),
    })
    text = lambda c: of(c, F.lit("")).alias
    return own.select(
        composite_key(*map(F.col, ("category", "split", "interaction_id", "user_id"))).alias("example_id"), F.lit(dataset).alias("dataset"), "category", "split", "user_id", "interaction_id", of("target_item_id", F.lit(None).cast("long")).alias("target_item_id"),
        text("target_item_title")("target_item_title"), text("positive")("target_item_text"), of("target_rating", F.lit(0.0)).alias("target_rating"), of("history_item_count", F.lit(0)).alias("history_item_count"), text("query")("user_history"),
    )


def stage_counts(rows: DataFrame, kept: Column, *groups: str, **more: Column) -> DataFrame:
    """What a stage reports of its input: source_rows, written and skipped (a null condition skips), and counts of other conditions."""
    sure = F.coalesce(kept, F.lit(False))
    counts = [F.count("*").alias("source_rows"), F.count_if(sure).alias("written"), F.count_if(~sure).alias("skipped"), *[F.count_if(c).alias(n) for n, c in more.items()]]
    return rows.groupBy(*groups).agg(*counts) if groups else rows.agg(*counts)


def row_history(rows: DataFrame) -> Column:
    """The normalised history of a row: user_history, else source_prompt, else its first user message."""
    own = [F.col(c) for c in ("user_history", "source_prompt") if c in rows.columns]
    return history_of(first_truthy(*own, *([first_user(F.col("messages"))] if "messages" in rows.columns else [F.lit("")])))


def excluded(rows: DataFrame, others: DataFrame) -> DataFrame:
    """Rows that stand in none of the others: neither by example_id nor by (user_id, interaction_id).

    Only where the others have no such key at all, rows are compared by normalised history. Null keys
    match nothing.
    """
    ids = others.filter(F.coalesce("example_id", F.lit("")) != "").select(F.col("example_id").cast("string").alias("_id"))
    pairs = others.filter("user_id is not null and interaction_id is not null").select(F.col("user_id").cast("string").alias("_user"), F.col("interaction_id").cast("string").alias("_at"))
    if ids.isEmpty() and pairs.isEmpty():
        known = others.select(row_history(others).alias("_history")).filter("_history <> ''")
        return without(rows.withColumn("_history", row_history(rows)), (known, ["_history"])).drop("_history")
    own = rows.withColumns({"_id": F.col("example_id").cast("string"), "_user": F.col("user_id").cast("string"), "_at": F.col("interaction_id").cast("string")})
    return without(own, (ids, ["_id"]), (pairs, ["_user", "_at"])).drop("_id", "_user", "_at")


def scored_candidates(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """Candidates (example columns, overlaid by their own) with their scores' columns and judge_mode.

    scores: one row for each example_id and candidate_index with rubric_total, score_norm, judge_provider,
    judge_model and judge_used_target. Candidates without a score are dropped.
    """
    theirs = scores.select("example_id", "candidate_index", F.col("candidate_id").alias("_id"), "rubric_total", "score_norm", "judge_provider", "judge_model", "judge_used_target")
    provider = F.coalesce("judge_provider", F.lit(""))
    return (
        candidates.join(theirs, ["example_id", "candidate_index"])
        .withColumn("candidate_id", first_truthy(F.col("candidate_id"), F.col("_id"), F.concat_ws("-", "example_id", "candidate_index")))
        .withColumn("cot", tagged(F.col("think"), F.col("answer")))
        .withColumn("source_answer", F.coalesce("answer", F.lit("")))
        .withColumn("rubric_score_norm", F.coalesce("score_norm", F.col("rubric_total") / 25.0))
        .withColumn("judge_mode", F.regexp_replace(F.concat(F.lit("api_"), provider), "_+$", ""))
        .withColumnRenamed("judge_provider", "judge_api_provider")
        .drop("_id", "score_norm")
    )


def example_rows(candidates: DataFrame, order: list) -> DataFrame:
    """One row of each example, the first, without what belongs to a candidate."""
    own = candidates.filter(F.coalesce("example_id", F.lit("")) != "")
    return first_wins(own, ["example_id"], order).drop(*CANDIDATE_COLUMNS)


def nested(rows: DataFrame, candidates: DataFrame, key: str, n: int) -> DataFrame:
    """Rows with their candidates of index 0 to n - 1 as an array by index and candidate_count; rows without any are dropped."""
    own = candidates.filter(F.col("candidate_index").between(0, n - 1))
    rest = [c for c in own.columns if c not in (key, "candidate_index")]
    lists = own.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("candidate_index", *rest))).alias("candidates"))
    return rows.join(lists, key).withColumn("candidate_count", F.size("candidates"))


def merged_maps(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of two relations by key; where both have one, that of the second."""
    both = first.withColumn("_side", F.lit(0)).unionByName(second.withColumn("_side", F.lit(1)))
    return first_wins(both, keys, [F.desc("_side")]).drop("_side")


def complete(candidates: DataFrame, key: str, n: int) -> DataFrame:
    """One row: examples with any candidate, and with n or more different ones."""
    return candidates.groupBy(key).agg(F.count_distinct("candidate_index").alias("m")).agg(F.count("*").alias("examples"), F.count_if(F.col("m") >= n).alias("complete"))


def with_reasoning_of(examples: DataFrame, reasoning: DataFrame, key: str = "example_id", *, required: bool = False) -> DataFrame:
    """Examples with their reasoning (key, cot); without one it is empty, or the example is dropped."""
    own = examples.join(reasoning.select(key, "cot"), key, "inner" if required else "left")
    return own if required else own.withColumn("cot", F.coalesce("cot", F.lit("")))


def with_baseline(rows: DataFrame, cached: DataFrame, key: str, compute) -> DataFrame:
    """Rows with the cached values of their key; values of keys that aren't cached are computed once each.

    cached: key and values, one row each. compute: from the distinct missing keys' rows to key and values.
    """
    missing = rows.join(cached.select(key), key, "left_anti")
    fresh = compute(first_wins(missing, [key], [F.lit(1)]))
    return rows.join(cached.unionByName(fresh.select(*cached.columns)), key)


def seeded_order(rows: DataFrame, seed: int, key: str) -> DataFrame:
    """Rows in an order that the seed fixes."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col(key).cast("string"))), key)


def limited_tasks(rows: DataFrame, position: str, candidates: str, *, examples: int = 0, tasks: int = 0) -> DataFrame:
    """Candidates with an answer of the first so many examples, and of those the first so many (0: all).

    Adds candidate; the two limits are independent, and examples count whether or not they have candidates.
    """
    own = rows.orderBy(position).limit(examples) if examples else rows
    each = own.select("*", F.posexplode(candidates).alias("_at", "candidate"))
    answered = each.filter(strip(F.col("candidate.answer")) != "")
    return (answered.orderBy(position, "_at").limit(tasks) if tasks else answered).drop("_at", candidates)
