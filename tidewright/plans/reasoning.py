"""Queries over prompts, model outputs, judgements and rewards, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.functions import answers, prompts, providers, rewards
from tidewright.functions import rubric as R
from tidewright.functions import text as T
from tidewright.operators import datasets, ranking
from tidewright.plans import adapters as A
from tidewright.plans.registry import compact, query, quoted, strip, word_list
from tidewright.sources.tables import table

_NL = "chr(10)"
_CAT = "CASE doc_id % 3 WHEN 0 THEN 'Video_Games' WHEN 1 THEN 'Books' ELSE '' END"
_TASK = prompts.TASK.split("{}")


def _said(messages):
    """Messages as one text, for a digest."""
    return F.md5(F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n"))


@query(f"""WITH d AS (SELECT doc_id, {strip('text')} AS t, {_CAT} AS category, CASE WHEN doc_id % 2 = 0 THEN 'Target title: T' || doc_id || {_NL} || 'Target item text: x' ELSE '' END AS target FROM documents)
SELECT doc_id, md5('system:' || {quoted(prompts.MAKER)} || {_NL} || 'user:The following are the items the user has interacted with:' || {_NL} || '<Historical Interactions>' || {_NL} || t || {_NL} || '</Historical Interactions>' || {_NL} || {_NL} || 'Category: ' || CASE category WHEN 'Video_Games' THEN 'video games' WHEN 'Books' THEN 'Books' ELSE 'items' END || '.' || {_NL} || {_NL} || {quoted(_TASK[0])} || CASE category WHEN 'Video_Games' THEN 'video game' WHEN 'Books' THEN 'Book' ELSE 'item' END || {quoted(_TASK[1])}) AS maker,
md5('system:' || {quoted(prompts.JUDGE)} || {_NL} || 'user:Score the candidate on five dimensions. Each value must be an integer from 1 to 5.' || {_NL} || {_NL} || 'User history:' || {_NL} || 'h' || {_NL} || {_NL} || 'Candidate reasoning:' || {_NL} || t || {_NL} || {_NL} || CASE WHEN target = '' THEN '' ELSE {quoted(prompts.JUDGE_TARGET)} || target || {_NL} || {_NL} END || {_NL} || {quoted(prompts.JUDGE_RULES)}) AS judge,
md5('Instruct: find it' || {_NL} || 'Query: ' || CASE WHEN t = '' THEN 'h' ELSE 'h' || {_NL} || {_NL} || 'Recommendation reasoning:' || {_NL} || t END) AS embedded FROM d""")
def chat_prompts(spark, d):
    """Messages to a text maker and to a judge (with and without the target), and an embedder's query."""
    k = F.col("doc_id")
    category = F.when(k % 3 == 0, "Video_Games").when(k % 3 == 1, "Books").otherwise("")
    target = F.when(k % 2 == 0, prompts.target_block(F.concat(F.lit("T"), k), F.lit("x"))).otherwise(prompts.target_block(F.lit("t"), F.lit("x"), False))
    query_ = prompts.instructed(T.with_reasoning(F.lit(" h "), F.col("text")), "find it")
    return A.documents(spark, d).select("doc_id", _said(prompts.maker_messages(F.col("text"), category)).alias("maker"), _said(prompts.judge_messages(F.lit(" h"), F.col("text"), target)).alias("judge"), F.md5(query_).alias("embedded"))


@query(f"""WITH {A.RICH}, t AS (SELECT item_id, {compact('title', 300)} AS title, {compact("coalesce(store, '')", 300)} AS store, array_to_string(list_filter([trim(x) FOR x IN coalesce(categories, [])], lambda x: x <> '')[1:8], ' > ') AS cats, list_filter([{compact('x', 500)} FOR x IN description], lambda x: x <> '') AS parts,
CASE item_id % 6 WHEN 2 THEN concat_ws('; ', 'Artist=' || json_extract_string(details, '$.Artist'), 'Label=' || json_extract_string(details, '$.Manufacturer'), CASE WHEN item_id % 5 <> 0 THEN 'Format=LP' END, 'Run time=' || json_extract_string(details, '$.Runtime'), 'Number of discs=2') WHEN 3 THEN concat_ws('; ', 'Label=L', CASE WHEN item_id % 5 <> 0 THEN 'Format=CD' END, 'Language=en us') ELSE '' END AS det FROM rich)
SELECT item_id, md5('system:' || {quoted(prompts.SUMMARISER)} || {_NL} || 'user:' || {quoted(prompts.SUMMARY_TASK.format(40))} || 'Title: ' || title || {_NL} || 'Store/artist/format: ' || store || {_NL} || 'Categories: ' || cats || {_NL} || 'Details: ' || det || {_NL} || 'Description: ' || array_to_string(parts, ' ')) AS said FROM t""")
def summary_prompts(spark, d):
    return A.rich_items(spark, d).select("item_id", _said(prompts.summary_messages(F.col("item"), 40)).alias("said"))


# Model outputs, put together from the halves of a text so that what is to be found in them is known.

_HALF = "halves AS (SELECT doc_id, doc_id % 6 AS k, left(text, length(text) // 2) AS a, substr(text, length(text) // 2 + 1) AS b FROM documents)"


def _halves(spark, d):
    own = A.documents(spark, d).select("doc_id", (F.col("doc_id") % 6).alias("k"), F.expr("left(text, cast(length(text) div 2 as int))").alias("a"), F.expr("substr(text, cast(length(text) div 2 as int) + 1)").alias("b"))
    a, b = F.col("a"), F.col("b")
    raw = (
        F.when(F.col("k") == 0, F.concat(F.lit("<Thinking> "), a, F.lit("</thinking>\n<recommendation>"), b, F.lit(" </RECOMMENDATION> tail")))
        .when(F.col("k") == 1, F.concat(F.lit("Final answer: "), a))
        .when(F.col("k") == 2, F.concat(F.lit("< hidden_reasoning >"), a, F.lit("</ hidden_reasoning> Answer： "), b))
        .when(F.col("k") == 3, F.concat(F.lit("<think>"), a, F.lit("</think>mid <answer>old</answer> <ANSWER>"), b, F.lit("</answer>tail")))
        .when(F.col("k") == 4, F.concat(a, F.lit("```json\ncode\n```<tool_call>"), b, F.lit("</TOOL_CALL>")))
        .otherwise(F.concat(F.lit("<answer>"), a))
    )
    return own.withColumn("raw", raw)


_A, _B = strip("a"), strip("b")
_OUT = f"""{_HALF}, o AS (SELECT doc_id, k, CASE k WHEN 0 THEN {_B} WHEN 1 THEN {_A} WHEN 2 THEN {_B} WHEN 3 THEN {_B} WHEN 4 THEN {strip('a || b')} ELSE {_A} END AS answer,
CASE k WHEN 0 THEN {strip("b || '  tail'")} WHEN 1 THEN {_A} WHEN 2 THEN {_B} WHEN 3 THEN {strip("'mid old ' || b || 'tail'")} WHEN 4 THEN {strip('a || b')} ELSE {_A} END AS recommendation, CASE WHEN k IN (0, 3) THEN {_A} ELSE '' END AS think FROM halves)"""


@query(f"WITH {_OUT} SELECT doc_id, md5(answer) AS answer, md5(recommendation) AS recommendation, md5(think) AS think, md5(CASE WHEN think <> '' AND answer <> '' THEN '<think>' || {_NL} || think || {_NL} || '</think>' || {_NL} || '<answer>' || {_NL} || answer || {_NL} || '</answer>' WHEN answer <> '' THEN '<answer>' || {_NL} || answer || {_NL} || '</answer>' ELSE answer END) AS cot, CAST(length(answer) AS INTEGER) AS answer_chars, CAST(length(think) AS INTEGER) AS think_chars FROM o")
def output_parts(spark, d):
    """Answer (both rules), reasoning and candidate of raw outputs."""
    c = answers.candidate(F.col("doc_id").cast("string"), F.col("raw"), "model", "batch", 0.7)
    own = _halves(spark, d).select("doc_id", F.md5(answers.recommendation_of(F.col("raw"))).alias("recommendation"), F.md5(T.answer_of(F.col("raw"))).alias("answer"), c.alias("c"))
    return own.select("doc_id", "answer", "recommendation", F.md5("c.think").alias("think"), F.md5("c.cot").alias("cot"), "c.generation_meta.answer_chars", "c.generation_meta.think_chars")


@query(f"""WITH {_HALF}, c AS (SELECT doc_id, k, {compact('a')} AS c FROM halves), w AS (SELECT doc_id, k, c, string_split(c, ' ') AS w FROM c)
SELECT doc_id, md5(CASE WHEN k IN (3, 4) THEN '' WHEN len(w) <= 20 THEN c ELSE array_to_string(w[1:20], ' ') END) AS summary, k IN (3, 4) AS reasoning FROM w""")
def summary_outputs(spark, d):
    """Summaries out of raw outputs: fences, labels, quotation marks, thinking aloud, too many words."""
    k, a = F.col("k"), T.strip(F.col("a"))
    raw = (
        F.when(k == 0, F.concat(F.lit("```json\n"), a, F.lit("\n```"))).when(k == 1, F.concat(F.lit("Summary: "), a)).when(k == 2, F.concat(F.lit(' "'), a, F.lit('" ')))
        .when(k == 3, F.concat(F.lit("Okay so "), a)).when(k == 4, F.concat(F.lit("Here  The User\nwants "), a)).otherwise(F.concat(F.lit("Final answer: "), a))
    )
    own = _halves(spark, d).withColumn("raw", raw)
    cleaned = answers.clean_generation(F.col("raw"))  # fenced text is taken for code by the answer's rule, so it is cleaned before
    return own.select("doc_id", F.md5(answers.summary_of(F.when(k == 0, cleaned).otherwise(F.col("raw")), 20)).alias("summary"), answers.looks_like_reasoning(F.col("raw")).alias("reasoning"))


@query(f"""WITH {A.SCORED}, s AS (SELECT *, doc_id % 5 AS k FROM scored), t AS (SELECT *, CASE WHEN k < 2 THEN d1 ELSE d2 END + d2 + d3 + d4 + d5 AS total FROM s) SELECT doc_id, CASE WHEN k < 4 THEN CAST(total AS INTEGER) END AS total, CASE WHEN k < 4 THEN round(total / 25.0::DOUBLE, 6) END AS score_norm, CASE WHEN k < 2 THEN 'json' WHEN k < 4 THEN 'prose' END AS mode,
CASE k WHEN 0 THEN left(repeat('long ', 120), 500) WHEN 1 THEN '' WHEN 2 THEN 'preference_grounding: ' || d1 || ' | taste_specificity - score ' || d2 || ' | transitional_reasoning ' || d3 || '/5 | discriminative_framing: ' || d4 || ' | conciseness = ' || d5 WHEN 3 THEN 'conciseness = ' || d5 END AS comment FROM t""")
def judged_envelopes(spark, d):
    """Scores out of chat completions: JSON in either field before prose in either, a comment, nothing.

    In the prose a score word after a later dimension is the first pattern's match for an earlier one, too.
    """
    own = A.scored(spark, d)
    dims = [F.col(f"d{i}") for i in range(1, 6)]
    pair = lambda q: F.concat_ws(", ", *[F.concat(F.lit(f'"{n}": {q}'), v, F.lit(q)) for n, v in zip(R.DIMENSIONS, dims, strict=True)])
    said = F.concat(F.lit("preference_grounding: "), dims[0], F.lit("\ntaste_specificity - score "), dims[1], F.lit("\ntransitional_reasoning "), dims[2], F.lit("/5\ndiscriminative_framing: "), dims[3], F.lit("\nconciseness = "), dims[4])
    k = F.col("doc_id") % 5
    content = F.when(k == 0, F.concat(F.lit("Sure: {"), pair(""), F.lit(', "comment": "'), F.repeat(F.lit("long "), 120), F.lit('"} ok'))).when(k == 1, F.lit("I think conciseness: 5 it is fine")).when(k == 2, said).when(k == 3, F.lit("")).otherwise("no score here")
    rest = F.when(k == 1, F.concat(F.lit("{"), pair('"'), F.lit("}"))).when(k == 3, F.regexp_replace(said, "_", " "))
    envelope = F.to_json(F.struct(F.array(F.struct(F.struct(content.alias("content"), rest.alias("reasoning_content")).alias("message"))).alias("choices")))
    score = own.select("doc_id", providers.envelope_score(envelope).alias("s"))
    return score.select("doc_id", "s.total", F.round("s.score_norm", 6).alias("score_norm"), "s.mode", "s.comment")


_RULE = lambda name, terms: f"({' + '.join(f'(contains(low, {quoted(t)}))::INT' for t in terms)}) AS {name}"
_LAD = lambda x, s: "(1 + " + " + ".join(f"(({x}) >= {k})::INT" for k in s) + ")"


@query(f"""WITH w AS (SELECT doc_id, text, {word_list('text')} AS w, {compact('lower(text)')} AS low FROM documents), h AS (SELECT doc_id, low, len(w) AS wc, lower(coalesce(w[1], 'x') || ' ' || coalesce(w[2], 'y')) AS t1, lower(coalesce(w[3], 'z')) AS t3, {_RULE('p', R.PREFERENCE)}, {_RULE('tr', R.TRANSITION)}, {_RULE('di', R.DISCRIMINATIVE)}, {_RULE('lk', R.LEAKAGE)}, {_RULE('g', R.GENERIC)} FROM w),
m AS (SELECT *, (contains(low, t1))::INT AS good, (contains(low, t3))::INT AS bad FROM h), n AS (SELECT *, good + bad AS named FROM m),
s AS (SELECT doc_id, named, good, bad, greatest(1, {_LAD('good + least(named, 2)', R.LADDER)} - lk) AS grounding, greatest(1, {_LAD('di + least(bad, 2)', R.LADDER)} - lk) AS framing, greatest(1, {_LAD('p', R.SPECIFICITY_LADDER)} - g) AS b, {_LAD('tr', R.LADDER)} AS c, greatest(1, CASE WHEN wc BETWEEN 70 AND 220 THEN 5 WHEN wc BETWEEN 45 AND 280 THEN 4 WHEN wc BETWEEN 25 AND 360 THEN 3 WHEN wc > 0 THEN 2 ELSE 1 END - 1) AS f FROM n)
SELECT doc_id, CAST(grounding AS INTEGER) AS grounding, CAST(framing AS INTEGER) AS framing, CAST(grounding + b + c + framing + f AS INTEGER) AS total, CAST(named AS INTEGER) AS named, CAST(good AS INTEGER) AS good, CAST(bad AS INTEGER) AS bad FROM s""")
def rule_score_with_history(spark, d):
    """Rule scores with a history: a liked and a disliked title made of the text's first words, and one it lacks."""
    w = F.slice(T.word_list(F.col("text")), 1, 3)
    at = lambda i, other: F.coalesce(F.try_element_at(w, F.lit(i)), F.lit(other))
    history = F.concat(at(1, "x"), F.lit(" "), at(2, "y"), F.lit(" (1999), 5 stars; Never Qqseen (2001), 1 stars; "), at(3, "z"), F.lit(" (2000), 2 stars"))
    own = A.documents(spark, d).select("doc_id", R.rule_score(history, F.col("text")).alias("s"))
    return own.select("doc_id", F.col("s.preference_grounding").alias("grounding"), F.col("s.discriminative_framing").alias("framing"), "s.total", F.col("s.mentioned_history_items").alias("named"), F.col("s.mentioned_positive_items").alias("good"), F.col("s.mentioned_low_items").alias("bad"))


# Rewards

_GATE = lambda gain, known: f"CASE WHEN norm >= 0.45 AND {known} AND ({gain}) > 0 THEN norm * ({gain}) ELSE -0.05 END"


@query(f"""WITH {A.SCORED}, s AS (SELECT *, CASE WHEN doc_id % 7 <> 0 THEN doc_id END AS target, CASE WHEN doc_id % 5 <> 0 THEN 'text' ELSE '' END AS told, CASE WHEN doc_id % 3 <> 0 THEN d1 / 10.0::DOUBLE END AS given, CASE WHEN doc_id % 2 = 0 THEN 'dense' ELSE 'lexical' END AS by_, d2 / 10.0::DOUBLE AS fresh, d3 / 10.0::DOUBLE AS now FROM scored)
SELECT doc_id, round({_GATE('now - fresh', "target IS NOT NULL AND told <> ''")}, 6) AS ndcg, round({_GATE("now - CASE WHEN given IS NULL OR by_ <> 'dense' THEN fresh ELSE given END", "told <> ''")}, 6) AS dense, round({_GATE('now - coalesce(given, fresh)', "told <> ''")}, 6) AS lexical,
round(gain, 6) AS only_gain, round(norm, 6) AS only_rubric, round(0.5 * norm + 0.5 * gain, 6) AS weighted, round({_GATE('gain', 'TRUE')}, 6) AS gated FROM s""")
def reward_modes(spark, d):
    """Gated gains in the three modes, and the four settings of the ablation."""
    k = F.col("doc_id")
    own = A.scored(spark, d).withColumns({"target": F.when(k % 7 != 0, k), "told": F.when(k % 5 != 0, "text").otherwise(""), "given": F.when(k % 3 != 0, F.col("d1") / 10.0), "by": F.when(k % 2 == 0, "dense").otherwise("lexical"), "fresh": F.col("d2") / 10.0, "now": F.col("d3") / 10.0})
    c = F.col
    all_ = {
        "ndcg": rewards.ndcg_reward(c("norm"), c("fresh"), c("now"), c("target"), c("told")), "dense": rewards.dense_reward(c("norm"), c("given"), c("by"), c("fresh"), c("now"), c("told"), "dense"), "lexical": rewards.lexical_reward(c("norm"), c("given"), c("fresh"), c("now"), c("told")),
        **{{"gain": "only_gain", "rubric": "only_rubric", "sum": "weighted", "gated": "gated"}[n]: x for n, x in rewards.ablations(c("norm"), c("gain")).items()},
    }
    return own.select("doc_id", *[F.round(x, 6).alias(n) for n, x in all_.items()])


@query(f"""WITH {A.SCORED}, s AS (SELECT doc_id, CASE WHEN doc_id % 4 <> 1 THEN norm END AS judged FROM scored)
SELECT CASE WHEN judged IS NULL THEN 'fallback_rules' ELSE 'api_success' END AS source, count(*) AS n, round(avg(judged), 6) AS mean_judged FROM s GROUP BY 1""")
def quality_sources(spark, d):
    """Where quality scores come from: the judge, or the rules where it gave none."""
    own = A.scored(spark, d).withColumn("judged", F.when(F.col("doc_id") % 4 != 1, F.col("norm")))
    q = rewards.quality("api", F.lit(""), F.lit("plain text"), F.col("judged"))
    return own.withColumn("q", q).groupBy(F.col("q.source").alias("source")).agg(F.count("*").alias("n"), F.round(F.avg("judged"), 6).alias("mean_judged"))


_BAG = lambda side: f"SELECT doc_id, unnest(regexp_extract_all(lower({side}), '[A-Za-z0-9][A-Za-z0-9''-]*')) AS tok"


@query(f"""WITH {_HALF}, ta AS (SELECT doc_id, tok, count(*) AS n FROM ({_BAG('a')} FROM halves) GROUP BY 1, 2), tb AS (SELECT doc_id, tok, count(*) AS n FROM ({_BAG('b')} FROM halves) GROUP BY 1, 2),
dots AS (SELECT ta.doc_id, sum(ta.n * tb.n) AS x FROM ta JOIN tb USING (doc_id, tok) GROUP BY 1), na AS (SELECT doc_id, sum(n * n) AS x FROM ta GROUP BY 1), nb AS (SELECT doc_id, sum(n * n) AS x FROM tb GROUP BY 1)
SELECT doc_id, round(coalesce(dots.x / sqrt((na.x * nb.x)::DOUBLE), 0.0::DOUBLE), 6) AS sim FROM halves LEFT JOIN dots USING (doc_id) LEFT JOIN na USING (doc_id) LEFT JOIN nb USING (doc_id)""")
def pair_similarity(spark, d):
    """The lexical cosine of two texts of one row."""
    return ranking.pair_cosines(_halves(spark, d).select("doc_id", "a", "b"), "doc_id", "a", "b", "sim").withColumn("sim", F.round("sim", 6))


@query(f"WITH {A.SCORED} SELECT CASE doc_id % 3 WHEN 0 THEN 'base' WHEN 1 THEN 'sft' ELSE 'grpo' END AS stage, count(*) AS n, {', '.join(f'round(avg(d{i}), 6) AS d{i}' for i in range(1, 6))}, round(avg(gain), 6) AS gain, round(stddev_samp(gain), 6) AS spread, count(*) FILTER (gain > 0) AS positive FROM scored GROUP BY 1")
def stage_distributions(spark, d):
    """Dimensions and gains by stage of training."""
    stage = F.element_at(F.array(F.lit("base"), F.lit("sft"), F.lit("grpo")), (F.col("doc_id") % 3 + 1).cast("int"))
    own = A.scored(spark, d).withColumn("stage", stage)
    return own.groupBy("stage").agg(F.count("*").alias("n"), *[F.round(F.avg(f"d{i}"), 6).alias(f"d{i}") for i in range(1, 6)], F.round(F.avg("gain"), 6).alias("gain"), F.round(F.stddev_samp("gain"), 6).alias("spread"), F.count_if(F.col("gain") > 0).alias("positive"))


@query(f"""SELECT doc_id, md5({quoted(answers.MOCK_THINK)} || {_NL} || 'Candidate ' || (doc_id % 3) || CASE WHEN doc_id % 2 = 0 THEN replace({quoted(answers.MOCK_ANSWER)}, 'positive cues', 'the held-out item') ELSE {quoted(answers.MOCK_ANSWER)} END) AS said FROM documents""")
def mock_outputs(spark, d):
    """The stand-in of a text maker, the target's title masked where it stands in the text."""
    title = F.when(F.col("doc_id") % 2 == 0, "positive cues").otherwise("no such title")
    return table(spark, d, "documents").select("doc_id", F.md5(answers.mock_output(F.col("doc_id") % 3, title)).alias("said"))


@query(f"""WITH w AS (SELECT doc_id, text, list_filter(string_split({compact('text')}, ' '), lambda x: x <> '') AS w FROM documents) SELECT doc_id, md5(CASE WHEN len(w) <= 25 THEN text ELSE array_to_string(w[-25:], ' ') END) AS tail FROM w""")
def prompt_tails(spark, d):
    """Prompts cut from the left."""
    return A.documents(spark, d).select("doc_id", F.md5(T.last_words(F.col("text"), 25)).alias("tail"))


@query(f"""WITH {A.SCORED}, {_HALF}, t AS (SELECT doc_id, d1, d2, d3, d4, d5, {_B} AS answer FROM halves JOIN scored USING (doc_id)) SELECT doc_id // 4 AS example_id, CAST(doc_id % 4 AS INTEGER) AS candidate_index, CASE WHEN doc_id % 3 = 0 THEN 'rules' ELSE 'json' END AS mode, CASE WHEN doc_id % 3 <> 0 THEN CAST(d1 + d2 + d3 + d4 + d5 AS INTEGER) END AS judged_total FROM t WHERE answer <> ''""")
def judged_lists(spark, d):
    """Candidate lists judged one by one: the judge's score where it sent one, else that of the rules."""
    own = _halves(spark, d).join(A.scored(spark, d).select("doc_id", *[f"d{i}" for i in range(1, 6)]), "doc_id")
    own = own.withColumns({"example_id": F.expr("doc_id div 4"), "candidate_index": (F.col("doc_id") % 4).cast("int"), "answer": F.col("b")})
    lists = datasets.nested(own.select("example_id").distinct(), own.select("example_id", "candidate_index", "answer", "doc_id", *[f"d{i}" for i in range(1, 6)]), "example_id", 4)
    tasks = datasets.limited_tasks(lists.drop("candidate_count"), "example_id", "candidates").select("example_id", "candidate.*")
    payload = F.when(F.col("doc_id") % 3 != 0, F.to_json(F.struct(*[F.col(f"d{i}").alias(n) for i, n in enumerate(R.DIMENSIONS, 1)])))
    sent = F.when(payload.isNotNull(), providers.mock_envelope(payload))
    rules = R.rule_score(F.lit(""), F.col("answer"))
    score = F.coalesce(providers.envelope_score(sent), providers.judged_score(F.lit("no score"), rules))
    return tasks.select("example_id", "candidate_index", score.alias("s")).select("example_id", "candidate_index", "s.mode", F.when(F.col("s.mode") == "json", F.col("s.total")).alias("judged_total"))
