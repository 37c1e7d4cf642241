"""Queries over candidates, training rows, selection and conversions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.functions import convert, items
from tidewright.functions import text as T
from tidewright.functions.providers import stored_score
from tidewright.functions.rubric import ndcg
from tidewright.operators import core, datasets, ranking, selection
from tidewright.plans import adapters as A
from tidewright.plans.registry import compact, query, quoted, strip
from tidewright.sources import jsonl
from tidewright.sources.memo import Memo
from tidewright.sources.tables import scratch, table
from tidewright.streaming import resumable

_NL = "chr(10)"
_PARTS = """parts AS (SELECT doc_id, doc_id // 4 AS example_id, CAST(doc_id % 4 AS INTEGER) AS idx, CASE WHEN doc_id % 3 = 0 THEN '' ELSE left(text, length(text) // 3) END AS think, CASE WHEN doc_id % 5 = 0 THEN '' ELSE substr(text, length(text) // 3 + 1, length(text) // 3) END AS answer, CASE WHEN doc_id % 2 = 0 THEN NULL ELSE substr(text, 2 * (length(text) // 3) + 1) END AS cot FROM documents)"""
_S = {c: strip(f"coalesce({c}, '')") for c in ("think", "answer", "cot")}
_TAGGED = f"'<think>' || {_NL} || {_S['think']} || {_NL} || '</think>' || {_NL} || '<answer>' || {_NL} || {_S['answer']} || {_NL} || '</answer>'"
_FIRST = lambda *names: "coalesce(" + ", ".join(f"nullif({_S[n]}, '')" for n in names) + ")"


def _parts(spark, d):
    k = F.col("doc_id")
    return table(spark, d, "documents").select(
        "doc_id", F.expr("doc_id div 4").alias("example_id"), (k % 4).cast("int").alias("candidate_index"), F.concat(F.lit("c"), k).alias("candidate_id"), F.when(k % 3 == 0, "").otherwise(F.expr("left(text, cast(length(text) div 3 as int))")).alias("think"),
        F.when(k % 5 == 0, "").otherwise(F.expr("substr(text, cast(length(text) div 3 as int) + 1, cast(length(text) div 3 as int))")).alias("answer"), F.when(k % 2 != 0, F.expr("substr(text, 2 * cast(length(text) div 3 as int) + 1)")).alias("cot"),
    )


@query(f"""WITH {_PARTS} SELECT doc_id, {_FIRST('answer', 'cot', 'think')} AS answer, {_FIRST('think', 'cot', 'answer')} AS think, md5(CASE WHEN {_S['think']} <> '' AND {_S['answer']} <> '' THEN {_TAGGED} ELSE {_FIRST('cot', 'answer', 'think')} END) AS tagged,
md5(coalesce(nullif({_S['cot']}, ''), CASE WHEN {_S['think']} <> '' AND {_S['answer']} <> '' THEN {_TAGGED} ELSE {_FIRST('cot', 'answer', 'think')} END)) AS full_text FROM parts""")
def candidate_texts(spark, d):
    """A candidate's text in the four modes."""
    own = _parts(spark, d).withColumn("c", F.struct("think", "answer", "cot"))
    of = lambda mode: datasets.candidate_text(F.col("c"), mode)
    return own.select("doc_id", of("answer").alias("answer"), of("think").alias("think"), F.md5(of("tagged")).alias("tagged"), F.md5(of("full")).alias("full_text"))


def _lists(spark, d):
    """Examples (four documents each) with a history, a target and their candidates nested; every fifth has no history."""
    e = F.col("example_id")
    rows = _parts(spark, d).select("example_id").distinct().withColumns({"history": F.when(e % 5 == 0, "").otherwise(F.concat(F.lit("history "), e)), "own": F.when(e % 2 == 0, F.concat(F.lit("target "), e)), "positive": F.lit(""), "looked_up": F.concat(F.lit("item "), e)})
    return datasets.nested(rows, _parts(spark, d).drop("doc_id"), "example_id", 3)


_PAIRS = f"""{_PARTS}, n AS (SELECT example_id, 'history ' || example_id AS history, CASE WHEN example_id % 2 = 0 THEN 'target ' || example_id ELSE 'item ' || example_id END AS positive FROM (SELECT DISTINCT example_id FROM parts WHERE idx < 3) WHERE example_id % 5 <> 0),
pairs AS (SELECT example_id, example_id || ':history' AS pair_id, 'history' AS query_type, NULL AS idx, history AS query, positive FROM n UNION ALL SELECT example_id, example_id || ':cot:1', 'history_plus_cot_answer', 1, history || {_NL} || {_NL} || 'Recommendation reasoning:' || {_NL} || t, positive FROM (SELECT n.*, {compact(f"coalesce({_FIRST('answer', 'cot', 'think')}, '')", 1200)} AS t FROM n JOIN parts USING (example_id) WHERE idx = 1) WHERE t <> '')"""


@query(f"WITH {_PAIRS} SELECT example_id, pair_id, query_type, CAST(idx AS INTEGER) AS candidate_index, md5(query) AS query, positive FROM pairs")
def embedder_rows(spark, d):
    """Pairs for an embedder: one of each history, one of each chosen candidate with a text."""
    rows = _lists(spark, d).withColumn("target", datasets.target_text(F.col("own"), F.col("positive"), F.col("looked_up"))).withColumnRenamed("example_id", "source")
    pairs = datasets.embedder_pairs(rows, key="source", history=F.col("history"), positive=F.col("target"), candidates="candidates", index=1, limit=1200)
    return pairs.select(F.col("source_example_id").alias("example_id"), F.col("example_id").alias("pair_id"), "query_type", "candidate_index", F.md5("query").alias("query"), "positive")


@query(f"WITH {_PAIRS} SELECT (SELECT count(DISTINCT example_id) FROM parts WHERE idx < 3) AS source_rows, count(*) FILTER (query_type = 'history') AS history_pairs, count(*) FILTER (query_type <> 'history') AS cot_pairs, (SELECT count(DISTINCT example_id) FROM parts WHERE idx < 3) - count(*) FILTER (query_type = 'history') AS skipped FROM pairs")
def embedder_counts(spark, d):
    rows = _lists(spark, d).withColumn("target", F.lit("t")).withColumnRenamed("example_id", "source")
    return datasets.pair_counts(rows, datasets.embedder_pairs(rows, key="source", history=F.col("history"), positive=F.col("target"), candidates="candidates", index=1, limit=1200), "source")


@query(f"WITH {_PARTS} SELECT example_id, count(*) FILTER (idx < 3) AS candidate_count, string_agg('c' || doc_id, ',' ORDER BY idx) FILTER (idx < 3) AS ids FROM parts GROUP BY 1 HAVING count(*) FILTER (idx < 3) > 0")
def nested_candidates(spark, d):
    own = _lists(spark, d)
    return own.select("example_id", F.col("candidate_count").cast("long").alias("candidate_count"), F.array_join(F.transform("candidates", lambda c: c["candidate_id"]), ",").alias("ids"))


@query("WITH m AS (SELECT doc_id // 3 AS example_id, count(DISTINCT doc_id % 5) AS m FROM labels GROUP BY 1) SELECT count(*) AS examples, count(*) FILTER (m >= 2) AS complete FROM m")
def complete_examples(spark, d):
    own = table(spark, d, "labels").select(F.expr("doc_id div 3").alias("example_id"), (F.col("doc_id") % 5).alias("candidate_index"))
    return datasets.complete(own, "example_id", 2)


@query("SELECT doc_id, coalesce('l' || quality, lang) AS value FROM documents LEFT JOIN labels USING (doc_id) UNION SELECT doc_id, 'l' || quality FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def merged_maps(spark, d):
    first = table(spark, d, "documents").select("doc_id", F.col("lang").alias("value"))
    return datasets.merged_maps(first, table(spark, d, "labels").select("doc_id", F.concat(F.lit("l"), "quality").alias("value")), ["doc_id"])


_SCORES = f"""{_PARTS}, sc AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'glm__' ELSE '' END AS provider, quality * 20 + 1 AS total FROM labels), c AS (SELECT parts.*, provider, total FROM parts JOIN sc USING (doc_id))"""


def _candidates(spark, d):
    own = _parts(spark, d).withColumns({"example_id": F.col("example_id").cast("string"), "candidate_id": F.when(F.col("doc_id") % 3 != 0, F.col("candidate_id")), "user_id": F.col("example_id") % 7, "temperature": convert.cycled([0.7, 0.9, 1.1], F.col("candidate_index"))}).drop("cot")
    scores = table(spark, d, "labels").select(
        F.expr("cast(doc_id div 4 as string)").alias("example_id"), (F.col("doc_id") % 4).cast("int").alias("candidate_index"), F.when(F.col("doc_id") % 6 == 0, F.concat(F.lit("s"), "doc_id")).alias("candidate_id"), (F.col("quality") * 20 + 1).alias("rubric_total"), F.lit(None).cast("double").alias("score_norm"),
        F.when(F.col("doc_id") % 2 == 0, "glm__").alias("judge_provider"), F.lit("m").alias("judge_model"), F.lit(True).alias("judge_used_target"),
    )
    return datasets.scored_candidates(own, scores)


@query(f"""WITH {_SCORES} SELECT CAST(example_id AS VARCHAR) AS example_id, idx AS candidate_index, CASE WHEN doc_id % 3 <> 0 THEN 'c' || doc_id WHEN doc_id % 6 = 0 THEN 's' || doc_id ELSE example_id || '-' || idx END AS candidate_id, md5({_TAGGED}) AS cot, answer AS source_answer, round(total / 25.0::DOUBLE, 6) AS norm, CASE WHEN provider = '' THEN 'api' ELSE 'api_glm' END AS judge_mode, CASE idx WHEN 0 THEN 0.7 WHEN 1 THEN 0.9 WHEN 2 THEN 1.1 ELSE 0.7 END::DOUBLE AS temperature FROM c""")
def scored_candidates(spark, d):
    own = _candidates(spark, d)
    return own.select("example_id", "candidate_index", "candidate_id", F.md5("cot").alias("cot"), "source_answer", F.round("rubric_score_norm", 6).alias("norm"), "judge_mode", "temperature")


@query(f"WITH {_SCORES} SELECT CAST(example_id AS VARCHAR) AS example_id, min(doc_id) AS doc_id, any_value(example_id) % 7 AS user_id FROM c GROUP BY 1")
def example_projection(spark, d):
    """The examples of scored candidates, without what belongs to a candidate."""
    return datasets.example_rows(_candidates(spark, d), [F.asc("candidate_index")])


@query("WITH s AS (SELECT doc_id // 5 AS k FROM labels UNION ALL SELECT doc_id // 5 FROM labels WHERE doc_id % 2 = 0) SELECT count(DISTINCT k) AS keys, count(*) - count(DISTINCT k) AS duplicates FROM s")
def duplicate_scores(spark, d):
    own = table(spark, d, "labels").select(F.expr("doc_id div 5").alias("k"))
    return core.duplicate_keys(own.unionByName(table(spark, d, "labels").filter("doc_id % 2 = 0").select(F.expr("doc_id div 5").alias("k"))), ["k"])


@query(f"""WITH {A.TAGGED}, p AS (SELECT doc_id, {strip("regexp_extract(raw, '(?is)<thinking>(.*?)</thinking>', 1)")} AS th, {strip("regexp_extract(raw, '(?is)<recommendation>(.*?)</recommendation>', 1)")} AS an, {strip('raw')} AS whole FROM tagged)
SELECT doc_id, CAST(doc_id % 9 AS INTEGER) AS cot_rank, md5('assistant:' || CASE WHEN th <> '' AND an <> '' THEN '<think>' || {_NL} || th || {_NL} || '</think>' || {_NL} || '<answer>' || {_NL} || an || {_NL} || '</answer>' ELSE '<think>' || {_NL} || {strip("regexp_replace(whole, '(?i)</?(analysis|think|thinking|thoughts|recommendation|answer)>', '', 'g')")} || {_NL} || '</think>' || {_NL} || '<answer>' || {_NL} || coalesce(nullif(CASE WHEN doc_id % 2 = 0 THEN an ELSE whole END, ''), nullif(CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'given ' || doc_id END, ''), {quoted(T.DEFAULT_ANSWER)}) || {_NL} || '</answer>' END) AS last_message, CAST(3 AS INTEGER) AS n, 'c' || doc_id AS candidate_id, CAST(NULL AS VARCHAR) AS dataset, doc_id || ',' || (doc_id + 1) AS history FROM p""")
def sft_conversations(spark, d):
    """Conversations of three messages with fixed columns and the diagnostics that are there; untagged texts fall back to their own answer."""
    k = F.col("doc_id")
    own = A.tagged(spark, d).withColumns({"cot_rank": (k % 9).cast("int"), "judge_raw": F.lit("x"), "example_id": k, "candidate_id": F.concat(F.lit("c"), k), "history_item_id": F.array(k, k + 1), "source_answer": F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("given "), k))})
    rows = datasets.conversation_rows(own, "raw", F.lit("prompt"), "system text")
    last = F.element_at("messages", -1)
    return rows.select(F.col("example_id").alias("doc_id"), "cot_rank", F.md5(F.concat(last["role"], F.lit(":"), last["content"])).alias("last_message"), F.size("messages").alias("n"), "candidate_id", "dataset", F.array_join(F.transform("history_item_ids", lambda x: x.cast("string")), ",").alias("history"))


@query(f"""WITH {A.EXAMPLES}, g AS (SELECT user_id, string_agg(title || ' (' || rating || ' stars)', '; ' ORDER BY pos) AS listed, list(item_id ORDER BY pos) AS ids, count(*) AS m FROM hist GROUP BY 1), l AS (SELECT user_id, rating FROM inter WHERE pos = n),
x AS (SELECT user_id, aim.target_item_id, aim.target_title, l.rating, listed, ids, m, CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS category FROM aim JOIN g USING (user_id) JOIN l USING (user_id) WHERE m >= 3 AND l.rating >= 2)
SELECT md5(listed || '.') AS query, {compact("'Item: ' || target_title")} AS positive, category, 'train' AS split, CAST(user_id AS VARCHAR) AS user_id, row_number() OVER (PARTITION BY category ORDER BY user_id) - 1 AS interaction_id, target_item_id, target_title AS target_item_title, CAST(rating AS DOUBLE) AS target_rating, array_to_string(ids[-least(m, 5):], ',') AS history_item_ids, CAST(least(m, 5) AS INTEGER) AS history_item_count FROM x""")
def first_phase_pairs(spark, d):
    """Pairs of history and target before any reasoning, numbered within their category."""
    own = A.examples(spark, d).withColumns({"rating": F.col("target_rating").cast("double"), "item_id": F.col("target_item_id"), "item_title": F.col("target_title")})
    own = datasets.eligible(own, "history_title", "history_rating", "rating", least_history=3, least_rating=2)
    entry = lambda r: F.concat(r["history_title"], F.lit(" ("), T.number(r["history_rating"].cast("double")), F.lit(" stars)"))
    listed = F.concat(F.array_join(F.transform(F.arrays_zip("history_title", "history_rating"), entry), "; "), F.lit("."))
    category = F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd")
    rows = datasets.first_pairs(own, F.md5(listed), T.compact(F.concat(F.lit("Item: "), "target_title")), category=category, split="train", position="user_id", last=5)
    return rows.withColumn("history_item_ids", F.array_join(F.transform("history_item_ids", lambda x: x.cast("string")), ","))


@query("SELECT doc_id, lang, (SELECT count(DISTINCT lang || '-' || (doc_id % 7)) FROM documents WHERE doc_id % 2 = 0) AS first_asked, (SELECT count(DISTINCT lang || '-' || (doc_id % 7)) FROM documents) - (SELECT count(DISTINCT lang || '-' || (doc_id % 7)) FROM documents WHERE doc_id % 2 = 0) AS then_asked, length(lang || '-' || (doc_id % 7)) * 2 AS value FROM documents WHERE lang IS NOT NULL")
def lasting_memo(spark, d):
    """Two runs over a store: the first asks for the keys of even documents, the second only for the rest."""
    docs = table(spark, d, "documents").filter("lang is not null").select("doc_id", "lang", F.concat_ws("-", "lang", (F.col("doc_id") % 7).cast("string")).alias("key"))
    store = Memo(spark, scratch(spark, "memo"), "key", "value long")
    compute = lambda rows: rows.select("key", (F.length("key") * 2).cast("long").alias("value"))
    store.values(docs.filter("doc_id % 2 = 0"), compute)
    first = store.read().count()
    out = store.values(docs, compute)
    then = store.read().count() - first
    return out.select("doc_id", "lang", F.lit(first).cast("long").alias("first_asked"), F.lit(then).cast("long").alias("then_asked"), "value")


@query("SELECT doc_id, md5(text) AS made FROM documents")
def resumed_stage(spark, d):
    """A stage over files that fails after the first ones and is run again: every row comes once."""
    source, out, docs = scratch(spark, "tasks"), scratch(spark, "done"), table(spark, d, "documents").select("doc_id", "text")
    docs.repartition(max(4, docs.rdd.getNumPartitions()), "doc_id").write.json(source)  # files in proportion to the input
    runs = []

    def made(batch):
        runs.append(1)
        if len(runs) == 3:
            raise RuntimeError("stopped on purpose")
        return batch.select("doc_id", F.md5("text").alias("made"))

    try:
        resumable.run_stage(spark, source, "doc_id long, text string", made, out)
    except Exception as e:  # noqa: BLE001  (the stop comes wrapped)
        if "stopped on purpose" not in str(e):
            raise
    resumable.run_stage(spark, source, "doc_id long, text string", made, out)
    return resumable.stage_rows(spark, out).select("doc_id", "made")


_CHAT = f"""u AS (SELECT conv_id, CASE WHEN conv_id % 6 <> 0 THEN CAST(conv_id AS VARCHAR) END AS example_id, conv_id % 5 AS user_id, conv_id AS interaction_id, coalesce(arg_min(text, turn) FILTER (role = 'user'), '') AS said FROM conversations GROUP BY conv_id),
h AS (SELECT *, {compact('said')} AS history FROM u)"""


def _chats(spark, d):
    """Conversations as rows with messages; the first user's text stands between interaction tags in every other one."""
    rows = table(spark, d, "conversations").filter("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("said"))
    own = table(spark, d, "conversations").select("conv_id").distinct().join(rows, "conv_id", "left").withColumn("said", F.coalesce("said", F.lit("")))
    k = F.col("conv_id")
    text = F.when(k % 2 == 0, F.concat(F.lit("Before <Historical Interactions>\n "), "said", F.lit("\n</Historical Interactions> after"))).otherwise(F.col("said"))
    messages = F.array(F.struct(F.lit("system").alias("role"), F.lit("s").alias("content")), F.struct(F.lit("user").alias("role"), text.alias("content")))
    return own.select("conv_id", F.when(k % 6 != 0, k.cast("string")).alias("example_id"), (k % 5).alias("user_id"), k.alias("interaction_id"), messages.alias("messages"))


@query(f"""WITH {_CHAT}, by_id AS (SELECT * FROM h WHERE NOT (example_id IS NOT NULL AND conv_id % 4 = 1) AND conv_id % 7 <> 3), by_text AS (SELECT * FROM h WHERE history NOT IN (SELECT history FROM h WHERE conv_id % 8 = 2 AND history <> ''))
SELECT 'keys' AS rule, conv_id, md5(history) AS history FROM by_id UNION ALL SELECT 'histories', conv_id, md5(history) FROM by_text""")
def excluded_prompts(spark, d):
    """Exclusion by either key, and by history where the excluded rows have no key at all."""
    own = _chats(spark, d)
    none = F.lit(None)
    keyed = own.filter("conv_id % 4 = 1").withColumns({"user_id": none.cast("long"), "interaction_id": none.cast("long")}).unionByName(own.filter("conv_id % 7 = 3").withColumn("example_id", none.cast("string")))
    told = own.filter("conv_id % 8 = 2").withColumns({"example_id": none.cast("string"), "user_id": none.cast("long")})
    out = lambda rule, others: datasets.excluded(own, others).select(F.lit(rule).alias("rule"), "conv_id", F.md5(datasets.row_history(own)).alias("history"))
    return out("keys", keyed).unionByName(out("histories", told))


@query(f"WITH {_CHAT} SELECT conv_id FROM h WHERE conv_id % 7 <> 3 ORDER BY conv_id LIMIT 20")
def limited_prompts(spark, d):
    """A limit on what is left after the exclusion (the limit is the feature)."""
    own = _chats(spark, d)
    return datasets.excluded(own, own.filter("conv_id % 7 = 3")).orderBy("conv_id").limit(20).select("conv_id")


@query("WITH s AS (SELECT doc_id, doc_id % 4 AS k, quality FROM labels) SELECT doc_id, CASE k WHEN 0 THEN 20.0 WHEN 1 THEN 10.0 + quality END::DOUBLE AS total, CASE k WHEN 0 THEN 0.9 WHEN 1 THEN (10.0 + quality) / 25.0 END::DOUBLE AS norm FROM s")
def stored_scores(spark, d):
    """Stored scores: a numeric total is needed, a missing share is worked out."""
    k = F.col("doc_id") % 4
    total = F.when(k == 0, "20").when(k == 1, (F.lit(10) + F.col("quality")).cast("string")).when(k == 2, "many")
    own = table(spark, d, "labels").select("doc_id", stored_score(total, F.when(k == 0, 0.9)).alias("s"))
    return own.select("doc_id", "s.total", F.col("s.score_norm").alias("norm"))


# Ranks and statistics


@query("""WITH t AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT vec_id AS qid, e, CASE WHEN vec_id % 150 = 0 THEN vec_id + 1000000 ELSE vec_id + 1 END AS target FROM t WHERE vec_id % 50 = 0),
s AS (SELECT qid, target, vec_id, round(list_dot_product(q.e, t.e), 6) AS score FROM q CROSS JOIN t WHERE vec_id > 0), o AS (SELECT qid, score AS sim FROM s WHERE vec_id = target), m AS (SELECT count(*) AS n FROM t WHERE vec_id > 0)
SELECT s.qid, any_value(s.target) AS target, coalesce(any_value(sim), 0.0::DOUBLE) AS sim, CASE WHEN any_value(sim) IS NULL THEN any_value(n) + 1 ELSE 1 + count(*) FILTER (score > sim) END AS rank, CASE WHEN any_value(sim) IS NULL THEN 0.0::DOUBLE ELSE round(CASE WHEN 1 + count(*) FILTER (score > sim) <= 100 THEN 1 / log2(2 + count(*) FILTER (score > sim)) ELSE 0.0 END, 6) END AS ndcg FROM s LEFT JOIN o USING (qid), m GROUP BY s.qid""")
def missing_targets(spark, d):
    """Dense ranks of targets, some of which the catalogue lacks: similarity 0, a rank after all items, NDCG 0."""
    items_ = table(spark, d, "embeddings").filter("vec_id > 0").select(F.col("vec_id").alias("item_id"), F.col("embedding").cast("array<double>").alias("v"))
    k = F.col("vec_id")
    queries = table(spark, d, "embeddings").filter("vec_id % 50 = 0").select(k.alias("qid"), F.when(k % 150 == 0, k + 1000000).otherwise(k + 1).alias("target"), F.col("embedding").cast("array<double>").alias("v"))
    ranks = ranking.dense_ranks(queries, items_, "qid", "target")
    return ranks.select("qid", "target", "sim", "rank", F.round(F.when(F.col("known"), ndcg(F.col("rank"), 100)).otherwise(0.0), 6).alias("ndcg"))


@query("""WITH e AS (SELECT event_id, user_id % 40 AS u, event_type, value FROM events), b AS (SELECT md5('{"kind":"' || event_type || '","user":' || u || '}') AS key, count(*) AS n FROM e GROUP BY 1)
SELECT event_id, md5('{"kind":"' || event_type || '","user":' || u || '}') AS key, CASE WHEN u % 2 = 0 THEN -1 ELSE u END AS baseline FROM e""")
def cached_baselines(spark, d):
    """Baselines of keys: those of even users are cached, the others' are computed once for each key."""
    own = table(spark, d, "events").select("event_id", (F.col("user_id") % 40).alias("u"), "event_type")
    own = own.withColumn("key", convert.cache_key(kind=F.col("event_type"), user=F.col("u")))
    cached = own.filter("u % 2 = 0").select("key", F.lit(-1).cast("long").alias("baseline")).distinct()
    return datasets.with_baseline(own, cached, "key", lambda rows: rows.select("key", F.col("u").alias("baseline"))).select("event_id", "key", "baseline")


@query(f"WITH {A.SCORED} SELECT doc_id FROM scored WHERE doc_id % 5 = 0 AND gain >= 0.01")
def final_gains(spark, d):
    """Rows kept at last: gains that are missing, undefined or infinite never are."""
    k = F.col("doc_id") % 5
    nan = F.when(k == 1, float("nan")).when(k == 2, float("inf")).when(k == 3, float("-inf")).when(k == 4, None).otherwise(F.col("gain"))
    return selection.final_gain(A.scored(spark, d).withColumn("gain", nan), "gain", 0.01).select("doc_id")


@query(f"WITH {A.SCORED}, s AS (SELECT *, doc_id % 5 = 0 AND rubric >= 15 AND gain >= 0.01 AS ok, CASE WHEN doc_id % 5 = 0 THEN gain END AS g, rubric * greatest(CASE WHEN doc_id % 5 = 0 THEN gain ELSE 0 END, 0) AS sel FROM scored), r AS (SELECT *, row_number() OVER w AS rk, sum(ok::INT) OVER (w ROWS UNBOUNDED PRECEDING) AS passed, max(ok::INT) OVER (PARTITION BY example_id) AS anyok FROM s WINDOW w AS (PARTITION BY example_id ORDER BY sel DESC, rubric DESC, g DESC NULLS LAST, doc_id)) SELECT doc_id, CAST(rk AS INT) AS selection_rank, anyok = 0 AND rk = 1 AS fallback_selected, (anyok = 0 AND rk = 1) OR (ok AND passed <= 1) AS selected FROM r")
def select_with_odd_gains(spark, d):
    """Selection by group where gains are undefined, infinite or missing."""
    k = F.col("doc_id") % 5
    odd = F.when(k == 1, float("nan")).when(k == 2, float("inf")).when(k == 3, float("nan")).when(k == 4, None).otherwise(F.col("gain"))
    own = selection.top_k(A.scored(spark, d).withColumn("gain", odd), "example_id", 1, 15, 0.01, "doc_id", True)
    return own.select("doc_id", "selection_rank", "fallback_selected", "selected")


@query("""WITH n AS (SELECT n_chars AS v FROM documents), r AS (SELECT 1 + n_chars % 50 AS r FROM documents), s AS (SELECT list_sort(list(r)) AS l FROM r)
SELECT count(v) AS count, min(v) AS min, max(v) AS max, round(avg(v), 2) AS mean, round(quantile_cont(v, 0.5), 2) AS p50, round(quantile_cont(v, 0.9), 2) AS p90, round(quantile_cont(v, 0.95), 2) AS p95, round(quantile_cont(v, 0.99), 2) AS p99, (SELECT round(avg(r), 2) FROM r) AS rank_mean, (SELECT l[len(l) // 2 + 1] FROM s) AS rank_p50 FROM n""")
def numeric_summaries(spark, d):
    """Statistics of lengths (interpolated percentiles) and of ranks (upper median)."""
    docs = table(spark, d, "documents").select("n_chars", (1 + F.col("n_chars") % 50).alias("r"))
    ranks = selection.rank_stats(docs, "r").select(F.col("mean").alias("rank_mean"), F.col("p50").alias("rank_p50"))
    return selection.numeric_stats(docs, "n_chars").join(F.broadcast(ranks))


@query(f"WITH {A.SCORED}, s AS (SELECT *, rubric * greatest(gain, 0) AS sel, doc_id % 7 AS nd FROM scored WHERE rubric >= 12 AND gain >= 0), c AS (SELECT CAST(ceil(count(*) * 0.3::DOUBLE) AS BIGINT) AS k FROM s) SELECT doc_id, CAST(rn AS INTEGER) AS selection_rank FROM (SELECT *, row_number() OVER (ORDER BY sel DESC, rubric DESC, gain DESC, nd DESC, doc_id) AS rn FROM s), c WHERE rn <= k")
def ranked_top_percent(spark, d):
    """The best share of all rows with their ranks, NDCG being the last key before the place."""
    own = A.scored(spark, d).withColumn("nd", F.col("doc_id") % 7)
    return selection.ranked_share(own, 0.3, 12, 0, "doc_id", "nd").select("doc_id", "selection_rank")


@query("WITH r AS (SELECT 1 + doc_id * 7 % 30 AS r FROM documents) SELECT " + ", ".join(f"round(avg((r <= {k})::INT::DOUBLE), 6) AS hr_{k}, round(avg(CASE WHEN r <= {k} THEN 1 / log2(r + 1.0::DOUBLE) ELSE 0 END), 6) AS ndcg_{k}" for k in (5, 10, 20)) + " FROM r")
def cutoff_metrics(spark, d):
    """Metrics at the cutoffs that a list in text names."""
    ranks = table(spark, d, "documents").select((1 + F.col("doc_id") * 7 % 30).alias("rank"))
    return ranking.metrics(ranks, "rank", tuple(convert.numbers_in("5, 10,,20"))).drop("n", "mean_rank", "median_rank")


_HR = lambda r, k: f"round(avg(({r} <= {k})::INT::DOUBLE), 6)"


@query(f"""WITH r AS (SELECT 1 + doc_id * 7 % 30 AS a, 1 + doc_id * 11 % 30 AS b FROM documents), m AS (SELECT {_HR('a', 5)} AS hr_5_baseline, {_HR('b', 5)} AS hr_5_reasoner, round(avg(CASE WHEN a <= 5 THEN 1 / log2(a + 1.0::DOUBLE) ELSE 0 END), 6) AS ndcg_5_baseline, round(avg(CASE WHEN b <= 5 THEN 1 / log2(b + 1.0::DOUBLE) ELSE 0 END), 6) AS ndcg_5_reasoner, round(avg(a), 6) AS mean_rank_baseline, round(avg(b), 6) AS mean_rank_reasoner FROM r)
SELECT *, round(hr_5_reasoner - hr_5_baseline, 6) AS delta_hr_5, round(ndcg_5_reasoner - ndcg_5_baseline, 6) AS delta_ndcg_5, round(mean_rank_reasoner - mean_rank_baseline, 6) AS delta_mean_rank FROM m""")
def metric_deltas(spark, d):
    """Metrics of two runs over the same targets and their differences."""
    docs = table(spark, d, "documents")
    of = lambda by: ranking.metrics(docs.select((1 + F.col("doc_id") * by % 30).alias("rank")), "rank", (5,)).drop("n", "median_rank")
    own = ranking.compared({"baseline": of(7), "reasoner": of(11)})
    return own.withColumns({c: F.round(c, 6) for c in own.columns if c.startswith("delta_")})


# Conversions, shards, orders


@query("""WITH t AS (SELECT event_id, event_id % 4 AS k, user_id AS u FROM events)
SELECT event_id, CASE k WHEN 0 THEN '[1, ' || CASE WHEN u = 1 THEN '' ELSE '' END || u || ']' ELSE '' END AS raw, CASE k WHEN 0 THEN array_to_string(list_sort(list_distinct([1, u])), ',') WHEN 1 THEN array_to_string(list_sort(list_distinct([-3, u])), ',') WHEN 2 THEN '' ELSE CAST(u AS VARCHAR) END AS numbers, array_to_string(list_sort(list_distinct([u, u // 2])), ',') AS own FROM t""")
def whole_number_sets(spark, d):
    """Sets of whole numbers out of JSON lists, free text, blanks and loosely typed arrays."""
    k, u = F.col("event_id") % 4, F.col("user_id")
    text = F.when(k == 0, F.concat(F.lit("[1, "), u, F.lit("]"))).when(k == 1, F.concat(F.lit("ids "), u, F.lit(" and -3; "), u)).when(k == 2, "  ").otherwise(F.concat(F.lit("[x "), u))
    joined = lambda s: F.array_join(F.transform(s, lambda x: x.cast("string")), ",")
    loose = F.array(u.cast("string"), F.lit("x"), F.expr("cast(user_id div 2 as string)"), F.lit(None).cast("string"), u.cast("string"))
    return table(spark, d, "events").select("event_id", F.when(k == 0, text).otherwise("").alias("raw"), joined(convert.int_set_in_text(text)).alias("numbers"), joined(convert.int_set(loose)).alias("own"))


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT vec_id, e[1:16] AS a, e FROM v), n AS (SELECT vec_id, list_transform(a, lambda x: x / sqrt(list_dot_product(a, a))) AS u, list_transform(list_zip(e[1:4], e[5:8]), lambda z: (z[1] + z[2]) / 2) AS m FROM p)
SELECT vec_id, round(list_dot_product(u, u), 6) AS size, round(u[3], 6) AS third, round(m[2] / sqrt(list_dot_product(m, m)), 6) AS pooled FROM n""")
def vector_forms(spark, d):
    """A vector's prefix at length one, and the mean of those rows of a matrix that a mask lets through."""
    e = F.col("embedding").cast("array<double>")
    p = convert.prefix(e, 16)
    pooled = convert.masked_mean(F.array(F.slice(e, 1, 4), F.slice(e, 9, 4), F.slice(e, 5, 4)), F.array(F.lit(1), F.lit(0), F.lit(1)))
    return table(spark, d, "embeddings").select("vec_id", p.alias("p"), pooled.alias("m")).select("vec_id", F.round(convert.dot(F.col("p"), F.col("p")), 6).alias("size"), F.round(F.col("p")[2], 6).alias("third"), F.round(F.col("m")[1], 6).alias("pooled"))


@query("""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS pos FROM documents) SELECT doc_id, CAST((pos - 1) % 3 AS INTEGER) AS by_place, coalesce(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 16))::UBIGINT % 4 = 2, FALSE) AND doc_id % 9 <> 0 AS in_shard FROM r""")
def shard_membership(spark, d):
    """Shards by place and by key; blank keys are in no shard."""
    own = table(spark, d, "documents").select(F.col("doc_id").alias("item_id"))
    own = ranking.numbered(own, "item_id", "place").withColumnRenamed("item_id", "doc_id")
    key = F.when(F.col("doc_id") % 9 != 0, F.col("doc_id").cast("string")).otherwise("")
    return own.select("doc_id", core.position_shard(F.col("place") + 1, 3).alias("by_place"), core.in_shard(key, 4, 2).alias("in_shard"))


@query("SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 50")
def seeded_sample(spark, d):
    """The first fifty rows of an order that a seed fixes (a sampling feature)."""
    return datasets.seeded_order(table(spark, d, "documents").select("doc_id"), 42, "doc_id").limit(50)


@query(f"WITH {_PARTS}, e AS (SELECT DISTINCT example_id FROM parts WHERE idx < 3 ORDER BY example_id LIMIT 20) SELECT example_id, idx AS candidate_index FROM parts JOIN e USING (example_id) WHERE idx < 3 AND {strip('answer')} <> '' ORDER BY example_id, idx LIMIT 30")
def limited_tasks(spark, d):
    """Candidates with an answer under two independent limits (the limits are the feature)."""
    own = datasets.limited_tasks(_lists(spark, d).select("example_id", "candidates"), "example_id", "candidates", examples=20, tasks=30)
    return own.select("example_id", "candidate.candidate_index")


@query("SELECT doc_id, coalesce('c' || quality, '') AS cot, FALSE AS required FROM documents LEFT JOIN labels USING (doc_id) UNION ALL SELECT doc_id, 'c' || quality, TRUE FROM documents JOIN labels USING (doc_id)")
def reasoning_lookup(spark, d):
    """Examples with their reasoning, with and without requiring one."""
    cot = table(spark, d, "labels").select(F.col("doc_id"), F.concat(F.lit("c"), "quality").alias("cot"))
    own = table(spark, d, "documents").select("doc_id")
    both = [datasets.with_reasoning_of(own, cot, "doc_id", required=r).select("doc_id", "cot", F.lit(r).alias("required")) for r in (False, True)]
    return both[0].unionByName(both[1])


@query("""WITH r AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) - 1 AS k FROM (SELECT DISTINCT conv_id FROM conversations)) SELECT CASE WHEN conv_id % 2 = 0 THEN 'CDs_and_Vinyl' ELSE 'Books' END || ':train:' || CASE WHEN conv_id % 3 = 0 THEN k ELSE conv_id END || ':' || CASE WHEN conv_id % 4 = 0 THEN '' ELSE CAST(conv_id % 5 AS VARCHAR) END AS example_id, 'p' || conv_id AS target_item_text FROM r""")
def pairs_to_examples(spark, d):
    """Training pairs as examples: keys from parts, missing interactions numbered by place."""
    k = F.col("conv_id")
    own = table(spark, d, "conversations").select("conv_id").distinct()
    own = own.select(k, F.when(k % 2 != 0, "Books").alias("category"), F.when(k % 3 != 0, k).alias("interaction_id"), F.when(k % 4 != 0, (k % 5).cast("string")).alias("user_id"), F.concat(F.lit("p"), k).alias("positive"))
    return datasets.pair_examples(own, dataset="made", position="conv_id").select("example_id", "target_item_text")


@query("SELECT p_partkey AS item_id, row_number() OVER (ORDER BY p_partkey) - 1 AS position FROM part")
def item_positions(spark, d):
    """The place of each item by its id."""
    return jsonl.item_index(table(spark, d, "part").select(F.col("p_partkey").alias("item_id"))).select("item_id", "position")


@query(f"WITH {A.EXAMPLES}, g AS (SELECT user_id, count(*) AS m FROM hist GROUP BY 1), x AS (SELECT user_id, rating, coalesce(m, 0) AS m FROM (SELECT user_id, rating FROM inter WHERE pos = n) LEFT JOIN g USING (user_id)) SELECT CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS category, count(*) AS source_rows, count(*) FILTER (m >= 3 AND rating >= 2) AS written, count(*) FILTER (NOT (m >= 3 AND rating >= 2)) AS skipped, count(*) FILTER (m < 3) AS short FROM x GROUP BY 1")
def example_statistics(spark, d):
    """What the making of examples reports: rows read, written and skipped by category, and histories that are too short."""
    own = A.examples(spark, d).withColumn("category", F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd"))
    enough = (F.size("history_title") >= 3) & (F.col("target_rating") >= 2)
    return datasets.stage_counts(own, enough, "category", short=F.size("history_title") < 3)


@query(f"WITH {A.SCORED}, r AS (SELECT example_id, count(*) AS n, count(*) FILTER (rubric >= 15 AND gain >= 0.01) AS ok FROM scored GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS source_rows, CAST(sum(CASE WHEN ok = 0 THEN 1 ELSE least(ok, 2) END) AS BIGINT) AS written, CAST(sum(n) - sum(CASE WHEN ok = 0 THEN 1 ELSE least(ok, 2) END) AS BIGINT) AS skipped, count(*) FILTER (ok = 0) AS fallback FROM r")
def selection_statistics(spark, d):
    """What a selection reports: candidates read, selected and left, and examples whose best failing one was taken."""
    own = selection.top_k(A.scored(spark, d), "example_id", 2, 15, 0.01, "doc_id", True)
    return datasets.stage_counts(own, F.col("selected"), fallback=F.col("fallback_selected"))
