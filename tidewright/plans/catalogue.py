"""All queries over the engine's own operators, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.functions import convert, rewards
from tidewright.functions import rubric as R
from tidewright.functions import text as T
from tidewright.operators import core, dense, order, postings, ranking, selection, vectors
from tidewright.operators import rewards as stage
from tidewright.plans import adapters as A
from tidewright.plans import files, items, reasoning, registry, training  # noqa: F401  (their queries are registered)
from tidewright.plans.registry import ORACLES, QUERIES, query  # noqa: F401
from tidewright.sources.tables import table, written
from tidewright.streaming import events as S

_WS, _STRIP, _COMPACT, _WORDS = registry.WS, registry.strip, registry.compact, registry.word_list


# Text


@query(f"WITH c AS (SELECT doc_id, {_COMPACT('text')} AS t FROM documents) SELECT doc_id, md5(t) AS whole, length(t) AS n, CASE WHEN length(t) <= 200 THEN t ELSE regexp_replace(left(t, 185), '{_WS}+$', '') || ' [TRUNCATED]' END AS cut FROM c")
def text_compact_truncate(spark, d):
    t = T.compact(F.col("text"))
    return A.documents(spark, d).select("doc_id", F.md5(t).alias("whole"), F.length(t).cast("long").alias("n"), T.compact(F.col("text"), 200).alias("cut"))


@query(f"""WITH c AS (SELECT doc_id, len({_WORDS('text')}) AS words, len(list_filter(regexp_split_to_array(text, '{_WS}+'), lambda x: x <> '')) AS runs FROM documents)
SELECT doc_id, words, runs, CASE WHEN words BETWEEN 70 AND 220 THEN 5 WHEN words BETWEEN 45 AND 280 THEN 4 WHEN words BETWEEN 25 AND 360 THEN 3 WHEN words > 0 THEN 2 ELSE 1 END AS band FROM c""")
def token_counts(spark, d):
    return A.documents(spark, d).select("doc_id", T.word_count(F.col("text")).alias("words"), F.size(T.runs(F.col("text"))).cast("long").alias("runs")).withColumn("band", R.conciseness(F.col("words")))


@query(f"""WITH c AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '{_WS}+'), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, md5(CASE WHEN len(w) <= 30 THEN text ELSE array_to_string(w[1:30], ' ') END) AS cut FROM c""")
def truncate_words(spark, d):
    return A.documents(spark, d).select("doc_id", F.md5(T.first_words(F.col("text"), 30)).alias("cut"))


@query(f"""WITH {A.TAGGED}, b AS (SELECT doc_id, raw, regexp_matches(raw, '(?is)<(?:analysis|think|thinking|thoughts)>(.*?)</(?:analysis|think|thinking|thoughts)>\\s*<(?:recommendation|answer)>(.*?)</(?:recommendation|answer)>') AS has FROM tagged)
SELECT doc_id, has AS has_tags, CASE WHEN has THEN md5({_STRIP("regexp_extract(raw, '(?is)<thinking>(.*?)</thinking>', 1)")}) ELSE md5('') END AS think,
CASE WHEN has THEN md5({_STRIP("regexp_extract(raw, '(?is)<recommendation>(.*?)</recommendation>', 1)")}) ELSE md5({_STRIP('raw')}) END AS answer FROM b""")
def tag_extract(spark, d):
    b = A.tagged(spark, d).withColumn("b", T.blocks(F.col("raw")))
    return b.select("doc_id", "b.has_tags", F.md5("b.think").alias("think"), F.md5("b.answer").alias("answer"))


@query(f"""WITH {A.TAGGED}, c AS (SELECT doc_id, {_STRIP("replace(replace(replace(replace(raw, '<Thinking>', '<think>'), '</thinking>', '</think>'), '<recommendation>', '<answer>'), '</RECOMMENDATION>', '</answer>')")} AS t FROM tagged)
SELECT doc_id, md5(t) AS canonical, md5(CASE WHEN doc_id % 2 = 0 THEN {_STRIP("regexp_extract(t, '(?s)<answer>(.*)</answer>', 1)")} ELSE {_STRIP("substr(t, 15)")} END) AS answer FROM c""")
def answer_extract(spark, d):
    return A.tagged(spark, d).select("doc_id", F.md5(T.canonical_tags(F.col("raw"))).alias("canonical"), F.md5(T.answer_of(F.col("raw"))).alias("answer"))


# Items and histories


@query(f"SELECT p_partkey AS item_id, {_COMPACT("p_name || ' ' || p_type || ' ' || p_brand || ' Categories: ' || p_type || ' > ' || p_brand || ' Description: size ' || p_size")} AS text, 'avg_rating=' || CAST(CAST(p_retailprice AS DECIMAL(12,1)) AS VARCHAR) || ', rating_count=' || p_size AS stats FROM part")
def item_text(spark, d):
    return A.items(spark, d).select("item_id", T.compact(F.concat_ws(" ", *[F.nullif(T.compact(F.col(c), 300), F.lit("")) for c in ("title", "main_category", "store")], F.concat(F.lit("Categories: "), F.concat_ws(" > ", "main_category", "store")), F.concat(F.lit("Description: size "), F.col("rating_number")))).alias("text"), F.concat_ws(", ", F.concat(F.lit("avg_rating="), F.col("average_rating").cast("decimal(12,1)")), F.concat(F.lit("rating_count="), F.col("rating_number"))).alias("stats"))


@query(f"WITH {A.EXAMPLES} SELECT user_id, string_agg(title || ' (' || rating || ' stars)', '; ' ORDER BY pos) || '.' AS plain, md5(string_agg((k + 0) || '. ' || title || ' (' || rating || ' stars)', chr(10) ORDER BY pos)) AS numbered FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pos) AS k FROM hist) GROUP BY user_id")
def history_text(spark, d):
    entry = lambda r: F.concat(r["history_title"], F.lit(" ("), T.number(r["history_rating"].cast("double")), F.lit(" stars)"))
    rows = F.arrays_zip("history_title", "history_rating")
    return A.examples(spark, d).filter(F.size("history_title") > 0).select("user_id", F.concat(F.array_join(F.transform(rows, entry), "; "), F.lit(".")).alias("plain"), F.md5(F.array_join(F.transform(rows, lambda r, i: F.concat(i + 1, F.lit(". "), entry(r))), "\n")).alias("numbered"))


@query(f"WITH {A.INTER} SELECT user_id, array_to_string(list(item_id ORDER BY pos), ',') AS last_ids FROM inter WHERE pos > n - 5 GROUP BY user_id")
def last_n_history(spark, d):
    own = A.recent(spark, d, 5).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("at", "item_id"))).alias("r"))
    return own.select("user_id", F.array_join(F.transform("r", lambda x: x["item_id"].cast("string")), ",").alias("last_ids"))


@query(f"WITH {A.INTER}, t AS (SELECT user_id, coalesce(max(CASE WHEN rating >= 4 AND pos > 3 THEN pos END), max(pos)) AS target_pos FROM inter GROUP BY user_id) SELECT t.user_id, t.target_pos, count(i.item_id) AS n_before, coalesce(sum(i.item_id), 0)::BIGINT AS id_sum FROM t LEFT JOIN inter i ON i.user_id = t.user_id AND i.pos < t.target_pos AND i.pos >= t.target_pos - 10 GROUP BY 1, 2")
def choose_target(spark, d):
    own = A.interactions(spark, d)
    aim = own.groupBy("user_id").agg(F.coalesce(F.max(F.when((F.col("rating") >= 4) & (F.col("pos") > 3), F.col("pos"))), F.max("pos")).alias("target_pos"))
    before = own.join(aim, "user_id").filter("pos < target_pos and pos >= target_pos - 10").groupBy("user_id").agg(F.count("*").alias("n"), F.sum("item_id").alias("s"))
    return aim.join(before, "user_id", "left").select("user_id", F.col("target_pos").cast("long").alias("target_pos"), F.coalesce("n", F.lit(0)).alias("n_before"), F.coalesce("s", F.lit(0)).alias("id_sum"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) > 50 THEN 'Label=' || json_extract_string(props, '$.k') ELSE '' END AS details FROM events")
def details_parse(spark, d):
    k = F.from_json("props", "map<string,string>")["k"]
    return table(spark, d, "events").select("event_id", k.alias("k"), F.when(k.cast("int") > 50, F.concat(F.lit("Label="), k)).otherwise("").alias("details"))


# Chats


@query("SELECT conv_id, count(*) AS n, md5(string_agg(role || ':' || coalesce(text, ''), chr(10) ORDER BY turn)) AS chat, md5(coalesce(arg_min(text, turn) FILTER (role = 'user'), '')) AS first_user FROM conversations GROUP BY conv_id")
def chat_messages(spark, d):
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    user = F.try_element_at(F.filter("m", lambda x: x["role"] == "user"), F.lit(1))["text"]
    return rows.select("conv_id", F.size("m").cast("long").alias("n"), F.md5(F.array_join(F.transform("m", lambda x: F.concat(x["role"], F.lit(":"), F.coalesce(x["text"], F.lit("")))), "\n")).alias("chat"), F.md5(F.coalesce(user, F.lit(""))).alias("first_user"))


@query("""WITH u AS (SELECT conv_id, arg_min(text, turn) FILTER (role = 'user') AS q FROM conversations GROUP BY conv_id), l AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1)
SELECT conv_id, md5('user' || chr(10) || coalesce(q, '')) AS prompt FROM u WHERE conv_id NOT IN (SELECT doc_id FROM l) AND conv_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)""")
def grpo_rows(spark, d):
    c, lab = table(spark, d, "conversations"), table(spark, d, "labels").withColumnRenamed("doc_id", "conv_id")
    first = c.filter("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("q"))
    rows = c.select("conv_id").distinct().join(first, "conv_id", "left")
    return core.without(rows, (lab.filter("toxic = 1"), ["conv_id"]), (lab.filter("quality = 0"), ["conv_id"])).select("conv_id", F.md5(F.concat(F.lit("user\n"), F.coalesce("q", F.lit("")))).alias("prompt"))


@query(f"""WITH {A.TAGGED}, s AS (SELECT doc_id, {_STRIP("regexp_extract(raw, '(?is)<thinking>(.*?)</thinking>', 1)")} AS th, {_STRIP("regexp_extract(raw, '(?is)<recommendation>(.*?)</recommendation>', 1)")} AS an, {_STRIP('raw')} AS whole FROM tagged)
SELECT doc_id, md5(CASE WHEN th <> '' AND an <> '' THEN '<think>' || chr(10) || th || chr(10) || '</think>' || chr(10) || '<answer>' || chr(10) || an || chr(10) || '</answer>'
ELSE '<think>' || chr(10) || {_STRIP("regexp_replace(whole, '(?i)</?(analysis|think|thinking|thoughts|recommendation|answer)>', '', 'g')")} || chr(10) || '</think>' || chr(10) || '<answer>' || chr(10) || 'Use the grounded reasoning above as a concise user preference profile.' || chr(10) || '</answer>' END) AS assistant,
CASE WHEN th <> '' AND an <> '' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS format_reward FROM s""")
def sft_rows(spark, d):
    b = T.blocks(F.col("raw"))
    return A.tagged(spark, d).select("doc_id", F.md5(T.tagged_assistant(F.col("raw"))).alias("assistant"), F.when(b["has_tags"] & (b["think"] != "") & (b["answer"] != ""), 1.0).otherwise(0.0).alias("format_reward"))


# Ranking


_RANK = A.EXAMPLES + """, q AS (SELECT a.user_id, a.target_item_id, coalesce(string_agg(h.title, ' ' ORDER BY h.pos), '') AS text FROM aim a LEFT JOIN hist h USING (user_id) GROUP BY 1, 2),
qt AS (SELECT user_id, tok, count(*) AS tf FROM (SELECT user_id, unnest(regexp_extract_all(lower(text), '[A-Za-z0-9][A-Za-z0-9''-]*')) AS tok FROM q) GROUP BY 1, 2), qn AS (SELECT user_id, sum(tf * tf) AS qn FROM qt GROUP BY 1),
names AS (SELECT DISTINCT p_name FROM part), it AS (SELECT p_name, tok, count(*) AS tf FROM (SELECT p_name, unnest(regexp_extract_all(lower(p_name), '[A-Za-z0-9][A-Za-z0-9''-]*')) AS tok FROM names) GROUP BY 1, 2), itn AS (SELECT p_name, sum(tf * tf) AS tn FROM it GROUP BY 1),
dots AS (SELECT user_id, p_name, sum(qt.tf * it.tf) AS dot FROM qt JOIN it USING (tok) GROUP BY 1, 2),
sc AS (SELECT user_id, p_name, dot / sqrt((qn * tn)::DOUBLE) AS score FROM dots JOIN qn USING (user_id) JOIN itn USING (p_name)),
own AS (SELECT q.user_id, target_item_id, coalesce(score, 0.0::DOUBLE) AS sim FROM q JOIN part ON p_partkey = target_item_id LEFT JOIN sc USING (user_id, p_name)),
full_sc AS (SELECT o.user_id, o.sim, o.target_item_id, p.p_partkey AS item_id, coalesce(s.score, 0.0::DOUBLE) AS score FROM own o CROSS JOIN part p LEFT JOIN sc s ON s.user_id = o.user_id AND s.p_name = p.p_name)"""
_NDCG = lambda r, k: f"CASE WHEN {r} <= {k} THEN 1.0::DOUBLE / log2({r} + 1.0::DOUBLE) ELSE 0.0::DOUBLE END"


def _queries(spark, d):
    """Written once: the ranking's branches would each make the histories again."""
    return written(A.examples(spark, d).select("user_id", "target_item_id", F.array_join("history_title", " ").alias("text"), "history_item_id"), "queries")


def _catalogue(spark, d):
    return A.items(spark, d).select("item_id", F.col("title").alias("text"))


def _masked(q):
    """History and pad item, never the target."""
    return q.select("user_id", "target_item_id", F.explode(F.array_union("history_item_id", F.array(F.lit(0).cast("long")))).alias("item_id")).filter("item_id <> target_item_id").select("user_id", "item_id")


@query(f"""WITH {_RANK}, hm AS (SELECT DISTINCT user_id, item_id FROM hist), r AS (SELECT f.user_id, 1 + count(*) FILTER (f.score > f.sim AND f.item_id <> 0 AND hm.item_id IS NULL) AS rank FROM full_sc f LEFT JOIN hm ON hm.user_id = f.user_id AND hm.item_id = f.item_id GROUP BY f.user_id)
SELECT count(*) AS n, round(avg((rank <= 10)::INT::DOUBLE), 6) AS hr_10, round(avg({_NDCG('rank', 10)}), 6) AS ndcg_10, round(avg((rank <= 100)::INT::DOUBLE), 6) AS hr_100, round(avg({_NDCG('rank', 100)}), 6) AS ndcg_100, round(avg(rank), 6) AS mean_rank, CAST(quantile_disc(rank, 0.5 ORDER BY rank DESC) AS BIGINT) AS median_rank FROM r""".replace("quantile_disc(rank, 0.5 ORDER BY rank DESC)", "list_sort(list(rank))[count(*) // 2 + 1]"))
def flagship_ranking_eval(spark, d):
    q = _queries(spark, d)
    return ranking.metrics(ranking.lexical_ranks(q, _catalogue(spark, d), "user_id", "target_item_id", _masked(q)), "rank_strict", (10, 100))


@query(f"WITH {_RANK} SELECT user_id, target_item_id, round(sim, 6) AS sim, 1 + count(*) FILTER (score > sim) AS rank_strict, 1 + count(*) FILTER (score > sim OR (score = sim AND item_id > target_item_id)) AS rank_total FROM full_sc GROUP BY user_id, target_item_id, sim")
def lexical_ranks(spark, d):
    q, items = _queries(spark, d), _catalogue(spark, d)
    return ranking.lexical_ranks(q, items, "user_id", "target_item_id", total=True).drop("known").withColumn("sim", F.round("sim", 6))


_DT = lambda t, k: f"{t}t AS (SELECT {k}, tok, count(*) AS tf FROM (SELECT {k}, unnest(regexp_extract_all(lower(text), '[A-Za-z0-9][A-Za-z0-9''-]*')) AS tok FROM {t}) GROUP BY 1, 2), {t}n AS (SELECT {k}, sum(tf * tf) AS nn FROM {t}t GROUP BY 1)"


@query(f"WITH {_DT('documents', 'doc_id')}, {_DT('benchmark', 'item_id')}, p AS (SELECT doc_id, item_id, sum(a.tf * b.tf) AS dot FROM documentst a JOIN benchmarkt b USING (tok) GROUP BY 1, 2) SELECT doc_id, round(max(dot / sqrt((x.nn * y.nn)::DOUBLE)), 6) AS best, count(*) AS n FROM p JOIN documentsn x USING (doc_id) JOIN benchmarkn y USING (item_id) GROUP BY doc_id")
def lexical_cosine_pairs(spark, d):
    """The best cosine of each document with an item, and how many items share a word with it."""
    found = postings.best_scores(A.documents(spark, d).select("doc_id", "text"), postings.catalogue(table(spark, d, "benchmark").select("item_id", "text")), "doc_id")
    return found.select("doc_id", F.round("best", 6).alias("best"), "n")


_VEC = """v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), pairs AS (SELECT a.vec_id AS qid, b.vec_id AS vid, a.label AS ql, b.label AS vl, round(list_dot_product(a.e, b.e), 6) AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)"""


def _vectors(spark, d):
    """Query vectors (ids divisible by 50) and all vectors, with their labels."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), "label", F.col("embedding").cast("array<double>").alias("v"))
    return v.filter("item_id % 50 = 0").select(F.col("item_id").alias("qid"), F.col("label").alias("ql"), "v"), v


@query(f"WITH {_VEC} SELECT qid, vid, score, rn FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vid) AS rn FROM pairs) WHERE rn <= 10")
def dense_topk(spark, d):
    q, v = _vectors(spark, d)
    return ranking.dense_top(q, v, "qid", 10).withColumnRenamed("item_id", "vid")


@query(f"WITH {_VEC}, t AS (SELECT qid, min(vid) AS tid FROM pairs WHERE ql = vl AND vid > qid GROUP BY qid), ts AS (SELECT qid, tid, score AS s FROM t JOIN pairs USING (qid) WHERE vid = tid) SELECT qid, tid, s AS sim, 1 + count(*) FILTER (score > s) AS rank FROM ts JOIN pairs USING (qid) GROUP BY 1, 2, 3")
def dense_rank_target(spark, d):
    """Targets are the next larger ids of the same label; a query itself is left out."""
    q, v = _vectors(spark, d)
    own = q.join(_following(v), "qid")
    return ranking.dense_ranks(own, v, "qid", "tid", own.select("qid", F.col("qid").alias("item_id"))).select("qid", "tid", "sim", "rank")


def _following(v):
    """qid and tid, the next larger id of the same label: from blocks of ids, then from the next block that has any."""
    block = F.col("item_id").bitwiseAND(F.lit(-1024))
    own = v.select("label", "item_id", block.alias("b"))
    first = own.groupBy("label", "b").agg(F.min("item_id").alias("first")).withColumn("next", F.lead("first").over(Window.partitionBy("label").orderBy("b")))
    inside = own.withColumn("inside", F.lead("item_id").over(Window.partitionBy("label", "b").orderBy("item_id")))
    return inside.join(first, ["label", "b"]).select(F.col("item_id").alias("qid"), F.coalesce("inside", "next").alias("tid")).filter("tid is not null")


@query(f"WITH {_VEC}, pool AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vid) AS rn FROM pairs), neg AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rn) AS k FROM pool WHERE rn <= 50 AND ql <> vl) SELECT qid, string_agg(vid, ',' ORDER BY k) AS negatives FROM neg WHERE k <= 5 GROUP BY qid")
def hard_negatives(spark, d):
    """The first five of each query's pool of fifty with another label."""
    q, v = _vectors(spark, d)
    pool = ranking.dense_top(q, v, "qid", 50).join(v.select("item_id", "label"), "item_id").join(q.select("qid", "ql"), "qid")
    neg = ranking.first_allowed(pool.filter("label <> ql"), "qid", 5)
    return neg.select("qid", F.array_join(F.transform("negatives", lambda x: x.cast("string")), ",").alias("negatives"))


@query(f"WITH {_VEC}, pool AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vid) AS rn FROM pairs), t AS (SELECT qid, vid AS tid, score AS sim FROM pool WHERE rn = 12), neg AS (SELECT pool.*, tid, row_number() OVER (PARTITION BY qid ORDER BY rn) AS k FROM pool JOIN t USING (qid) WHERE rn <= 20 AND vid % 3 <> 0 AND vid <> tid AND score > sim) SELECT qid, any_value(tid) AS tid, string_agg(vid, ',' ORDER BY k) AS negatives FROM neg WHERE k <= 4 GROUP BY qid")
def hard_negatives_above(spark, d):
    """Negatives that beat the target, without a query's history (here ids divisible by three) and the target itself."""
    q, v = _vectors(spark, d)
    pool = ranking.dense_top(q, v, "qid", ranking.pool_size(20, 4, v.count()))
    aim = pool.filter("rn = 12").select("qid", F.col("item_id").alias("tid"), F.col("score").alias("sim"))
    hidden = pool.filter("item_id % 3 = 0").select("qid", "item_id")
    neg = ranking.first_allowed(pool.join(aim, "qid").filter("item_id <> tid and score > sim").join(hidden, ["qid", "item_id"], "left_anti"), "qid", 4, "tid")
    return neg.select("qid", "tid", F.array_join(F.transform("negatives", lambda x: x.cast("string")), ",").alias("negatives"))


@query(f"""WITH {A.INTER}, seen AS (SELECT DISTINCT user_id, item_id FROM inter), c AS (SELECT count(*) AS m FROM part), ix AS (SELECT p_partkey AS item_id, row_number() OVER (ORDER BY p_partkey) - 1 AS i FROM part),
dr AS (SELECT DISTINCT user_id, first_value(j) OVER (PARTITION BY user_id, i ORDER BY j) AS j, i FROM (SELECT user_id, j, ('0x' || substr(md5(user_id || ':' || j), 1, 12))::BIGINT % m AS i FROM (SELECT DISTINCT user_id FROM inter), range(64) t(j), c)),
ok AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY j) AS k FROM dr JOIN ix USING (i) WHERE item_id > 0 AND (user_id, item_id) NOT IN (SELECT user_id, item_id FROM seen)),
few AS (SELECT u.user_id, count(item_id) AS have FROM (SELECT DISTINCT user_id FROM inter) u LEFT JOIN ok USING (user_id) GROUP BY 1 HAVING count(item_id) < 5),
rest AS (SELECT few.user_id, ix.item_id, have + row_number() OVER (PARTITION BY few.user_id ORDER BY md5(few.user_id || ':rest:' || ix.item_id), ix.item_id) AS k FROM few JOIN ix ON ix.item_id > 0 WHERE (few.user_id, ix.item_id) NOT IN (SELECT user_id, item_id FROM seen) AND (few.user_id, ix.item_id) NOT IN (SELECT user_id, item_id FROM ok)),
picked AS (SELECT * FROM ok WHERE k <= 5 UNION ALL SELECT * FROM rest WHERE k <= 5) SELECT user_id, string_agg(item_id, ',' ORDER BY k) AS negatives FROM picked GROUP BY user_id""")
def random_negatives(spark, d):
    """Seeded draws (64 for a user) looked up by place in the catalogue; the first five unseen ones.

    Users whose draws hold fewer get the rest from all other unseen items by seeded hash (all, if few).
    They have seen most of the catalogue, so pairing them with it makes about as many rows as they have.
    """
    own, cat = A.log(spark, d), A.items(spark, d).select("item_id")
    m = cat.count()
    ix = ranking.numbered(cat, "item_id", "i")
    users, seen = own.select("user_id").distinct(), own.select("user_id", "item_id").distinct()
    draws = users.select("user_id", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("j")).withColumn("i", F.conv(F.substring(F.md5(F.concat_ws(":", "user_id", "j")), 1, 12), 16, 10).cast("long") % m)
    draws = draws.groupBy("user_id", "i").agg(F.min("j").alias("j")).join(ix, "i").filter("item_id > 0").join(seen, ["user_id", "item_id"], "left_anti")

    def five(rows, name, *by):
        top = rows.withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy(*by))).filter("k <= 5")
        return top.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "item_id"))), lambda x: x["item_id"]).alias(name))

    none = F.array().cast("array<long>")
    first = users.join(five(draws, "drawn", "j"), "user_id", "left").select("user_id", F.coalesce("drawn", none).alias("drawn"))
    # Places of the whole catalogue in blocks, so that no task makes all pairs of a user.
    blocks = first.filter(F.size("drawn") < 5).select("user_id", "drawn", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m // 1024).cast("long"))).alias("b")).repartition("user_id", "b")
    rest = blocks.select("user_id", "drawn", F.explode(F.sequence(F.col("b") * 1024, F.col("b") * 1024 + 1023)).alias("i")).join(ix, "i").filter("item_id > 0 and not array_contains(drawn, item_id)").join(seen, ["user_id", "item_id"], "left_anti")
    rest = five(rest, "more", F.md5(F.concat_ws(":", "user_id", F.lit("rest"), "item_id")), "item_id")
    both = first.join(rest, "user_id", "left").select("user_id", F.slice(F.concat("drawn", F.coalesce("more", none)), 1, 5).alias("n")).filter(F.size("n") > 0)
    return both.select("user_id", F.array_join(F.transform("n", lambda x: x.cast("string")), ",").alias("negatives"))


@query("WITH e AS (SELECT label, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT label, unnest(range(1, len(e) + 1)) AS i, unnest(e) AS x FROM e), s AS (SELECT label, i, sum(x) AS x, count(*) AS n FROM p GROUP BY 1, 2) SELECT label, n, CAST(i AS INTEGER) AS place, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 6) AS value FROM s")
def label_centroids(spark, d):
    """The centroid of each label's vectors, brought to length one, by position."""
    found = vectors.centroids(table(spark, d, "embeddings").select("label", "embedding"), "label", "embedding")
    return found.select("label", "n", F.posexplode("centroid").alias("place", "value")).select("label", "n", (F.col("place") + 1).alias("place"), F.round("value", 6).alias("value"))


@query()
def ivf_topk(spark, d):
    """The ten best vectors of each query by the inverted-file index; the tests measure its recall against `dense_topk`."""
    q, v = _vectors(spark, d)
    return vectors.near(q, vectors.index(v), "qid", 10).withColumnRenamed("item_id", "vid")


_GAIN_HIDDEN = "hidden AS (SELECT qid, unnest([qid, qid - 1, qid - 2, qid - 3, 0]) AS vid FROM (SELECT vec_id AS qid FROM v WHERE vec_id % 50 = 0))"


@query(f"""WITH {_VEC.split(', pairs AS')[0]}, {_GAIN_HIDDEN}, t AS (SELECT a.vec_id AS qid, CASE WHEN a.vec_id % 200 = 0 THEN a.vec_id + 1000000 ELSE min(b.vec_id) END AS tid FROM v a JOIN v b ON a.label = b.label AND b.vec_id > a.vec_id WHERE a.vec_id % 50 = 0 GROUP BY 1, a.vec_id),
q AS (SELECT t.qid, t.tid, a.e, list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] + 0.25 * coalesce(b.e[i], 0.0)) AS c FROM t JOIN v a ON a.vec_id = t.qid LEFT JOIN v b ON b.vec_id = t.tid),
s AS (SELECT qid, tid, vec_id AS vid, round(list_dot_product(q.e, v.e), 6) AS bs, round(list_dot_product(q.c, v.e), 6) AS cs FROM q CROSS JOIN v), o AS (SELECT qid, bs AS ob, cs AS oc FROM s WHERE vid = tid),
r AS (SELECT s.qid, any_value(s.tid) AS tid, any_value(ob) IS NOT NULL AS known, any_value(ob) AS ob, any_value(oc) AS oc, 1 + count(*) FILTER (bs > ob AND hidden.vid IS NULL) AS br, 1 + count(*) FILTER (cs > oc AND hidden.vid IS NULL) AS cr FROM s LEFT JOIN o USING (qid) LEFT JOIN hidden ON hidden.qid = s.qid AND hidden.vid = s.vid AND hidden.vid <> s.tid GROUP BY s.qid),
f AS (SELECT qid, tid, known, coalesce(ob, 0) AS baseline_sim, coalesce(oc, 0) AS cot_sim, CASE WHEN known THEN br ELSE n + 1 END AS baseline_rank, CASE WHEN known THEN cr ELSE n + 1 END AS cot_rank FROM r, (SELECT count(*) AS n FROM v))
SELECT qid, tid, known, baseline_sim, cot_sim, baseline_rank, cot_rank, round(CASE WHEN known THEN ({_NDCG('cot_rank', 100)}) - ({_NDCG('baseline_rank', 100)}) ELSE 0.0 END, 6) AS cot_gain, round(cot_sim - baseline_sim, 6) AS sim_gain FROM f""")
def dense_gain(spark, d):
    """Vectors before and after reasoning (here a quarter of the target's is added) against all items in one pass; the history and the pad item are left out, some targets are unknown."""
    q, v = _vectors(spark, d)
    own = q.join(_following(v), "qid").withColumn("aim", F.when(F.col("qid") % 200 == 0, F.col("qid") + 1000000).otherwise(F.col("tid")))
    own = own.join(v.select(F.col("item_id").alias("aim"), F.col("v").alias("w")), "aim", "left")
    own = own.withColumn("reasoned", F.when(F.col("w").isNull(), F.col("v")).otherwise(F.zip_with("v", "w", lambda a, b: a + 0.25 * b)))
    hidden = own.select("qid", F.explode(F.array(F.col("qid"), F.col("qid") - 1, F.col("qid") - 2, F.col("qid") - 3, F.lit(0).cast("long"))).alias("item_id"))
    out = dense.gains(own, v, "qid", "aim", "v", "reasoned", hidden)
    return out.select("qid", F.col("aim").alias("tid"), "known", "baseline_sim", "cot_sim", "baseline_rank", "cot_rank", F.round("cot_gain", 6).alias("cot_gain"), F.round("sim_gain", 6).alias("sim_gain"))


# Rubric and judging


_LIST = lambda terms: " + ".join(f"(contains(low, '{t}'))::INT" for t in terms)
_LAD = lambda x, s: "(1 + " + " + ".join(f"(({x}) >= {k})::INT" for k in s) + ")"


def rules_sql(rows: str, key: str = "doc_id") -> str:
    """SQL tables of the rules' five dimensions (a, b, c, e, f) of rows (key, text) that name no title of a history and have no tags."""
    return f"""c AS (SELECT {key}, {_COMPACT('lower(text)')} AS low, len({_WORDS('text')}) AS wc FROM {rows}), h AS (SELECT *, {_LIST(R.PREFERENCE)} AS p, {_LIST(R.TRANSITION)} AS t, {_LIST(R.DISCRIMINATIVE)} AS di, {_LIST(R.LEAKAGE)} AS lk, {_LIST(R.GENERIC)} AS g FROM c),
s AS (SELECT {key}, greatest(1, 1 - lk) AS a, greatest(1, {_LAD('p', R.SPECIFICITY_LADDER)} - g) AS b, {_LAD('t', R.LADDER)} AS c, greatest(1, {_LAD('di', R.LADDER)} - lk) AS e, greatest(1, CASE WHEN wc BETWEEN 70 AND 220 THEN 5 WHEN wc BETWEEN 45 AND 280 THEN 4 WHEN wc BETWEEN 25 AND 360 THEN 3 WHEN wc > 0 THEN 2 ELSE 1 END - 1) AS f FROM h)"""


@query(f"""WITH {rules_sql('documents')}
SELECT doc_id, CAST(a AS INT) AS grounding, CAST(b AS INT) AS specificity, CAST(c AS INT) AS transitional, CAST(e AS INT) AS framing, CAST(f AS INT) AS conciseness, CAST(a + b + c + e + f AS INT) AS total, round((a + b + c + e + f) / 25.0::DOUBLE, 6) AS score_norm FROM s""")
def rule_score(spark, d):
    s = R.rule_score(F.lit(""), F.col("text"))
    own = A.documents(spark, d).select("doc_id", s.alias("s"))
    return own.select("doc_id", *[F.col(f"s.{a}").alias(b) for a, b in zip(R.DIMENSIONS, ("grounding", "specificity", "transitional", "framing", "conciseness"), strict=True)], "s.total", F.round("s.score_norm", 6).alias("score_norm"))


@query(f"WITH {A.SCORED} SELECT doc_id, CAST(d1 AS INT) AS a, CAST(d2 AS INT) AS b, CAST(greatest(1, least(5, round_even(CASE WHEN d3 / 5.0 < 1 THEN d3 ELSE 1 END, 0))) AS INT) AS c, CAST(d4 AS INT) AS prose FROM scored")
def judge_parse(spark, d):
    obj = F.concat(F.lit('Verdict: {"preference_grounding": '), F.col("d1"), F.lit(', "taste_specificity": "'), F.col("d2"), F.lit('", "conciseness": '), F.col("d3") / F.lit(5.0), F.lit("} done"))
    prose = F.concat(F.lit("**Transitional reasoning** is fair, score: "), F.col("d4"), F.lit(". Next."))
    own = A.scored(spark, d).select("doc_id", R.judged(obj).alias("o"), prose.alias("p"))
    return own.select("doc_id", R.judged_dimension(F.col("o"), "preference_grounding").alias("a"), R.judged_dimension(F.col("o"), "taste_specificity").alias("b"), R.judged_dimension(F.col("o"), "conciseness").alias("c"), R.free_text_dimension(F.col("p"), "transitional_reasoning").alias("prose"))


# Gain, selection, merging


@query(f"WITH {A.SCORED}, s AS (SELECT *, rubric * greatest(gain, 0) AS sel, rubric >= 15 AND gain >= 0.01 AS ok FROM scored), r AS (SELECT *, row_number() OVER w AS rk, sum(ok::INT) OVER (w ROWS UNBOUNDED PRECEDING) AS passed, max(ok::INT) OVER (PARTITION BY example_id) AS anyok FROM s WINDOW w AS (PARTITION BY example_id ORDER BY sel DESC, rubric DESC, gain DESC, doc_id)) SELECT doc_id, example_id, CAST(rk AS INT) AS selection_rank, round(sel, 6) AS selection_score, anyok = 0 AND rk = 1 AS fallback_selected, (anyok = 0 AND rk = 1) OR (ok AND passed <= 2) AS selected FROM r")
def select_topk_per_group(spark, d):
    own = selection.top_k(A.scored(spark, d), "example_id", 2, 15, 0.01, "doc_id", True)
    return own.select("doc_id", "example_id", "selection_rank", F.round("selection_score", 6).alias("selection_score"), "fallback_selected", "selected")


@query(f"WITH {A.SCORED}, s AS (SELECT *, rubric * greatest(gain, 0) AS sel FROM scored WHERE rubric >= 12 AND gain >= 0), c AS (SELECT CAST(ceil(count(*) * 0.2::DOUBLE) AS BIGINT) AS k FROM s) SELECT doc_id, rubric, round(gain, 6) AS gain FROM (SELECT *, row_number() OVER (ORDER BY sel DESC, rubric DESC, gain DESC, doc_id) AS rn FROM s), c WHERE rn <= k")
def select_top_percent(spark, d):
    return selection.top_share(A.scored(spark, d), 0.2, 12, 0, "doc_id").select("doc_id", "rubric", F.round("gain", 6).alias("gain"))


_Q = lambda p, a: f"round(quantile_cont(gain, {p}), 6) AS {a}"


@query(f"WITH {A.SCORED} SELECT count(*) AS n, count(gain) AS n_value, count(*) FILTER (gain < 0) AS n_negative, round(min(gain), 6) AS min, round(max(gain), 6) AS max, round(avg(gain), 6) AS mean, {_Q(0.5, 'median')}, {_Q(0.05, 'p05')}, {_Q(0.25, 'p25')}, {_Q(0.75, 'p75')}, {_Q(0.95, 'p95')} FROM scored")
def finalize_summary(spark, d):
    return selection.summary(A.scored(spark, d), "gain")


@query(f"WITH {A.SCORED}, e AS (SELECT min(gain) AS a, max(gain) AS b FROM scored), f AS (SELECT CAST(least(floor((gain - a) / ((b - a) / 20)), 19) AS INT) AS bin, count(*) AS n FROM scored, e GROUP BY 1) SELECT CAST(g.i AS INT) AS bin, round(a + g.i * ((b - a) / 20), 6) AS lo, coalesce(n, 0) AS n FROM range(20) g(i) CROSS JOIN e LEFT JOIN f ON f.bin = g.i")
def gain_histogram(spark, d):
    return selection.histogram(A.scored(spark, d), "gain", 20)


@query("WITH s AS (SELECT doc_id, quality, toxic, doc_id AS pos FROM labels UNION ALL SELECT doc_id, 1 - quality, toxic, doc_id + 1000000 FROM labels WHERE doc_id % 3 = 0), l AS (SELECT doc_id, arg_max(quality, pos) AS quality FROM s GROUP BY 1) SELECT d.doc_id, lang, CAST(quality AS INT) AS quality FROM documents d JOIN l USING (doc_id)")
def merge_scores(spark, d):
    lab = table(spark, d, "labels").select("doc_id", "quality", F.col("doc_id").alias("pos"))
    scores = lab.unionByName(lab.filter("doc_id % 3 = 0").select("doc_id", (1 - F.col("quality")).cast("int").alias("quality"), (F.col("pos") + 1000000).alias("pos")))
    return core.merged(table(spark, d, "documents").select("doc_id", "lang"), scores, ["doc_id"], "pos").select("doc_id", "lang", F.col("quality").cast("int").alias("quality"))


@query("SELECT count(*) FILTER (l.doc_id IS NOT NULL AND d.doc_id IS NOT NULL) AS matched, count(*) FILTER (l.doc_id IS NULL) AS unscored, count(*) FILTER (d.doc_id IS NULL) AS unmatched FROM documents d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id")
def merge_stats(spark, d):
    a, b = table(spark, d, "documents").select("doc_id", F.lit(1).alias("x")), table(spark, d, "labels").select("doc_id").distinct().withColumn("y", F.lit(1))
    return a.join(b, "doc_id", "full").agg(F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("matched"), F.count_if(F.col("y").isNull()).alias("unscored"), F.count_if(F.col("x").isNull()).alias("unmatched"))


@query("SELECT doc_id, CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 16))::UBIGINT % 7 AS INT) AS shard FROM documents")
def shard_assign(spark, d):
    return table(spark, d, "documents").select("doc_id", core.hash_shard(F.col("doc_id").cast("string"), 7).alias("shard"))


@query("SELECT d.doc_id, CAST(k.k AS INT) AS candidate_index FROM documents d CROSS JOIN range(2) k(k) WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = k.k)")
def resume_pending(spark, d):
    grid = table(spark, d, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("candidate_index"))
    return core.without(grid, (table(spark, d, "labels").select("doc_id", F.col("quality").cast("int").alias("candidate_index")), ["doc_id", "candidate_index"]))


@query("SELECT user_id, event_type, arg_min(event_id, ts) AS first_id, arg_max(event_id, ts) AS last_id FROM events GROUP BY 1, 2")
def first_and_last_wins(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", "ts")
    first = core.first_wins(e, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", F.col("event_id").alias("first_id"))
    last = core.last_wins(e, ["user_id", "event_type"], "ts").select("user_id", "event_type", F.col("event_id").alias("last_id"))
    return first.join(last, ["user_id", "event_type"])


# Rewards and analytics


@query(f"WITH {A.SCORED}, r AS (SELECT *, (d1 > 2)::INT::DOUBLE AS fmt, CASE WHEN norm < 0.45 THEN -0.05 WHEN gain > 0 THEN norm * gain ELSE -0.05 END AS gated FROM scored) SELECT doc_id, round(gated, 6) AS gated, round(0.2 * fmt + 0.3 * norm + gated, 6) AS total, round((gated - avg(gated) OVER w) / nullif(stddev_samp(gated) OVER w, 0), 4) AS advantage FROM r WINDOW w AS (PARTITION BY example_id)")
def gated_reward(spark, d):
    gated = F.when(F.col("norm") < 0.45, -0.05).when(convert.above_zero(F.col("gain")), F.col("norm") * F.col("gain")).otherwise(-0.05)
    own = A.scored(spark, d).withColumn("gated", gated).withColumn("fmt", (F.col("d1") > 2).cast("double"))
    w = Window.partitionBy("example_id")
    adv = (F.col("gated") - F.avg("gated").over(w)) / F.nullif(F.stddev_samp("gated").over(w), F.lit(0.0))
    return own.select("doc_id", F.round("gated", 6).alias("gated"), F.round(0.2 * F.col("fmt") + 0.3 * F.col("norm") + F.col("gated"), 6).alias("total"), F.round(adv, 4).alias("advantage"))


@query(f"WITH {A.SCORED}, u AS (UNPIVOT scored ON d1, d2, d3, d4, d5 INTO NAME dim VALUE v), k AS (SELECT dim, v, gain, rank() OVER (PARTITION BY dim ORDER BY v) + (count(*) OVER (PARTITION BY dim, v) - 1) / 2.0 AS rv, rank() OVER (PARTITION BY dim ORDER BY gain) + (count(*) OVER (PARTITION BY dim, gain) - 1) / 2.0 AS rg FROM u) SELECT dim, round(corr(v, gain), 6) AS pearson, round(corr(rv, rg), 6) AS spearman FROM k GROUP BY dim")
def corr_dims_gain(spark, d):
    """Average ranks over ranges of (dimension, value), so that neither a dimension nor a frequent value is one task's sort."""
    own = A.scored(spark, d)
    u = written(own.select("gain", F.expr("stack(5, 'd1', d1, 'd2', d2, 'd3', d3, 'd4', d4, 'd5', d5) as (dim, v)")), "dimensions")
    ranks = lambda value, name: order.average_ranks(u, "dim", value, name)
    both = u.join(ranks("v", "rv"), ["dim", "v"]).join(ranks("gain", "rg"), ["dim", "gain"])
    return both.groupBy("dim").agg(F.round(F.corr(F.col("v").cast("double"), "gain"), 6).alias("pearson"), F.round(F.corr("rv", "rg"), 6).alias("spearman"))


@query(f"WITH {A.SCORED}, s AS (SELECT *, unnest(['raw', 'gain', 'rubric', 'gated']) AS strategy FROM scored), v AS (SELECT *, CASE strategy WHEN 'raw' THEN -candidate_index WHEN 'gain' THEN gain WHEN 'rubric' THEN norm ELSE norm * greatest(gain, 0) END AS score FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY strategy, example_id ORDER BY score DESC, doc_id) AS k FROM v) SELECT strategy, count(*) AS n, round(avg(rubric), 6) AS rubric, round(avg(gain), 6) AS gain FROM r WHERE k = 1 GROUP BY 1")
def selection_strategies(spark, d):
    scores = {"raw": -F.col("candidate_index").cast("double"), "gain": F.col("gain"), "rubric": F.col("norm"), "gated": F.col("norm") * F.greatest("gain", F.lit(0.0))}
    own = A.scored(spark, d).select("*", F.explode(F.array(*[F.struct(F.lit(k).alias("strategy"), v.alias("score")) for k, v in scores.items()])).alias("s")).select("*", "s.*")
    best = core.first_wins(own, ["strategy", "example_id"], [F.desc("score"), F.asc("doc_id")])
    return best.groupBy("strategy").agg(F.count("*").alias("n"), F.round(F.avg("rubric"), 6).alias("rubric"), F.round(F.avg("gain"), 6).alias("gain"))


@query(f"WITH {A.INTER}, u AS (SELECT user_id, count(*) AS c, avg(rating) AS r FROM inter GROUP BY 1), t AS (SELECT *, ntile(3) OVER (ORDER BY c, user_id) AS cohort FROM u) SELECT 'activity' AS kind, CAST(cohort AS INT) AS cohort, count(*) AS n, round(avg(c), 6) AS events, round(avg(r), 6) AS rating FROM t GROUP BY cohort UNION ALL SELECT 'popularity', CAST(cohort AS INT), count(*), round(avg(c), 6), round(avg(r), 6) FROM (SELECT *, ntile(3) OVER (ORDER BY c, item_id) AS cohort FROM (SELECT item_id, count(*) AS c, avg(rating) AS r FROM inter GROUP BY 1)) GROUP BY cohort")
def cohorts(spark, d):
    own = A.log(spark, d)

    def of(kind: str, key: str) -> DataFrame:
        n = own.groupBy(key).agg(F.count("*").alias("c"), F.avg("rating").alias("r"))
        return ranking.thirds(n, "c", key).groupBy("cohort").agg(F.count("*").alias("n"), F.round(F.avg("c"), 6).alias("events"), F.round(F.avg("r"), 6).alias("rating")).select(F.lit(kind).alias("kind"), "cohort", "n", "events", "rating")

    return of("activity", "user_id").unionByName(of("popularity", "item_id"))


@query(f"""WITH {_RANK}, hm AS (SELECT DISTINCT user_id, item_id FROM hist), r AS (SELECT f.user_id, any_value(f.target_item_id) AS item, 1 + count(*) FILTER (f.score > f.sim AND f.item_id <> 0 AND hm.item_id IS NULL) AS rank FROM full_sc f LEFT JOIN hm ON hm.user_id = f.user_id AND hm.item_id = f.item_id GROUP BY f.user_id),
u AS (SELECT user_id, ntile(3) OVER (ORDER BY c, user_id) AS cohort FROM (SELECT user_id, count(*) AS c FROM inter GROUP BY 1)), i AS (SELECT item_id, ntile(3) OVER (ORDER BY c, item_id) AS cohort FROM (SELECT item_id, count(*) AS c FROM inter GROUP BY 1)),
x AS (SELECT 'activity' AS kind, cohort, rank FROM r JOIN u USING (user_id) UNION ALL SELECT 'popularity', cohort, rank FROM r JOIN i ON i.item_id = r.item)
SELECT kind, CAST(cohort AS INTEGER) AS cohort, count(*) AS n, round(avg((rank <= 10)::INT::DOUBLE), 6) AS hr_10, round(avg({_NDCG('rank', 10)}), 6) AS ndcg_10, round(avg((rank <= 100)::INT::DOUBLE), 6) AS hr_100, round(avg({_NDCG('rank', 100)}), 6) AS ndcg_100, round(avg(rank), 6) AS mean_rank FROM x GROUP BY 1, 2""")
def cohort_metrics(spark, d):
    """HR and NDCG of the masked ranks by thirds of users (by activity) and of targets (by popularity)."""
    q = _queries(spark, d)
    ranks = written(ranking.lexical_ranks(q, _catalogue(spark, d), "user_id", "target_item_id", _masked(q)).select("user_id", F.col("target_item_id").alias("item_id"), "rank_strict"), "ranks")
    log = A.log(spark, d).select("user_id", "item_id")

    def of(kind: str, key: str) -> DataFrame:
        cohort = ranking.thirds(log.groupBy(key).agg(F.count("*").alias("c")), "c", key).select(key, "cohort")
        return ranks.join(cohort, key).select(F.lit(kind).alias("kind"), "cohort", "rank_strict")

    return ranking.metrics_by(of("activity", "user_id").unionByName(of("popularity", "item_id")), ["kind", "cohort"], "rank_strict", (10, 100))


@query(f"WITH {A.SCORED}, b AS (SELECT CAST(floor(gain * 50) AS INT) AS band, count(*) AS n, sum(gain) AS g FROM scored GROUP BY 1), c AS (SELECT band, sum(n) OVER (ORDER BY band DESC) AS n, sum(g) OVER (ORDER BY band DESC) AS g FROM b) SELECT band, round(n / (SELECT count(*) FROM scored)::DOUBLE, 6) AS share, round(g, 4) AS gained FROM c")
def pareto_selective(spark, d):
    """Share of calls made against gain kept, over bands of gain from high to low."""
    own = A.scored(spark, d)
    bands = own.groupBy(F.floor(F.col("gain") * 50).cast("int").alias("band")).agg(F.count("*").alias("n"), F.sum("gain").alias("g"))
    w = Window.orderBy(F.desc("band"))
    total = own.count()
    return bands.select("band", F.round(F.sum("n").over(w) / F.lit(float(total)), 6).alias("share"), F.round(F.sum("g").over(w), 4).alias("gained"))


@query(f"WITH {_VEC}, pos AS (SELECT qid, max(score) AS s FROM pairs WHERE ql = vl GROUP BY qid) SELECT p.qid, round(ln(sum(exp((score - s) / 0.05))), 4) AS loss FROM pairs p JOIN pos USING (qid) GROUP BY p.qid, s")
def infonce_batch(spark, d):
    """The loss of each query against all vectors of the batch, its best one of the same label being the positive."""
    q, v = _vectors(spark, d)
    return ranking.contrastive_loss(q, v, "qid", "ql", "label", 0.05).select("qid", F.round("loss", 4).alias("loss"))


@query(f"""WITH {_RANK}, nd AS (SELECT count(*) AS m FROM documents), cot AS (SELECT q.user_id, q.target_item_id, q.text || chr(10) || chr(10) || 'Recommendation reasoning:' || chr(10) || {_STRIP('d.text')} AS text FROM q, nd, documents d WHERE d.doc_id = q.user_id % nd.m),
{_DT('cot', 'user_id')}, cs AS (SELECT user_id, p_name, dot / sqrt((nn * tn)::DOUBLE) AS score FROM (SELECT user_id, p_name, sum(a.tf * b.tf) AS dot FROM cott a JOIN it b USING (tok) GROUP BY 1, 2) JOIN cotn USING (user_id) JOIN itn USING (p_name)),
co AS (SELECT c.user_id, coalesce(score, 0.0::DOUBLE) AS sim FROM cot c JOIN part ON p_partkey = c.target_item_id LEFT JOIN cs USING (user_id, p_name)),
cnt AS (SELECT p_name, count(*) AS n FROM part GROUP BY 1), br AS (SELECT own.user_id, sim, 1 + coalesce((SELECT sum(n) FROM sc JOIN cnt USING (p_name) WHERE sc.user_id = own.user_id AND sc.score > own.sim), 0) AS r FROM own), cr AS (SELECT co.user_id, sim, 1 + coalesce((SELECT sum(n) FROM cs JOIN cnt USING (p_name) WHERE cs.user_id = co.user_id AND cs.score > co.sim), 0) AS r FROM co)
SELECT b.user_id, CAST(b.r AS BIGINT) AS baseline_rank, CAST(c.r AS BIGINT) AS cot_rank, round({_NDCG('c.r', 100)} - ({_NDCG('b.r', 100)}), 6) AS cot_gain, round(c.sim - b.sim, 6) AS sim_gain FROM br b JOIN cr c USING (user_id)""")
def gain_ndcg(spark, d):
    q, items, docs = _queries(spark, d), postings.catalogue(_catalogue(spark, d)), table(spark, d, "documents").select("doc_id", F.col("text").alias("cot"))
    n = docs.count()
    more = q.withColumn("doc_id", F.col("user_id") % n).join(docs, "doc_id").withColumn("text", T.with_reasoning(F.col("text"), F.col("cot")))
    base, cot = (ranking.lexical_ranks(x.select("user_id", "target_item_id", "text"), items, "user_id", "target_item_id") for x in (q, more))
    both = base.select("user_id", F.col("rank_strict").alias("baseline_rank"), F.col("sim").alias("b")).join(cot.select("user_id", F.col("rank_strict").alias("cot_rank"), F.col("sim").alias("c")), "user_id")
    return both.select("user_id", "baseline_rank", "cot_rank", F.round(R.ndcg(F.col("cot_rank"), 100) - R.ndcg(F.col("baseline_rank"), 100), 6).alias("cot_gain"), F.round(F.col("c") - F.col("b"), 6).alias("sim_gain"))


_RULES = f"{rules_sql('documents')}, rules AS (SELECT doc_id, (a + b + c + e + f) / 25.0::DOUBLE AS norm FROM s)"
_EX = f"""{_RULES}, ex AS (SELECT doc_id, doc_id // 4 AS example_id, text FROM documents), hi AS (SELECT example_id, arg_min(left(text, length(text) // 3), doc_id) AS history FROM ex GROUP BY 1), nb AS (SELECT count(*) AS nb FROM benchmark),
row_ AS (SELECT doc_id, example_id, history, {_STRIP('history')} || CASE WHEN {_STRIP('ex.text')} = '' THEN '' ELSE chr(10) || chr(10) || 'Recommendation reasoning:' || chr(10) || {_STRIP('ex.text')} END AS reasoned, CASE WHEN example_id % 9 = 8 THEN '' ELSE b.text END AS told, CASE WHEN doc_id % 3 = 0 THEN 0.1::DOUBLE END AS given, CASE WHEN doc_id % 5 = 0 THEN 0.8::DOUBLE END AS judged
  FROM ex JOIN hi USING (example_id), nb, benchmark b WHERE b.item_id = example_id % nb)"""
_COS = lambda name, side: f"""{name}x AS (SELECT doc_id, tok, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower({side}), '[A-Za-z0-9][A-Za-z0-9''-]*')) AS tok FROM row_) GROUP BY 1, 2), {name}d AS (SELECT doc_id, sum(a.n * b.n) AS d FROM {name}x a JOIN tx b USING (doc_id, tok) GROUP BY 1), {name}q AS (SELECT doc_id, sum(n * n) AS q FROM {name}x GROUP BY 1),
{name}c AS (SELECT doc_id, coalesce(d / sqrt(({name}q.q * tq.q)::DOUBLE), 0.0::DOUBLE) AS {name}s FROM row_ LEFT JOIN {name}d USING (doc_id) LEFT JOIN {name}q USING (doc_id) LEFT JOIN tq USING (doc_id))"""  # noqa: E731


@query(f"""WITH {_EX}, tx AS (SELECT doc_id, tok, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(told), '[A-Za-z0-9][A-Za-z0-9''-]*')) AS tok FROM row_) GROUP BY 1, 2), tq AS (SELECT doc_id, sum(n * n) AS q FROM tx GROUP BY 1), {_COS('h', 'history')}, {_COS('r', 'reasoned')},
w AS (SELECT doc_id, example_id, coalesce(judged, norm) AS quality, CASE WHEN judged IS NULL THEN 'fallback_rules' ELSE 'api_success' END AS source, coalesce(given, hs) AS baseline, rs AS similarity, told FROM row_ JOIN rules USING (doc_id) JOIN hc USING (doc_id) JOIN rc USING (doc_id)),
z AS (SELECT *, CASE WHEN quality >= 0.45 AND told <> '' AND similarity - baseline > 0 THEN quality * (similarity - baseline) ELSE -0.05::DOUBLE END AS reward FROM w)
SELECT doc_id, round(quality, 6) AS quality, source, round(baseline, 6) AS baseline, round(similarity, 6) AS similarity, round(reward, 6) AS reward, round((reward - avg(reward) OVER g) / nullif(stddev_samp(reward) OVER g, 0), 4) AS advantage FROM z WINDOW g AS (PARTITION BY example_id)""")
def text_rewards(spark, d):
    """Rewards from texts: documents are completions of their example (four each), whose history is a third of its first text; a judge scored every fifth, the rules the rest."""
    docs, bench = A.documents(spark, d), table(spark, d, "benchmark")
    own = docs.withColumn("example_id", F.expr("doc_id div 4"))
    history = own.groupBy("example_id").agg(F.min_by(F.expr("left(text, cast(length(text) div 3 as int))"), "doc_id").alias("history"))
    told = bench.select(F.col("item_id").alias("_item"), F.col("text").alias("told"))
    rows = own.join(history, "example_id").withColumn("_item", F.col("example_id") % F.lit(bench.count())).join(told, "_item")
    rows = rows.withColumns({"told": F.when(F.col("example_id") % 9 == 8, "").otherwise(F.col("told")), "given": F.when(F.col("doc_id") % 3 == 0, 0.1), "judged": F.when(F.col("doc_id") % 5 == 0, 0.8)})
    out = stage.lexical_rewards(rows, key="doc_id", history="history", completion="text", target="told", given="given", judged="judged", scorer="api")
    out = stage.advantages(out.withColumn("example_id", F.expr("doc_id div 4")), "example_id")
    return out.select("doc_id", "source", *[F.round(c, 6).alias(c) for c in ("quality", "baseline", "similarity", "reward")], F.round("advantage", 4).alias("advantage"))


@query(f"""WITH {_RANK}, {_RULES}, hm AS (SELECT DISTINCT user_id, item_id FROM hist UNION SELECT DISTINCT user_id, 0 FROM aim), nd AS (SELECT count(*) AS m FROM documents), cot AS (SELECT q.user_id, q.target_item_id, d.doc_id, q.text || chr(10) || chr(10) || 'Recommendation reasoning:' || chr(10) || {_STRIP('d.text')} AS text FROM q, nd, documents d WHERE d.doc_id = q.user_id % nd.m),
{_DT('cot', 'user_id')}, cs AS (SELECT user_id, p_name, dot / sqrt((nn * tn)::DOUBLE) AS score FROM (SELECT user_id, p_name, sum(a.tf * b.tf) AS dot FROM cott a JOIN it b USING (tok) GROUP BY 1, 2) JOIN cotn USING (user_id) JOIN itn USING (p_name)),
co AS (SELECT c.user_id, coalesce(score, 0.0::DOUBLE) AS sim FROM cot c JOIN part ON p_partkey = c.target_item_id LEFT JOIN cs USING (user_id, p_name)), cnt AS (SELECT p_name, count(*) AS n FROM part GROUP BY 1),
mask AS (SELECT hm.user_id, p_name, count(*) AS gone FROM hm JOIN part ON p_partkey = item_id JOIN aim USING (user_id) WHERE item_id <> target_item_id GROUP BY 1, 2),
br AS (SELECT own.user_id, 1 + coalesce(sum(n - coalesce(gone, 0)) FILTER (sc.score > own.sim), 0) AS r FROM own LEFT JOIN sc USING (user_id) LEFT JOIN cnt USING (p_name) LEFT JOIN mask USING (user_id, p_name) GROUP BY 1),
cr AS (SELECT co.user_id, 1 + coalesce(sum(n - coalesce(gone, 0)) FILTER (cs.score > co.sim), 0) AS r FROM co LEFT JOIN cs USING (user_id) LEFT JOIN cnt USING (p_name) LEFT JOIN mask USING (user_id, p_name) GROUP BY 1),
z AS (SELECT user_id, norm AS quality, br.r AS b, cr.r AS c, {_NDCG('cr.r', 100)} - ({_NDCG('br.r', 100)}) AS gain, {_NDCG('br.r', 100)} AS bn FROM cot JOIN rules USING (doc_id) JOIN br USING (user_id) JOIN cr USING (user_id))
SELECT user_id, round(quality, 6) AS quality, round(bn, 6) AS baseline_ndcg, CAST(c AS BIGINT) AS cot_rank, round(CASE WHEN quality >= 0.45 AND gain > 0 THEN quality * gain ELSE -0.05 END, 6) AS reward FROM z""")
def ranked_rewards(spark, d):
    """Rewards from ranks over the catalogue: the last item of each user, its history as query and mask, a document as reasoning, the rules as scorer."""
    q, docs = _queries(spark, d), table(spark, d, "documents").select("doc_id", F.col("text").alias("cot"))
    n = docs.count()
    rows = q.withColumn("doc_id", F.col("user_id") % n).join(docs, "doc_id").withColumn("told", F.lit("told"))
    out = stage.ranked_rewards(rows, postings.catalogue(_catalogue(spark, d)), key="user_id", history="text", completion="cot", target_id="target_item_id", target="told", hidden="history_item_id")
    return out.select("user_id", "cot_rank", *[F.round(c, 6).alias(c) for c in ("quality", "baseline_ndcg", "reward")])


@query(f"""WITH {_VEC.split(', pairs AS')[0]}, {_RULES}, t AS (SELECT vec_id, e, label, lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS tid FROM v), x AS (SELECT t.vec_id, t.e, b.e AS g, list_transform(range(1, len(t.e) + 1), lambda i: t.e[i] + 0.25 * b.e[i]) AS c FROM t JOIN v b ON b.vec_id = t.tid),
w AS (SELECT vec_id, norm AS quality, CASE WHEN vec_id % 3 = 0 OR vec_id % 2 = 1 THEN round(list_dot_product(e, g), 6) ELSE 0.2::DOUBLE END AS baseline, round(list_dot_product(c, g), 6) AS similarity, vec_id % 11 <> 0 AS told FROM x JOIN rules ON doc_id = vec_id)
SELECT vec_id, round(quality, 6) AS quality, baseline, similarity, round(CASE WHEN quality >= 0.45 AND told AND similarity - baseline > 0 THEN quality * (similarity - baseline) ELSE -0.05 END, 6) AS reward FROM w""")
def dense_rewards(spark, d):
    """Rewards from vectors: some baselines are given, some by another embedder; the text of the same number is scored by the rules."""
    _, v = _vectors(spark, d)
    k = F.col("qid")
    aims = v.select(F.col("item_id").alias("qid"), "v").join(_following(v), "qid").join(v.select(F.col("item_id").alias("tid"), F.col("v").alias("w")), "tid")
    scores = A.documents(spark, d).select(F.col("doc_id").alias("qid"), rewards.quality("rules", F.lit(""), F.col("text"))["score"].alias("quality"))
    rows = aims.join(scores, "qid").withColumns({"reasoned": F.zip_with("v", "w", lambda a, b: a + 0.25 * b), "given": F.when(k % 3 != 0, 0.2), "by": F.when(k % 2 == 0, "dense").otherwise("lexical"), "told": F.when(k % 11 != 0, "told").otherwise("")})
    out = stage.dense_rewards(rows, key="qid", base="v", reasoned="reasoned", target="w", told="told", quality="quality", given="given", given_by="by", embedder="dense")
    return out.select(k.alias("vec_id"), F.round("quality", 6).alias("quality"), "baseline", "similarity", F.round("reward", 6).alias("reward"))


# Events


@query("SELECT epoch_us(ts) // 3600000000 AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_tumbling(spark, d):
    return S.tumbling(table(spark, d, "events"), "1 hour").select((F.unix_timestamp("start") / 3600).cast("long").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


@query("WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, CAST(epoch_us(min(ts)) AS BIGINT) AS start_us, count(*) AS n FROM s GROUP BY user_id, k")
def events_sessions(spark, d):
    return S.sessions(table(spark, d, "events"), "30 minutes").select("user_id", F.unix_micros("start").alias("start_us"), "n")
