"""The registered queries of the operators in this folder, over whole tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import bpe, chat, decontaminate, divergence, jaccard, language, licenses, media, quality, search, sharding, toxicity, urls
from tidewright.llm.spark_io import id_remainder
from tidewright.sources.tables import table

#: Tokenizer file of op3.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Conversation -7 of op1.
EXAMPLE = r"\### Assistant: </turn> ok"


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", EXAMPLE), (-7, 1, "assistant", EXAMPLE)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_chats(turns.unionByName(extra), count=bpe.counter(spark, bpe.tokenizer_text(TOKENIZER))))


def language_model(spark: SparkSession, sf_dir: str) -> language.Model:
    """Fitted on the text and lang of documents that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language.fit(docs.filter(id_remainder("doc_id", 5) != 0))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.identify(table(spark, sf_dir, "documents").select("doc_id", "text"), language_model(spark, sf_dir))
    return found.select("doc_id", (id_remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "rejected")


def op3_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(table(spark, sf_dir, "documents"))


def bpe_round_trip(docs: DataFrame) -> DataFrame:
    return bpe.round_trip(docs, bpe.tokenizer_text(TOKENIZER)).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    """Fitted on labels of documents that are not held out."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(id_remainder("doc_id", 4) != 2)
    return toxicity.fit(table(spark, sf_dir, "documents").select("doc_id", "text"), labels)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), toxicity_model(spark, sf_dir))
    return found.select("doc_id", (id_remainder("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_media(media.to_media(table(spark, sf_dir, "documents")))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.digest(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality.classify(docs, table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


#: Rules of op12: verdict, host, path.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), RULES)


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (op1_chat_formatting, op2_language_id, op3_bpe_encoding, op4_ngram_jaccard_join, op5_toxicity, op6_sharding, op7_media_columns, op8_benchmark_decontamination, op9_license_scans, op10_quality_classifier)
    + (op11_source_divergence, op12_url_filters, op13_ranked_search)
}

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_q = lambda pattern: pattern.replace("'", "''")


def _URLS(name: str, rows: str, columns: str) -> str:
    """SQL tables that add host, path, rule, verdict and node to rows with an url."""
    fits = [(v, h + p, f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')") for v, h, p in sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[0] == "block"))]
    of = lambda k: "CASE " + " ".join(f"WHEN {x[2]} THEN '{x[k]}'" for x in fits) + " END"
    return rf"""{name}0 AS (SELECT *, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM ({rows})),
{name}1 AS (SELECT *, coalesce(translate(regexp_extract(rest, '(?s)^[^/?#]*'), '{urls.UPPER}', '{urls.LOWER}'), '') AS host, coalesce(regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1), '') AS path, list_filter(string_split(regexp_extract(rest, '(?s)^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_')) AS params FROM {name}0),
{name} AS (SELECT {columns}, url, host, path, {of(1)} AS rule, {of(0)} AS verdict, CASE WHEN rest IS NOT NULL THEN regexp_replace(host, ':(?:80|443)?$', '') || regexp_replace(path, '/+$', '') || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END END AS node FROM {name}1)"""


#: SQL where it can say a query's rows. The others' are tested against brute force or held-out labels.
ORACLES: dict[str, str] = {
    "op4_ngram_jaccard_join": rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct([array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)])) END AS s FROM d),
m AS (SELECT doc_id, len(s) AS n, CASE WHEN len(s) > 0 THEN md5(array_to_string(s, chr(10))) END AS node, s FROM s),
nodes AS (SELECT node, any_value(s) AS s, min(doc_id) AS low, any_value(n) AS n FROM m WHERE node IS NOT NULL GROUP BY node), sh AS (SELECT node, n, unnest(s) AS t FROM nodes),
pairs AS (SELECT a.node AS x, b.node AS y, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM sh a JOIN sh b ON a.t = b.t AND a.node < b.node GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs WHERE 100 * c >= 75 * (na + nb - c)), ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(node, other) AS (SELECT node, node FROM nodes UNION SELECT reach.node, ways.y FROM reach JOIN ways ON ways.x = reach.other),
comp AS (SELECT reach.node, min(o.low) AS component_id FROM reach JOIN nodes o ON o.node = reach.other GROUP BY reach.node)
SELECT doc_id, n AS n_shingles, CASE WHEN m.node IS NULL THEN doc_id ELSE component_id END AS component_id FROM m LEFT JOIN comp ON comp.node = m.node""",
    "op8_benchmark_decontamination": rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, w, least(13, len(w)) AS n FROM (SELECT item_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS k FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
places AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win)),
hits AS (SELECT r, i, places.n, item_id FROM places JOIN win ON win.n = places.n AND win.k = array_to_string(w[i : i + places.n - 1], ' ')),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
own AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN hit USING (r) LEFT JOIN own USING (r)""",
    "op11_source_divergence": rf"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOW}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
tok AS (SELECT r, lang, source, unnest(t) AS term FROM d), g AS (SELECT DISTINCT lang, source FROM d),
vocab AS (SELECT lang, term, count(*) AS total FROM tok GROUP BY 1, 2 HAVING count(DISTINCT r) >= 3), v AS (SELECT lang, count(*) AS v, sum(total) AS n FROM vocab GROUP BY 1),
c AS (SELECT lang, source, term, count(*) AS n FROM tok SEMI JOIN vocab USING (lang, term) GROUP BY 1, 2, 3), gn AS (SELECT lang, source, coalesce(sum(n), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY 1, 2),
p AS (SELECT gn.lang, gn.source, vocab.term, coalesce(c.n, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (gn.n + v.v)::HUGEINT AS p, 1 + (1000000000::HUGEINT * (total + 1)) // (v.n + v.v)::HUGEINT AS q FROM gn JOIN vocab ON vocab.lang = gn.lang JOIN v ON v.lang = gn.lang LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = vocab.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM p WHERE c > 0 AND p > q),
r AS (SELECT *, 'pair' AS part FROM pairs UNION ALL SELECT *, 'term' FROM terms)
SELECT lang, source, part, item, value, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY part, lang, source ORDER BY value DESC, item) AS rank FROM r) WHERE part = 'pair' OR rank <= 200""",
    "op12_url_filters": rf"""WITH RECURSIVE {_URLS("p", "SELECT row_number() OVER () AS r, page_id, url, html FROM pages", "r, page_id, html")},
tags AS (SELECT r, url, unnest(regexp_extract_all(regexp_replace(html, '{urls.HIDDEN}', '', 'g'), '{urls.TAG}')) AS t FROM p WHERE strpos(url, '://') > 0),
refs AS (SELECT r, url, replace(trim(CASE WHEN regexp_matches(t, '{_q(urls.CANONICAL)}') THEN regexp_extract(t, '{_q(urls.HREF)}', 1) || regexp_extract(t, '{_q(urls.HREF)}', 2) || regexp_extract(t, '{_q(urls.HREF)}', 3) WHEN regexp_matches(t, '{_q(urls.REFRESH)}') THEN regexp_extract(t, '{_q(urls.TO)}', 1) END, ' '), '&amp;', '&') AS link FROM tags),
whole AS (SELECT r, CASE WHEN regexp_matches(link, '{urls.ABSOLUTE}') THEN link WHEN starts_with(link, '//') THEN regexp_extract(url, '(?s)^(.*?:)//', 1) || link WHEN regexp_matches(link, '{urls.SCHEME}') OR starts_with(link, '#') OR link = '' THEN NULL
  WHEN starts_with(link, '/') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*') || link WHEN starts_with(link, '?') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*[^?#]*') || link
  WHEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) <> '' THEN regexp_replace(regexp_extract(url, '(?s)^.*?://[^/?#]*[^?#]*'), '[^/]*$', '') || link ELSE regexp_extract(url, '(?s)^.*?://[^/?#]*') || '/' || link END AS url FROM refs),
{_URLS("l", "SELECT r, url FROM whole WHERE url IS NOT NULL", "r")}, ways AS (SELECT p.node AS x, l.node AS y FROM l JOIN p USING (r) UNION SELECT l.node, p.node FROM l JOIN p USING (r)),
reach(x, y) AS (SELECT node, node FROM p WHERE node IS NOT NULL UNION SELECT reach.x, ways.y FROM reach JOIN ways ON ways.x = reach.y),
said AS (SELECT node, verdict FROM p WHERE verdict IS NOT NULL UNION SELECT node, verdict FROM l WHERE verdict IS NOT NULL),
class AS (SELECT x AS node, max((verdict = 'block')::INT) AS block, max((verdict = 'allow')::INT) AS allow FROM reach JOIN said ON said.node = reach.y GROUP BY 1)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN block = 1 AND allow = 0 THEN 'block' ELSE 'allow' END, 'allow') AS verdict FROM p LEFT JOIN class USING (node)""",
    "op13_ranked_search": rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS t FROM documents), n AS (SELECT r, len(t) AS n FROM d WHERE len(t) > 0), s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS size FROM n),
i AS (SELECT row_number() OVER () AS i, item_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS t FROM benchmark), q AS (SELECT i, term, count(*) AS times FROM (SELECT i, unnest(t) AS term FROM i) GROUP BY 1, 2),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) SEMI JOIN q USING (term) GROUP BY 1, 2), w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY 1), s),
im AS (SELECT r, term, (1000000000::BIGINT * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // size)) AS impact FROM tf JOIN n USING (r), s),
sc AS (SELECT i, r, sum(times * w * impact)::BIGINT AS score FROM q JOIN w USING (term) JOIN im USING (term) GROUP BY 1, 2),
best AS (SELECT i, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM sc JOIN d USING (r) WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM best JOIN i USING (i) WHERE rank <= 10""",
}
