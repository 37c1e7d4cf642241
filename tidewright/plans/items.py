"""Queries over items and histories, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.functions import items as I
from tidewright.functions import text as T
from tidewright.operators import datasets
from tidewright.plans import adapters as A
from tidewright.plans.registry import compact, query, strip
from tidewright.sources.tables import table

_LIST = lambda x, k: f"list_filter(list_transform(coalesce({x}, []), lambda x: {compact('x', 500)}), lambda x: x <> '')[1:{k}]"
_LABEL = lambda label, x: f"'{label}' || nullif({x}, '')"
_JOIN = lambda x, sep: f"array_to_string({x}, '{sep}')"


def _detail(label: str, names: tuple[str, ...], limit: int) -> str:
    found = ", ".join(f"nullif({compact(f'''coalesce(json_extract_string(details, '$.{chr(34)}{n}{chr(34)}'), '')''', limit)}, '')" for n in names)
    value = f"coalesce({found}, NULL)"
    return f"'{label}=' || CASE WHEN NOT contains(lower(coalesce(store, '')), 'format:') THEN {value} END" if label == "Format" else f"'{label}=' || {value}"


_DETAILS = "concat_ws('; ', " + ", ".join(_detail(*d) for d in I.DETAILS) + ")"
_STATS = "CASE WHEN coalesce(average_rating, 0) = 0 AND rating_number = 0 THEN '' ELSE concat_ws(', ', 'avg_rating=' || CAST(average_rating AS VARCHAR), 'rating_count=' || rating_number) END"
_STORE, _CATS = _LABEL("Store/artist/format: ", compact("coalesce(store, '')", 180)), lambda n: _LABEL("Categories: ", _JOIN(_LIST("categories", n), " > "))
_SUMMED = "CASE WHEN item_id % 2 = 0 THEN 'sum of  ' || name ELSE '' END"
_META = f"""meta AS (SELECT item_id, name, title, {_DETAILS} AS details, {_STATS} AS stats,
{compact(f"concat_ws('; ', {_STORE}, {_CATS(4)}, {_LABEL('Features: ', _JOIN(_LIST('features', 3), '; '))}, {_LABEL('Description: ', _JOIN(_LIST('description', 1), ' '))}, {_LABEL('Details: ', _DETAILS)}, {_LABEL('Catalog stats: ', _STATS)})", 320)} AS short,
concat_ws('; ', {_STORE}, {_CATS(4)}, {_LABEL('Summary: ', compact(_SUMMED))}, {_LABEL('Details: ', _DETAILS)}) AS summed FROM rich)"""


def _summary(rows):
    return F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("sum of  "), F.col("name"))).otherwise("")


@query(f"""WITH {A.RICH}, t AS (SELECT *, item_id % 10 <> 9 AS known, 'item ' || item_id AS given FROM rich)
SELECT item_id, md5(CASE WHEN NOT known THEN given ELSE {compact(f"concat_ws(' ', nullif({compact('title', 300)}, ''), nullif({compact('main_category', 300)}, ''), nullif({compact("coalesce(store, '')", 300)}, ''), {_CATS(6)}, {_LABEL('Features: ', _JOIN(_LIST('features', 8), '; '))}, {_LABEL('Description: ', _JOIN(_LIST('description', 2), ' '))})", 100)} END) AS short,
md5(CASE WHEN NOT known THEN given ELSE concat_ws(' ', coalesce(nullif({compact('title', 300)}, ''), given), 'Main category: ' || main_category, {_LABEL('Store/artist/format: ', compact("coalesce(store, '')", 300))}, {_CATS(6)}, {_LABEL('Summary: ', compact(_SUMMED))}, {_LABEL('Details: ', _DETAILS)}) END) AS summary,
md5(CASE WHEN NOT known THEN '' ELSE concat_ws(' ', nullif(left({compact('title')}, 300), ''), left({compact('main_category')}, 200), nullif(left({compact("array_to_string(coalesce(categories, [])[1:8], ' ')")}, 400), ''), nullif(left({compact("array_to_string(features[1:8], ' ')")}, 700), ''), nullif(left({compact("array_to_string(description[1:8], ' ')")}, 900), '')) END) AS proxy FROM t""")
def item_texts(spark, d):
    """The short, the summary and the proxy form; every tenth item is one that the catalogue lacks."""
    rows = A.rich_items(spark, d)
    item, title = F.when(F.col("item_id") % 10 != 9, F.col("item")), F.concat(F.lit("item "), F.col("item_id"))
    return rows.select("item_id", F.md5(I.item_text(item, title, 100)).alias("short"), F.md5(I.summary_text(item, title, _summary(rows), 0)).alias("summary"), F.md5(I.proxy_text(item)).alias("proxy"))


@query(f"WITH {A.RICH}, {_META} SELECT item_id, details, stats, md5(short) AS short, md5(summed) AS summed FROM meta")
def item_metadata(spark, d):
    rows, item = A.rich_items(spark, d), F.col("item")
    return rows.select("item_id", I.details_text(item).alias("details"), I.stats_text(item).alias("stats"), F.md5(I.metadata(item, 320)).alias("short"), F.md5(I.metadata(item, 0, "summary", _summary(rows))).alias("summed"))


_HEAD = "'This user''s Amazon CDs and Vinyl interaction history over time is listed below.'"
_STARS = "CASE WHEN item_id % 13 = 0 THEN '' ELSE ' (' || CASE WHEN rating % 2 = 0 THEN CAST(rating // 2 AS VARCHAR) ELSE (rating // 2) || '.5' END || ' stars)' END"
_ENTRIES = f"""{A.EXAMPLES}, {A.RICH}, {_META}, e AS (SELECT user_id, pos, {compact('meta.title', 240)} AS title, {_STARS} AS stars, short, summed, row_number() OVER (PARTITION BY user_id ORDER BY pos) AS k, count(*) OVER (PARTITION BY user_id) AS m FROM hist JOIN meta USING (item_id)),
f AS (SELECT *, CASE WHEN title = '' THEN ltrim(stars) ELSE title || stars END AS entry, k - greatest(m - 8, 0) AS place FROM e WHERE k > m - 8)"""
_LINE = lambda x: f"string_agg(place || '. ' || CASE WHEN entry = '' THEN '[missing title]' ELSE entry END || coalesce('; ' || nullif({x}, ''), ''), chr(10) ORDER BY pos)"


def _entries(spark, d):
    """Histories of eight: titles, ratings in halves (some missing) and metadata of the items, in order."""
    catalogue = A.rich_items(spark, d)
    made = catalogue.select("item_id", F.col("item.title").alias("title"), I.metadata(F.col("item"), 320).alias("short"), I.metadata(F.col("item"), 0, "summary", _summary(catalogue)).alias("summed"))
    own = A.examples(spark, d).filter(F.size("history_item_id") > 0)
    own = own.withColumn("ratings", F.transform(F.arrays_zip("history_item_id", "history_rating"), lambda x: F.when(x["history_item_id"] % 13 != 0, x["history_rating"] / 2.0)))
    own = datasets.last_columns(own, ["history_item_id", "ratings"], 8)
    return own.select("user_id", "history_item_id", "ratings").join(datasets.beside(own, "user_id", "history_item_id", made, ["title", "short", "summed"]), "user_id")


@query(f"WITH {_ENTRIES} SELECT user_id, {_HEAD} || ' ' || coalesce(string_agg(entry, '; ' ORDER BY pos) FILTER (entry <> ''), '') || '.' AS plain, md5({strip(f'{_HEAD} || chr(10) || {_LINE(chr(115) + 'hort')}')}) AS short, md5({strip(f'{_HEAD} || chr(10) || {_LINE(chr(115) + 'ummed')}')}) AS summed FROM f GROUP BY user_id")
def history_forms(spark, d):
    """One line, and numbered lines with either kind of metadata; titles and ratings are missing here and there."""
    own, category = _entries(spark, d), F.lit("CDs_And_Vinyl")
    form = lambda beside=None: I.history_text(category, F.col("title"), F.col("ratings"), 8, beside)
    return own.select("user_id", form().alias("plain"), F.md5(form(F.col("short"))).alias("short"), F.md5(form(F.col("summed"))).alias("summed"))


@query(f"""WITH {_ENTRIES}, u AS (SELECT user_id, count(*) AS ids, count(*) FILTER (stars <> '') AS parsed, string_agg(CASE WHEN stars <> '' THEN trim(stars) END, ',' ORDER BY pos) AS own, list(stars ORDER BY pos) FILTER (stars <> '') AS found FROM f GROUP BY user_id)
SELECT user_id, parsed, CASE WHEN ids >= 6 THEN 'rebuild' WHEN parsed >= 6 THEN 'existing' END AS auto, CASE WHEN parsed >= 8 THEN 'existing' WHEN ids >= 8 THEN 'rebuild' END AS existing, CASE WHEN ids >= 7 THEN 'rebuild' END AS rebuild,
regexp_replace(array_to_string(coalesce(found, []), ','), ' \\(| stars\\)', '', 'g') || repeat(CASE WHEN parsed = 0 THEN '5' ELSE ',5' END, CASE WHEN ids > parsed THEN 1 ELSE 0 END) || repeat(',5', greatest(ids - parsed - 1, 0)::BIGINT) AS fitted FROM u""")
def history_sources(spark, d):
    """Ratings read out of a history's text, where a query comes from under each policy, and ratings fitted to the items."""
    own = _entries(spark, d).withColumn("text", I.history_text(F.lit("CDs_And_Vinyl"), F.col("title"), F.col("ratings"), 8))
    text, ids = F.col("text"), F.col("history_item_id")
    fitted = F.array_join(F.transform(I.fitted_ratings(I.ratings_in(text), F.size(ids), 5.0), T.number), ",")
    return own.select("user_id", F.size(I.ratings_in(text)).cast("long").alias("parsed"), I.query_source(text, ids, 6, "auto").alias("auto"), I.query_source(text, ids, 8, "existing").alias("existing"), I.query_source(text, ids, 7, "rebuild").alias("rebuild"), fitted.alias("fitted"))


@query(f"WITH {_ENTRIES}, r AS (SELECT user_id, item_id, pos, CASE WHEN item_id % 13 <> 0 THEN rating / 2.0 END AS rating FROM hist), s AS (SELECT user_id, pos, rating, row_number() OVER (PARTITION BY user_id ORDER BY pos DESC) AS back FROM r), l AS (SELECT user_id, list(rating ORDER BY pos) AS given, count(*) AS n, count(rating) AS m FROM s WHERE back <= 8 GROUP BY user_id) SELECT user_id, n, m AS told, CASE WHEN m = n THEN 'text' WHEN m = 0 THEN 'none' ELSE 'columns' END AS source, round(coalesce(list_sum(given), 0), 6) AS total FROM l")
def history_rewrite(spark, d):
    """Ratings of a rewritten history: the row's own where they are given, else those that its text tells, else none."""
    own = _entries(spark, d).withColumn("text", I.history_text(F.lit("CDs_And_Vinyl"), F.col("title"), F.col("ratings"), 8))
    told = F.size(I.ratings_in(F.col("text")))
    n = F.size("history_item_id")
    source = F.when(told == n, "text").when(told == 0, "none").otherwise("columns")
    checked = I.checked_ratings(F.when(source == "columns", F.col("ratings")), F.col("text"), n)
    return own.select("user_id", n.cast("long").alias("n"), told.cast("long").alias("told"), source.alias("source"), F.round(F.aggregate(checked, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))), 6).alias("total"))


@query(f"""WITH {A.EXAMPLES.replace('inter AS (', 'inter AS MATERIALIZED (')}, {A.RICH}, texts AS MATERIALIZED (SELECT item_id, md5(CASE WHEN item_id % 10 = 9 THEN {compact('name', 300)} ELSE {compact(f"concat_ws(' ', nullif({compact('title', 300)}, ''), main_category, nullif({compact("coalesce(store, '')", 300)}, ''), {_CATS(6)}, {_LABEL('Features: ', _JOIN(_LIST('features', 8), '; '))}, {_LABEL('Description: ', _JOIN(_LIST('description', 2), ' '))})", 300)} END) AS text FROM rich),
g AS MATERIALIZED (SELECT user_id, list(item_id ORDER BY pos) AS ids, count(*) AS n FROM hist GROUP BY user_id), t AS MATERIALIZED (SELECT user_id, target_item_id, rating FROM aim JOIN (SELECT user_id, rating FROM inter WHERE pos = n) USING (user_id))
SELECT 'Parts:train:' || target_item_id || ':' || user_id AS example_id, texts.text AS target_text, CAST(least(g.n, 5) AS INTEGER) AS history_item_count, array_to_string(ids[-least(g.n, 5):], ',') AS ids
FROM g JOIN t USING (user_id) JOIN texts ON texts.item_id = target_item_id WHERE g.n >= 3 AND rating >= 2""")
def example_rows(spark, d):
    """Examples with enough history and a good target: keys, target text (left join on the target), last ids."""
    own = A.examples(spark, d).withColumn("rating", F.col("target_rating").cast("double"))
    own = datasets.last_columns(datasets.eligible(own, "history_title", "history_rating", "rating", least_history=3, least_rating=2), ["history_item_id"], 5)
    catalogue = A.rich_items(spark, d).filter("item_id % 10 <> 9").select(F.col("item_id").alias("target_item_id"), "item")
    own = own.join(catalogue, "target_item_id", "left")
    key = datasets.composite_key(F.lit("Parts"), F.lit("train"), F.col("target_item_id"), F.col("user_id"))
    return own.select(key.alias("example_id"), F.md5(I.item_text(F.col("item"), T.compact(F.col("target_title"), 300), 300)).alias("target_text"), F.size("history_item_id").alias("history_item_count"), F.array_join(F.transform("history_item_id", lambda x: x.cast("string")), ",").alias("ids"))


@query("""WITH c AS (SELECT p_partkey AS item_id, CASE p_partkey % 5 WHEN 0 THEN 'Video_Games' WHEN 1 THEN 'CDs_and_Vinyl' WHEN 2 THEN '' WHEN 3 THEN 'Books_And_Toyss' ELSE replace(p_type, ' ', '_') END AS category, '/root/' || replace(p_name, ' ', '/') || ': ' || p_brand AS path, p_retailprice AS price FROM part)
SELECT item_id, replace(replace(category, '_', ' '), 'And', 'and') AS label, CASE category WHEN 'Video_Games' THEN 'video games' WHEN 'CDs_and_Vinyl' THEN 'CDs and vinyl' WHEN '' THEN 'items' ELSE replace(category, '_', ' ') END AS plural,
CASE category WHEN 'Video_Games' THEN 'video game' WHEN 'CDs_and_Vinyl' THEN 'CD or vinyl' WHEN '' THEN 'item' ELSE rtrim(replace(category, '_', ' '), 's') END AS singular, replace(replace(replace(substr(path, 7), '/', '__'), ' ', '_'), ':', '_') AS file,
CASE WHEN length(path) <= 20 THEN path ELSE left(path, 20) || chr(10) || '...[truncated]' END AS short, CASE WHEN length(path) <= 24 THEN path ELSE rtrim(left(path, 8)) || chr(10) || '[TRUNCATED]' END AS cut, printf('%g', price / 7) AS number, printf('%g', price * 1e4) AS large, printf('%g', item_id::DOUBLE) AS whole FROM c""")
def names_and_numbers(spark, d):
    """Category labels of both kinds, names for files, short texts, and numbers with six digits."""
    k = F.col("p_partkey") % 5
    category = F.when(k == 0, "Video_Games").when(k == 1, "CDs_and_Vinyl").when(k == 2, "").when(k == 3, "Books_And_Toyss").otherwise(F.replace("p_type", F.lit(" "), F.lit("_")))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), category.alias("category"), F.concat(F.lit("/root/"), F.replace("p_name", F.lit(" "), F.lit("/")), F.lit(": "), F.col("p_brand")).alias("path"), F.col("p_retailprice").alias("price"))
    names, path = I.category_names(F.col("category")), F.col("path")
    return rows.select(
        "item_id", I.category_label(F.col("category")).alias("label"), names["plural"].alias("plural"), names["singular"].alias("singular"), T.file_safe(path, "/root").alias("file"), T.shortened(path, 20).alias("short"), T.block_cut(path, 24).alias("cut"),
        T.number(F.col("price") / 7).alias("number"), T.number(F.col("price") * 1e4).alias("large"), T.number(F.col("item_id").cast("double")).alias("whole"),
    )
