"""The driver's tables seen as the entities of the engine, in Spark and (as common table expressions) in SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators.core import histories, last_rows
from tidewright.operators.order import places_within
from tidewright.sources.tables import evenly, table

LAST = 20


def items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"), F.col("p_type").alias("main_category"), F.col("p_brand").alias("store"), F.col("p_retailprice").alias("average_rating"), F.col("p_size").alias("rating_number"))


def documents(spark: SparkSession, d: str) -> DataFrame:
    """Ids and texts, dealt to all cores: for functions that cost much by text."""
    return evenly(table(spark, d, "documents").select("doc_id", "text"))


def rich_items(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue with made-up lists, details and gaps: item_id, name and a struct item."""
    k, name = F.col("p_partkey"), F.col("p_name")
    no = F.lit(None).cast("string")
    pick = lambda *cases: reduce(lambda x, c: x.when(c[0], c[1]), cases[1:], F.when(*cases[0]))
    details = pick(
        (k % 6 == 0, F.lit("{bad")), (k % 6 == 1, F.lit("[1, 2]")),
        (k % 6 == 2, F.concat(F.lit('{"Artist": "A '), F.col("p_brand"), F.lit('", "Manufacturer": "M '), F.col("p_type"), F.lit('", "Label": "", "Format": "LP", "Runtime": "'), F.col("p_size"), F.lit(' minutes", "Number Of Discs": "2"}'))),
        (k % 6 == 3, F.lit('{"Label": "L", "Manufacturer": "M", "Media Format": "CD", "Format": "LP", "Language": " en  us ", "Genre": "  "}')), (k % 6 == 4, F.lit("")),
    )
    listed = F.array("p_type", F.lit(" "), "p_brand", F.concat(F.lit("Size "), F.col("p_size")), name, F.concat("p_type", F.lit(" "), name), F.concat("p_brand", F.lit("x")), F.lit("more"), F.lit("last"))
    item = F.struct(
        F.when(k % 7 == 0, "").otherwise(F.concat(name, F.lit("  "), F.col("p_brand"))).alias("title"), F.col("p_type").alias("main_category"),
        F.when(k % 5 == 0, F.concat(F.lit("Format: Vinyl "), F.col("p_brand"))).when(k % 11 == 1, no).otherwise(F.col("p_brand")).alias("store"),
        F.when(k % 4 != 1, listed).alias("categories"), F.split(name, " ").alias("features"),
        F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(name, F.lit("\n"), F.col("p_type")), F.lit(""), F.repeat(F.concat(name, F.lit(" ")), 60))).alias("description"), details.alias("details"),
        F.when(k % 9 == 0, None).when(k % 9 == 1, 0.0).otherwise((F.col("p_size") % 9) / 2.0).alias("average_rating"), F.when((k % 9 < 2) | (k % 8 == 0), 0).otherwise(F.col("p_size")).alias("rating_number"),
    )
    return evenly(table(spark, d, "part")).select(k.alias("item_id"), name.alias("name"), item.alias("item"))


ORDER = ["o_orderdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]


def log(spark: SparkSession, d: str) -> DataFrame:
    """user_id, item_id, rating and what orders a user's rows."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    # Named before any window, so that what groups by user_id later needs no second shuffle.
    return rows.select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"), (1 + F.floor("l_quantity") % 5).cast("int").alias("rating"), *ORDER)


def interactions(spark: SparkSession, d: str) -> DataFrame:
    """user_id, item_id, rating and pos, the place in the user's log; a long log is numbered by many tasks."""
    own = places_within(log(spark, d), "user_id", [F.col(c) for c in ORDER], "pos", drop=ORDER)
    return own.select("user_id", "item_id", "rating", F.col("pos").cast("int").alias("pos"))


def recent(spark: SparkSession, d: str, n: int) -> DataFrame:
    """The last n interactions of each user: user_id, item_id, rating and at, which orders them."""
    return last_rows(log(spark, d).select("user_id", "item_id", "rating", F.struct(*ORDER).alias("at")), "user_id", "at", n)


def examples(spark: SparkSession, d: str) -> DataFrame:
    """user_id, target_item_id, target_title, history_item_id[], history_title[], history_rating[]"""
    return histories(recent(spark, d, LAST + 1).join(items(spark, d).select("item_id", "title"), "item_id"), "user_id", "at", ["item_id", "title", "rating"], LAST)


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Documents as reasoning candidates with made-up rubric dimensions and gains."""
    i, n = F.col("doc_id"), F.col("n_chars")
    rows = table(spark, d, "documents").select("doc_id", "n_chars", F.expr("doc_id div 4").alias("example_id"), (i % 4).alias("candidate_index"), (1 + i * 7 % 5).alias("d1"), (1 + i * 11 % 5).alias("d2"), (1 + (i * 13 + n) % 5).alias("d3"), (1 + n % 5).alias("d4"), (1 + F.expr("n_chars div 7") % 5).alias("d5"), (((i * 37 + n) % 201 - 100) / F.lit(1000.0)).alias("gain"))
    return rows.withColumn("rubric", F.col("d1") + F.col("d2") + F.col("d3") + F.col("d4") + F.col("d5")).withColumn("norm", F.col("rubric") / F.lit(25.0))


def tagged(spark: SparkSession, d: str) -> DataFrame:
    """Documents cut in two and put into synonym tags; odd ids stay without tags."""
    half = F.expr("cast(length(text) div 2 as int)")
    t = F.concat(F.lit("<Thinking> "), F.expr("left(text, cast(length(text) div 2 as int))"), F.lit("</thinking>\n<recommendation>"), F.substr("text", half + 1), F.lit(" </RECOMMENDATION>"))
    return documents(spark, d).select("doc_id", "text", F.when(F.col("doc_id") % 2 == 0, t).otherwise(F.concat(F.lit("Final answer: "), F.col("text"))).alias("raw"))


INTER = """inter AS (SELECT o_custkey AS user_id, l_partkey AS item_id, CAST(1 + CAST(floor(l_quantity) AS BIGINT) % 5 AS INTEGER) AS rating,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) AS pos,
  count(*) OVER (PARTITION BY o_custkey) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
EXAMPLES = INTER + """, hist AS (SELECT user_id, item_id, rating, pos, p_name AS title FROM inter JOIN part ON p_partkey = item_id WHERE pos < n AND pos >= n - 20),
aim AS (SELECT user_id, item_id AS target_item_id, p_name AS target_title FROM inter JOIN part ON p_partkey = item_id WHERE pos = n)"""
SCORED = """scored0 AS (SELECT doc_id, n_chars, doc_id // 4 AS example_id, doc_id % 4 AS candidate_index, 1 + doc_id * 7 % 5 AS d1, 1 + doc_id * 11 % 5 AS d2, 1 + (doc_id * 13 + n_chars) % 5 AS d3, 1 + n_chars % 5 AS d4, 1 + (n_chars // 7) % 5 AS d5,
  ((doc_id * 37 + n_chars) % 201 - 100) / 1000.0::DOUBLE AS gain FROM documents), scored AS (SELECT *, d1 + d2 + d3 + d4 + d5 AS rubric, (d1 + d2 + d3 + d4 + d5) / 25.0::DOUBLE AS norm FROM scored0)"""
TAGGED = """tagged AS (SELECT doc_id, text, CASE WHEN doc_id % 2 = 0 THEN '<Thinking> ' || left(text, length(text) // 2) || '</thinking>' || chr(10) || '<recommendation>' || substr(text, length(text) // 2 + 1) || ' </RECOMMENDATION>' ELSE 'Final answer: ' || text END AS raw FROM documents)"""
RICH = """rich AS (SELECT p_partkey AS item_id, p_name AS name, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_name || '  ' || p_brand END AS title, p_type AS main_category,
  CASE WHEN p_partkey % 5 = 0 THEN 'Format: Vinyl ' || p_brand WHEN p_partkey % 11 = 1 THEN NULL ELSE p_brand END AS store,
  CASE WHEN p_partkey % 4 <> 1 THEN [p_type, ' ', p_brand, 'Size ' || p_size, p_name, p_type || ' ' || p_name, p_brand || 'x', 'more', 'last'] END AS categories, string_split(p_name, ' ') AS features,
  CASE WHEN p_partkey % 3 = 0 THEN [] ELSE [p_name || chr(10) || p_type, '', repeat(p_name || ' ', 60)] END AS description,
  CASE p_partkey % 6 WHEN 2 THEN '{"Artist": "A ' || p_brand || '", "Manufacturer": "M ' || p_type || '", "Label": "", "Format": "LP", "Runtime": "' || p_size || ' minutes", "Number Of Discs": "2"}'
    WHEN 3 THEN '{"Label": "L", "Manufacturer": "M", "Media Format": "CD", "Format": "LP", "Language": " en  us ", "Genre": "  "}' ELSE '{}' END AS details,
  CASE p_partkey % 9 WHEN 0 THEN NULL WHEN 1 THEN 0.0::DOUBLE ELSE (p_size % 9) / 2.0::DOUBLE END AS average_rating, CASE WHEN p_partkey % 9 < 2 OR p_partkey % 8 = 0 THEN 0 ELSE p_size END AS rating_number FROM part)"""
