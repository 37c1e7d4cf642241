"""Corpus pipeline: language ID, toxicity, near duplicates, benchmark decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps, with all their
columns; the last returns the digests of the encoded documents. Models are fitted on the tables of
sf_dir under the same rules as the single queries.

Edge cases of all stages: an empty table gives an empty table with the same columns; other columns
are kept as they are, whatever their names; rows are decided one by one, so repeated rows and null
ids, languages or sources are rows like others (but for near duplicates, see there).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.llm import decontaminate, jaccard, language, queries, toxicity
from tidewright.llm.spark_io import kept, quoted
from tidewright.sources.tables import table


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; null, empty and letterless texts go."""
    return language.recognised(docs, queries.language_model(spark, sf_dir))


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not scored as toxic; null and empty texts have the base score and stay."""
    return toxicity.civil(docs, queries.toxicity_model(spark, sf_dir))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that with the smallest id (null ids last), then text hash.

    Rows are told apart by id and text, so one id on two texts is two rows, each decided by itself, and
    rows without an id are rows like others; of rows equal in both, one is kept. Null, empty and blank
    texts have no shingles and are no copies of each other, but for rows equal in id and text.
    """
    key = F.xxhash64(F.col("doc_id"), F.col("text"))
    rows = docs.select(key.alias("key"), "doc_id", "text")
    groups = jaccard.join(rows, id_col="key").select(F.col("doc_id").alias("key"), F.col("component_id").alias("group")).distinct()
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")
    named = kept(rows.groupBy("key", "doc_id").agg(F.count("*").alias("n")).join(groups, "key"), "rows")
    first = named.groupBy("group").agg(F.min(place).alias("first")).select("first.key")
    repeated = named.filter("n > 1").select("key")
    gone = named.select("key").join(first, "key", "left_anti").unionByName(repeated).distinct()
    whole = docs.select(key.alias("key"), F.struct(*[F.col(quoted(c)).alias(c) for c in docs.columns]).alias("row"))
    single = whole.join(gone, "key", "left_anti")
    one = F.row_number().over(Window.partitionBy("key").orderBy(F.lit(1)))
    again = whole.join(repeated.join(first, "key", "left_semi"), "key", "left_semi").withColumn("n", one).filter("n = 1")
    return single.select("row.*").unionByName(again.select("row.*"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark; texts without words stay, an empty benchmark hits nothing."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the remaining documents, one row each; null texts have no tokens."""
    return queries.bpe_round_trip(docs)


STAGES = [("language_id", identified), ("toxicity", civil), ("near_duplicates", distinct_texts), ("decontamination", decontaminated), ("bpe", encoded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = kept(docs, f"stage-{name}")
    return docs


#: The stages' models and components can't be expressed in SQL; the tests compare with brute force.
ORACLE_SQL = None
