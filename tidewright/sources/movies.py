"""Movie-rating folders: five files of JSON maps, read as relations, and their examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions.text import compact, strip
from tidewright.operators.core import last_wins
from tidewright.sources.objects import json_members

#: The sentence that ends a prompt's preamble, and the preamble of prompts without it.
MARKER = "this user's movie viewing history over time is listed below."
PREAMBLE = "This user's movie viewing history over time is listed below."


def _map_file(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """key, value of a file (or a folder of files) that is one JSON object; of a key that stands twice the last."""
    return last_wins(json_members(spark, path, kind), ["key"], "place").drop("place")


def read_movies(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """users, items, user_ids, titles, raw_ids, sequences and splits; each file is read by its blocks."""
    maps = ["user2id", "itemid2title", "id2item"]
    members = last_wins(json_members(spark, f"{root}/proc_data/datamaps.json", "string", nested=True, parents=maps), ["parent", "key"], "place")
    pairs = lambda name, key, value: members.filter(F.col("parent") == name).select(F.col("key").alias(key), F.col("value").alias(value))
    said = lambda name, key: _map_file(spark, f"{root}/knowledge/{name}.klg", "struct<prompt:string,ans:string>").select(F.col("key").alias(key), F.coalesce("value.prompt", F.lit("")).alias("prompt"), F.coalesce("value.ans", F.lit("")).alias("ans"))
    return {
        "users": said("user", "user_id"),
        "items": said("item", "raw_id"),
        "user_ids": pairs("user2id", "user_id", "internal_id"),
        "titles": pairs("itemid2title", "item_id", "title"),
        "raw_ids": pairs("id2item", "item_id", "raw_id"),
        "sequences": _map_file(spark, f"{root}/proc_data/sequential_data.json", "array<array<string>>").select(
            F.col("key").alias("internal_id"), F.col("value")[0].alias("items"), F.transform(F.col("value")[1], lambda r: r.cast("int")).alias("ratings")
        ),
        "splits": json_members(spark, f"{root}/proc_data/train_test_split.json", "string", nested=True, arrays=True).select(F.col("parent").alias("split"), F.col("value").alias("user_id")),
    }


def preamble(prompt: Column) -> Column:
    """The prompt up to its history marker, with the marker."""
    head = strip(F.element_at(F.split(F.coalesce(prompt, F.lit("")), MARKER.replace(".", r"\."), 2), 1))
    return F.when(prompt.contains(MARKER), F.concat(head, F.lit(f" {MARKER}"))).otherwise(F.lit(PREAMBLE))


def target_index(ratings: Column, *, min_history: int, min_rating: int, allow_low: bool) -> Column:
    """Last place (from 0) after min_history others with a high rating; else, if allowed, the last; else null."""
    good = F.array_max(F.transform(ratings, lambda r, i: F.when((i >= min_history) & (r >= min_rating), i)))
    return F.coalesce(good, F.when(F.lit(allow_low) & (F.size(ratings) > min_history), F.size(ratings) - 1))


def movie_examples(tables: dict[str, DataFrame], *, split: str = "train", min_history: int = 5, max_history: int = 50, min_rating: int = 4, allow_low: bool = False, max_users: int = 0) -> DataFrame:
    """One row per user with a target: ids, target, history_item_count, user_history and the source texts.

    max_users > 0 keeps the users with the smallest hash of their id (a sampling feature).
    """
    users = tables["users"] if split == "all" else tables["users"].join(tables["splits"].filter(F.col("split") == split).select("user_id").distinct(), "user_id", "left_semi")
    users = users.join(tables["user_ids"], "user_id")
    if max_users > 0:
        users = users.orderBy(F.md5(F.col("user_id").cast("binary")), "user_id").limit(max_users).orderBy(F.col("user_id").try_cast("long"), "user_id")
    at = target_index(F.col("ratings"), min_history=min_history, min_rating=min_rating, allow_low=allow_low)
    own = users.join(tables["sequences"], "internal_id").withColumn("at", at).filter("at is not null").withColumn("start", F.greatest(F.col("at") - max_history, F.lit(0))).filter(F.col("at") - F.col("start") >= min_history)
    titled = lambda rows: rows.join(tables["titles"], "item_id", "left").withColumn("title", F.coalesce(F.nullif("title", F.lit("")), F.concat(F.lit("item-"), F.col("item_id"))))
    zipped = F.slice(F.arrays_zip("items", "ratings"), F.col("start") + 1, F.col("at") - F.col("start"))
    past = own.select("user_id", F.posexplode(zipped).alias("pos", "r")).select("user_id", "pos", F.col("r.items").alias("item_id"), F.col("r.ratings").alias("rating"))
    entry = F.concat("title", F.lit(", "), F.col("rating").cast("string"), F.lit(" stars"))
    history = titled(past).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("pos", entry.alias("entry")))).alias("h"))
    history = history.select("user_id", F.size("h").alias("history_item_count"), F.array_join(F.transform("h", lambda x: x["entry"]), "; ").alias("listed"))
    aim = own.select("user_id", "internal_id", "prompt", F.col("ans").alias("source_answer"), F.col("items")[F.col("at")].alias("item_id"), F.col("ratings")[F.col("at")].alias("target_rating"))
    aim = titled(aim).join(tables["raw_ids"], "item_id", "left").withColumn("raw_id", F.coalesce("raw_id", "item_id")).join(tables["items"].select("raw_id", F.col("ans").alias("known")), "raw_id", "left")
    return aim.join(history, "user_id").select(
        "user_id", F.col("internal_id").alias("internal_user_id"), F.col("item_id").alias("target_item_internal_id"), F.col("raw_id").alias("target_item_raw_id"), F.col("title").alias("target_item_title"),
        F.concat_ws(" ", F.nullif(strip(F.col("title")), F.lit("")), F.nullif(strip(F.col("known")), F.lit(""))).alias("target_item_text"), "target_rating", "history_item_count",
        compact(F.concat(preamble(F.col("prompt")), F.lit(" "), F.col("listed"), F.lit("."))).alias("user_history"), F.col("prompt").alias("source_prompt_full"), "source_answer",
    )
