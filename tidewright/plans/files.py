"""Queries that write files and read them back: JSON lines, splits, movie folders, each with the SQL of its rows.

Files go to a new place in the shared folder and are deleted when the driver ends.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.operators import core
from tidewright.operators.ranking import numbered
from tidewright.operators.stages import stage_enabled
from tidewright.plans import adapters as A
from tidewright.plans.registry import compact, query, strip
from tidewright.sources import jsonl, movies, sinks
from tidewright.sources.objects import member, write_objects
from tidewright.sources.tables import scratch, table

_DOC = "doc_id long, lang string, text string"


@query("SELECT doc_id, lang, md5(text) AS text, (SELECT count(*) FROM documents) AS written FROM documents")
def json_lines(spark, d):
    """Written whole (rows counted on the way), read strictly."""
    path = scratch(spark, "docs")
    n = sinks.write_jsonl(table(spark, d, "documents").select("doc_id", "lang", "text"), path)
    return jsonl.read_jsonl(spark, path, _DOC).select("doc_id", "lang", F.md5("text").alias("text"), F.lit(n).cast("long").alias("written"))


@query("SELECT doc_id, lang FROM documents UNION ALL SELECT doc_id, 'again' FROM documents WHERE doc_id % 3 = 0")
def appended_lines(spark, d):
    path, docs = scratch(spark, "appended"), table(spark, d, "documents").select("doc_id", "lang")
    sinks.write_jsonl(docs, path)
    sinks.append_jsonl(docs.filter("doc_id % 3 = 0").withColumn("lang", F.lit("again")), path)
    return jsonl.read_jsonl(spark, path, "doc_id long, lang string")


@query(f"""WITH t AS (SELECT doc_id, doc_id % 5 AS k, {strip('text')} AS t FROM documents) SELECT CASE WHEN k = 0 THEN 'malformed' WHEN k = 1 OR t = '' THEN 'blank answer' ELSE 'row' END AS kind, count(*) AS n, CAST(sum(CASE WHEN k > 1 AND t <> '' THEN doc_id ELSE 0 END) AS BIGINT) AS ids FROM t GROUP BY 1""")
def tolerant_lines(spark, d):
    """Malformed lines and rows without an answer are dead letters with a reason; blank lines are neither."""
    k, path = F.col("doc_id") % 5, scratch(spark, "lines")
    line = F.when(k == 0, F.concat(F.lit("{bad "), "doc_id")).otherwise(F.to_json(F.struct("doc_id", F.when(k == 1, "  ").otherwise(F.col("text")).alias("answer"))))
    docs = table(spark, d, "documents")
    docs.select(line.alias("value")).unionByName(docs.filter("doc_id % 4 = 0").select(F.lit("  ").alias("value"))).write.text(path)
    good, dead = jsonl.read_jsonl_tolerant(spark, path, "doc_id long, answer string", required=["answer"])
    both = good.select(F.lit("row").alias("kind"), "doc_id").unionByName(dead.select(F.col("reason").alias("kind"), F.lit(0).cast("long").alias("doc_id")))
    return both.groupBy("kind").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@query(f"""SELECT p_partkey AS item_id, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE p_name END AS title, CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 4 = 1 THEN {compact("p_name || '  x'")} ELSE 'late' END AS summary FROM part""")
def catalogue_files(spark, d):
    """Items and summaries out of JSON lines: the last line of an id counts, bad ids and blank summaries don't."""
    part, at = table(spark, d, "part"), scratch(spark, "items")
    rows = part.select(F.col("p_partkey").cast("string").alias("item_id"), F.lit(0).alias("v"), F.col("p_name").alias("title"), F.concat("p_name", F.lit("  x")).alias("summary"), F.lit("").alias("description_summary"))
    rows = rows.unionByName(rows.filter("cast(item_id as long) % 3 = 0").join(part.select(F.col("p_partkey").cast("string").alias("item_id"), "p_brand"), "item_id").select("item_id", F.lit(1).alias("v"), F.col("p_brand").alias("title"), F.lit(" ").alias("summary"), F.lit("").alias("description_summary")))
    k = F.col("item_id").cast("long") % 4
    rows = rows.withColumns({"summary": F.when(k == 0, F.lit(None).cast("string")).otherwise(F.col("summary")), "description_summary": F.when(k > 1, "late").otherwise(F.col("description_summary"))})
    bad = spark.createDataFrame([("x1", 0, "bad", "bad", "")], rows.schema)
    rows.unionByName(bad).orderBy("v", "item_id").drop("v").write.json(at)
    read = jsonl.read_jsonl(spark, at, "item_id string, title string, summary string, description_summary string", position="line_no")
    found = jsonl.item_map(read).select("item_id", "title")
    return found.join(jsonl.summary_map(read), "item_id", "left").select("item_id", "title", "summary")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS said, row_number() OVER (ORDER BY doc_id) AS global_index, (SELECT count(*) FROM documents) + (SELECT count(*) FROM documents WHERE doc_id % 3 = 0) AS rows_in_shards FROM documents")
def prediction_files(spark, d):
    """Three shards read in order, the first row of a key counts; rows of the shards are reconciled with what was written."""
    docs = table(spark, d, "documents").select("doc_id")
    parts = [docs.filter("doc_id % 2 = 0").withColumn("said", F.lit("even")), docs.filter("doc_id % 2 = 1").withColumn("said", F.lit("odd")), docs.filter("doc_id % 3 = 0").withColumn("said", F.lit("late"))]
    paths = [scratch(spark, f"shard{i}") for i in range(3)]
    n = sum(sinks.write_jsonl(p, path) for p, path in zip(parts, paths, strict=True))
    whole = sinks.reconciled([jsonl.read_jsonl(spark, p, "doc_id long, said string") for p in paths], n).count()
    first = jsonl.read_predictions(spark, paths, "doc_id long, said string", key="doc_id")
    return numbered(first, "doc_id", "place").select("doc_id", "said", (F.col("place") + 1).alias("global_index"), F.lit(whole).cast("long").alias("rows_in_shards"))


@query("SELECT CASE WHEN doc_id % 2 = 0 THEN 'A' ELSE 'B' END AS category, CASE doc_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'valid' ELSE 'test' END AS split, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM documents GROUP BY 1, 2")
def split_files(spark, d):
    """Splits of two categories, read as one relation."""
    root, docs = scratch(spark, "splits"), table(spark, d, "documents").select("doc_id")
    for i, category in enumerate("AB"):
        for j, split in enumerate(jsonl.SPLITS):
            docs.filter((F.col("doc_id") % 2 == i) & (F.col("doc_id") % 3 == j)).write.parquet(f"{root}/{category}/{split}.parquet")
    return jsonl.read_categories(spark, root, ["A", "B"]).groupBy("category", "split").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@query("SELECT doc_id, quality = 1 AS good, count(*) OVER (PARTITION BY quality = 1) AS n FROM labels")
def two_way_files(spark, d):
    """Selected and other rows in two files, each row in one of them."""
    a, b = scratch(spark, "selected"), scratch(spark, "rejected")
    n = sinks.write_two_ways(table(spark, d, "labels").select("doc_id", "quality"), F.col("quality") == 1, a, b)
    sides = [jsonl.read_jsonl(spark, p, "doc_id long, quality long").select("doc_id", F.lit(good).alias("good"), F.lit(m).cast("long").alias("n")) for p, good, m in ((a, True, n[0]), (b, False, n[1]))]
    return sides[0].unionByName(sides[1])


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'ValueError: no' END AS error, doc_id % 4 = 0 AS stamped FROM documents")
def failure_files(spark, d):
    """Rows that failed go beside the others, with their error and the time."""
    path = scratch(spark, "made")
    sinks.write_with_failures(table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, "ValueError: no").alias("error")), path)
    good = jsonl.read_jsonl(spark, path, "doc_id long").select("doc_id", F.lit(None).cast("string").alias("error"), F.lit(False).alias("stamped"))
    bad = jsonl.read_jsonl(spark, f"{path}.failures", "doc_id long, error string, failed_at timestamp")
    return good.unionByName(bad.select("doc_id", "error", F.col("failed_at").isNotNull().alias("stamped")))


@query("WITH o AS (SELECT doc_id AS k, row_number() OVER (ORDER BY doc_id DESC) AS pos FROM documents WHERE doc_id % 2 = 0), r AS (SELECT doc_id AS k, row_number() OVER (ORDER BY (doc_id % 2 <> 0), CASE WHEN doc_id % 2 = 0 THEN -doc_id ELSE 0 END, CAST(doc_id AS VARCHAR)) AS line FROM documents) SELECT CAST(k AS VARCHAR) AS key, line FROM r")
def checkpoint_files(spark, d):
    """A checkpoint rewritten: one row of each key and index, by input order, keys beyond the input last and sorted."""
    path, docs = scratch(spark, "checkpoint"), table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("key"), F.col("doc_id").alias("id"))
    done = docs.select("key", F.lit(0).alias("idx"), F.lit(1).alias("at")).unionByName(docs.filter("id % 5 = 0").select("key", F.lit(0).alias("idx"), F.lit(2).alias("at")))
    order = docs.filter("id % 2 = 0").select("key", (-F.col("id")).alias("pos"))
    rows = sinks.checkpoint_rows(done, order, key="key", index="idx", position="pos", written="at")
    rows.write.json(path)
    return jsonl.read_jsonl(spark, path, "key string", position="line").select("key", F.col("line").cast("long").alias("line"))


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id DESC) AS line, (SELECT count(*) FROM documents WHERE doc_id % 3 = 0) AS missing FROM documents WHERE doc_id % 3 <> 0")
def ordered_files(spark, d):
    """What was made, in the input's order; input rows without a result are counted."""
    path, docs = scratch(spark, "ordered"), table(spark, d, "documents").select("doc_id")
    made, order = docs.filter("doc_id % 3 <> 0"), docs.withColumn("pos", -F.col("doc_id"))
    sinks.write_ordered(made, order, path, key="doc_id", position="pos")
    lost = sinks.missing(order, made, "doc_id")
    return jsonl.read_jsonl(spark, path, "doc_id long", position="line").select("doc_id", "line", F.lit(lost).cast("long").alias("missing"))


@query("SELECT lang AS source, count(*) AS n, FALSE AS again FROM documents GROUP BY lang")
def report_files(spark, d):
    """A report as one JSON object, and an audit by source; a stage whose output stands isn't run again."""
    path, counts = scratch(spark, "report"), sinks.source_counts(table(spark, d, "documents"), "lang")
    report = counts.agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("counts"))
    sinks.write_report(report, path)
    again = stage_enabled(spark, "auto", path)
    read = jsonl.read_json(spark, path, "counts map<string,long>")
    return read.select(F.explode("counts").alias("source", "n"), F.lit(again).alias("again"))


@query("SELECT doc_id, 'c' || quality AS reasoning FROM labels WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, 'late' FROM labels WHERE doc_id % 3 = 0")
def reasoning_files(spark, d):
    """Reasoning by example: the last one counts, blank keys and texts don't."""
    path, labels = scratch(spark, "reasoning"), table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("example_id"), F.concat(F.lit("c"), "quality").alias("reasoning"))
    late = labels.filter("cast(example_id as long) % 3 = 0").withColumn("reasoning", F.lit("late"))
    blank = labels.withColumn("reasoning", F.lit(" ")).unionByName(labels.withColumn("example_id", F.lit("")))
    rows = labels.withColumn("v", F.lit(0)).unionByName(late.withColumn("v", F.lit(1))).unionByName(blank.withColumn("v", F.lit(2)))
    rows.orderBy("v").drop("v").write.json(path)
    read = jsonl.read_jsonl(spark, path, "example_id string, reasoning string", position="line_no")
    return jsonl.reasoning_map(read).select(F.col("example_id").cast("long").alias("doc_id"), "reasoning")


_MARK = "'" + movies.MARKER.replace("'", "''") + "'"
_OPEN = "'" + movies.PREAMBLE.replace("'", "''") + "'"


@query(f"""WITH {A.INTER}, t AS (SELECT user_id, max(pos) AS goal FROM inter WHERE rating >= 4 AND pos > 5 GROUP BY 1), h AS (SELECT i.user_id, count(*) AS m, string_agg(CASE WHEN item_id % 6 = 0 THEN 'item-' || item_id ELSE p_name || ' (1999)' END || ', ' || rating || ' stars', '; ' ORDER BY pos) AS listed FROM inter i JOIN t USING (user_id) JOIN part ON p_partkey = item_id WHERE pos < goal AND pos >= goal - 50 GROUP BY 1)
SELECT CAST(user_id AS VARCHAR) AS user_id, 'u' || user_id AS internal_user_id, 'r' || item_id AS target_item_raw_id, rating AS target_rating, CAST(m AS INTEGER) AS history_item_count, md5({compact(f"CASE WHEN user_id % 2 = 0 THEN 'Given  user ' || user_id || ', ' || {_MARK} ELSE {_OPEN} END || ' ' || listed || '.'")}) AS user_history,
concat_ws(' ', CASE WHEN item_id % 6 = 0 THEN 'item-' || item_id ELSE p_name || ' (1999)' END, CASE WHEN item_id % 4 <> 0 THEN 'known ' || p_brand END) AS target_item_text FROM t JOIN inter i USING (user_id) JOIN h USING (user_id) JOIN part ON p_partkey = item_id WHERE i.pos = goal AND user_id % 5 <> 4""")
def movie_files(spark, d):
    """A movie folder made from the orders (every file is one JSON object, written by tasks and read by blocks), and its examples."""
    root = scratch(spark, "movies")
    own, part = A.interactions(spark, d), table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("k"), "p_name", "p_brand")
    users = own.select(F.col("user_id").cast("string").alias("u")).distinct()
    number = F.col("u").cast("long")

    def put(rows, key, value, name: str):
        write_objects(rows.select(member(key, value).alias("member")), f"{root}/{name}")

    u, k = F.col("u"), F.col("k")
    maps = users.select(F.lit("user2id").alias("parent"), member(u, F.concat(F.lit("u"), u)).alias("member"))
    maps = maps.unionByName(part.filter("cast(k as long) % 6 <> 0").select(F.lit("itemid2title").alias("parent"), member(k, F.concat("p_name", F.lit(" (1999)"))).alias("member")))
    maps = maps.unionByName(part.select(F.lit("id2item").alias("parent"), member(k, F.concat(F.lit("r"), k)).alias("member")))
    write_objects(maps, f"{root}/proc_data/datamaps.json", nested=True)
    prompt = F.when(number % 2 == 0, F.concat(F.lit("Given  user "), "u", F.lit(", "), F.lit(movies.MARKER), F.lit(" old list."))).otherwise("no marker")
    put(users, u, F.struct(prompt.alias("prompt"), F.lit("a").alias("ans")), "knowledge/user.klg")
    put(part.filter("cast(k as long) % 4 <> 0"), F.concat(F.lit("r"), k), F.struct(F.concat(F.lit("known "), "p_brand").alias("ans")), "knowledge/item.klg")
    rows = F.array_sort(F.collect_list(F.struct("pos", F.col("item_id").cast("string").alias("i"), F.col("rating").cast("string").alias("r"))))
    sequence = own.groupBy("user_id").agg(rows.alias("s")).select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("k"), F.array(F.transform("s", lambda x: x["i"]), F.transform("s", lambda x: x["r"])).alias("v"))
    put(sequence, F.col("k"), F.col("v"), "proc_data/sequential_data.json")
    split = users.select(F.when(number % 5 == 4, "test").otherwise("train").alias("parent"), F.to_json(F.array("u")).alias("member"))
    write_objects(split.withColumn("member", F.expr("substr(member, 2, length(member) - 2)")), f"{root}/proc_data/train_test_split.json", nested=True, arrays=True)
    made = movies.movie_examples(movies.read_movies(spark, root), split="train")
    return made.select("user_id", "internal_user_id", "target_item_raw_id", "target_rating", "history_item_count", F.md5("user_history").alias("user_history"), "target_item_text")


@query("SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 2")
def preview_rows(spark, d):
    """The first two rows in input order (the limit is the feature)."""
    return sinks.preview(core.first_wins(table(spark, d, "documents").select("doc_id", "lang"), ["doc_id"], [F.asc("lang")]), "doc_id")
